"""Sync messages and sync states as bytes, and back.

A message is a type byte, the sender's heads, the hashes it asks for, what it has (heads of the last sync and a Bloom
filter of what came since), its changes as chunks, and flags. A document of which more than a third goes is sent as one
document chunk if the other side reads such messages. A state is a type byte and the shared heads; nothing else outlives
a session. Every document's message is a value of its own, made and read where its row lies.

Defined results: of several filters in a message the first counts, so more is sent, never less; a message without
filters or flags is read as one with an empty filter and no flags; unknown flags are kept. Bytes of another type, cut short
or with filters of other than seven probes raise BadChunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.frames import written
from ..operators.sync import BITS, PROBES, Message, whole_document
from . import chunks
from .chunks import BadChunk, Bytes, uleb

#: Fixed values of the protocol: first bytes of a message with changes, of one with a whole document, of a state.
MESSAGE, WHOLE_MESSAGE, STATE = 0x42, 0x43, 0x43
#: The byte that precedes the flags, and the bit that marks a byte of flags.
WHOLE_KNOWN, FLAGS = 0x02, 0x80


def _hashes(hashes: list[bytes]) -> bytes:
    return uleb(len(hashes)) + b"".join(sorted(map(bytes, hashes)))


def _read_hashes(b: Bytes) -> list[bytes]:
    return [b.take(32) for _ in range(b.uleb())]


def encode_state(shared_heads: list[bytes]) -> bytes:
    return bytes([STATE]) + _hashes(shared_heads)


def decode_state(data: bytes) -> list[bytes]:
    b = Bytes(data)
    if b.take(1)[0] != STATE:
        raise BadChunk("not a sync state")
    return _read_hashes(b)


def encode(heads: list[bytes], need: list[bytes], last_sync: list[bytes], entries: int, bits: list[int], parts: list[bytes], flags: int | None = 0, whole: bool = False) -> bytes:
    """One message; `bits` are the places that are set in a filter of `entries` hashes."""
    held = np.zeros(-(-entries * BITS // 8) * 8, np.uint8)
    held[np.asarray(bits, np.int64)] = 1
    bloom = uleb(entries) + uleb(BITS) + uleb(PROBES) + np.packbits(held, bitorder="little").tobytes() if entries else b""
    out = [bytes([WHOLE_MESSAGE if whole else MESSAGE]), _hashes(heads), _hashes(need), uleb(1), _hashes(last_sync), uleb(len(bloom)), bloom, uleb(len(parts))]
    for part in parts:
        out += [uleb(len(part)), part]
    if flags is not None:
        out += [uleb(2), bytes([WHOLE_KNOWN, FLAGS | flags])]
    return b"".join(out)


def decode(data: bytes) -> dict:
    """The parts of a message by name, as encode() takes them, and `size`, the bits of the filter."""
    b = Bytes(data)
    kind = b.take(1)[0]
    if kind not in (MESSAGE, WHOLE_MESSAGE):
        raise BadChunk("not a sync message")
    heads, need = _read_hashes(b), _read_hashes(b)
    haves = [(_read_hashes(b), b.prefixed()) for _ in range(b.uleb())]
    last_sync, bloom = haves[0] if haves else ([], b"")
    entries, bits, size = 0, [], 0
    if bloom:
        f = Bytes(bloom)
        entries, own, probes = f.uleb(), f.uleb(), f.uleb()
        if probes != PROBES:
            raise BadChunk(f"a filter of {probes} probes")
        size = -(-entries * own // 8) * 8
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(f.take(size // 8), np.uint8), bitorder="little")).tolist()
    parts = [b.prefixed() for _ in range(b.uleb())]
    flags = None
    if b.left():
        flags = 0
        for x in b.prefixed():
            flags |= x & ~FLAGS if x & FLAGS else 0
    return {"heads": heads, "need": need, "last_sync": last_sync, "entries": entries, "size": size, "bits": bits, "parts": parts, "flags": flags, "whole": kind == WHOLE_MESSAGE}


# -- frames


def states(shared_heads: DataFrame) -> DataFrame:
    """(doc, bytes): the state of every document that has shared heads (doc, hash)."""
    rows = shared_heads.groupBy("doc").agg(F.collect_set("hash").alias("h"))
    return _each(rows, lambda r: {"doc": r["doc"], "bytes": encode_state(r["h"])}, "doc string, bytes binary")


def read_states(rows: DataFrame) -> DataFrame:
    """(doc, hash): the shared heads of states (doc, bytes)."""
    found = _each(rows.select("doc", "bytes"), lambda r: {"doc": r["doc"], "h": decode_state(r["bytes"])}, "doc string, h array<binary>")
    return found.select("doc", F.explode("h").alias("hash"))


def _each(rows: DataFrame, one, schema: str) -> DataFrame:
    """What `one` makes of each row."""
    own = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([one(row)], schema=own)

    return rows.mapInArrow(run, schema)


def _parts(m: Message, changes: DataFrame | None, ops: DataFrame | None, whole: bool) -> DataFrame:
    """(doc, place, bytes, whole): the chunks of a message."""
    if ops is None or changes is None:
        raise ValueError("changes are sent with their operations")
    send, more = m.changes, None
    if whole:
        big = whole_document(changes, m.changes).where("whole").select("doc")
        all_, own = changes.join(big, "doc", "left_semi"), ops.join(big, "doc", "left_semi")
        more = chunks.write(all_, own).select("doc", F.lit(0).cast("long").alias("place"), "bytes", F.lit(True).alias("whole"))
        send = send.join(big, "doc", "left_anti")
    each = chunks.rehashed(send, ops.join(send.select("doc").distinct(), "doc", "left_semi"))
    each = each.where("bytes is not null").select("doc", F.col("max_op").alias("place"), "bytes", F.lit(False).alias("whole"))
    return each if more is None else each.unionByName(more)


def to_bytes(m: Message, changes: DataFrame | None = None, ops: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(doc, bytes): a session's message for each document; with `whole`, the peer reads document chunks.

    Without `ops` no changes go; `changes` and `ops` are the sender's, with hashes that follow the binary format.
    """
    last, bits, sizes = m.have
    of = lambda df, c, name: df.groupBy("doc").agg(F.collect_list(c).alias(name))
    sides = [of(m.heads, "hash", "heads"), of(m.need, "hash", "need"), of(last, "hash", "last_sync"), of(bits, "bit", "bits"), sizes.groupBy("doc").agg(F.max("entries").alias("entries"))]
    if ops is not None:
        parts = _parts(m, changes, ops, whole)
        sides.append(parts.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "bytes"))), lambda x: x["bytes"]).alias("parts"), F.max("whole").alias("whole")))
    rows = reduce(lambda a, b: a.join(b, "doc", "full"), sides)
    flags = m.flags

    def one(r: dict) -> dict:
        lists = [r[k] or [] for k in ("heads", "need", "last_sync")]
        return {"doc": r["doc"], "bytes": encode(*lists, r["entries"] or 0, r["bits"] or [], r.get("parts") or [], flags, bool(r.get("whole")))}

    return _each(rows, one, "doc string, bytes binary")


def from_bytes(rows: DataFrame) -> tuple[Message, DataFrame]:
    """The message that rows (doc, bytes) hold and the operations of its changes."""
    found = _each(
        rows.select("doc", "bytes"),
        lambda r: {"doc": r["doc"], **{k: v for k, v in decode(r["bytes"]).items() if k != "whole"}},
        "doc string, heads array<binary>, need array<binary>, last_sync array<binary>, entries long, size long, bits array<long>, parts array<binary>, flags int",
    )
    found = written(found, "messages")
    of = lambda c, name="hash": found.select("doc", F.explode(c).alias(name))
    sent, ops = chunks.read(found.where("size(parts) > 0").select("doc", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x))").alias("bytes")))
    flags = found.agg(F.bit_or("flags")).first()[0]
    have = of("last_sync"), of("bits", "bit"), found.select("doc", F.col("size").alias("bits"), "entries").where("entries > 0")
    return Message(of("heads"), of("need"), have, sent, flags), ops
