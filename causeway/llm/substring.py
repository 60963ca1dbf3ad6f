"""Substring dedup: windows of k words that already stand in a document with a smaller id are removed.

Pass 1 merges the partitions' count-min sketches of all windows (sketch.py). It overestimates, so every window that
stands twice is estimated repeated. Pass 2 groups exactly, by 96-bit keys, only the windows estimated repeated. Before
anything is shuffled each partition settles what it can: an occurrence in a document that isn't the smallest of the
partition with that window is covered there and then, so a window sends its smallest document of a partition alone and
a passage that a third of all documents share sends one row a partition. Windows go to a bucket by their smallest run
of four words, so neighbours travel together and their positions cost about a byte.

Defined results: null text has no words; a null id counts as larger than all others; equal ids never remove from each
other, whatever their texts; repeated rows give repeated results; texts of any length are read whole, cut into runs of
windows that are settled in turn; other columns of the input are not read, whatever their names; a table without rows
gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from . import text as X
from .frames import lean, text_bytes

U = np.uint64
LAST = (1 << 63) - 1
ANCHOR = 4
#: Estimated windows a bucket: what one task of the exact pass holds at once, about 20 bytes each.
BUCKET = 1_000_000
#: Candidate windows of a partition that are settled at once.
HELD = 1 << 20
SECOND = 0xA0761D6478BD642F | 1


def _windows(texts: pa.Array, k: int):
    """For runs of texts: (first row, words before each text, word hashes, first word of each window in one text)."""
    for lo, hi in X.slices(texts):
        data, offs = X.raw(texts[lo:hi])
        starts, ends, before = X.words(data, offs)
        h = X.word_hashes(data, starts, ends)
        n = np.maximum(np.diff(before) - k + 1, 0)
        yield lo, before, h, X.runs(before[:-1], n), np.repeat(np.arange(hi - lo), n)


def _anchors(h: np.ndarray, k: int) -> np.ndarray:
    """The smallest hash of ANCHOR consecutive words within each window of k words (of min(k, ANCHOR), if fewer)."""
    a = min(k, ANCHOR)
    v, size, want = X.windows(h, a), 1, k - a + 1
    while size * 2 <= want:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (want - size)], v[want - size :]) if want > size else v


def _ranges(ids: np.ndarray, th: np.ndarray, at: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Covered word ranges of occurrences, which are sorted by document and position."""
    if not len(ids):
        return {"id": ids, "th": th, "lo": at, "hi": at}
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (at[1:] > at[:-1] + k)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return {"id": ids[first], "th": th[first], "lo": at[first], "hi": at[last] + k}


def _pack(kind: int, *arrays: np.ndarray) -> bytes:
    body = b"".join(np.int64(a.nbytes).tobytes() + a.dtype.char.encode() + a.tobytes() for a in arrays)
    return bytes([kind]) + zstandard.compress(body, 1)


def _unpack(blob: bytes) -> tuple[int, list[np.ndarray]]:
    kind, body, out, at = blob[0], zstandard.decompress(blob[1:]), [], 0
    while at < len(body):
        n = int(np.frombuffer(body, np.int64, 1, at)[0])
        kind_of = np.dtype(chr(body[at + 8]))
        out.append(np.frombuffer(body, kind_of, n // kind_of.itemsize, at + 9))
        at += 9 + n
    return kind, out


def _first_docs(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each occurrence the smallest id with the same key."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(a)))
    out = np.empty(len(ids), np.int64)
    if len(a):
        out[order] = np.repeat(np.minimum.reduceat(ids[order], first), size)
    return out


def repeated_ranges(docs: DataFrame, id_col: str, text_col: str, k: int = 13, total: int | None = None) -> DataFrame:
    """(id, th, lo, hi): the word ranges that a smaller id already has, th being xxhash64 of the text."""
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    total = text_bytes(src) if total is None else total
    about = total // 6 + 1
    buckets = max(1, about // BUCKET)

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, h, at, _ in _windows(X.texts_of(batch["text"]), k):
            yield X.windows(h, k)[at]

    seen = sketch.build(src.select("text"), keys, sketch.bits_for(about), partitions=total >> 24)
    held_sketch = src.sparkSession.sparkContext.broadcast(seen)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk, held, n = held_sketch.value, [], 0

        def settle() -> pa.RecordBatch:
            nonlocal held, n
            h1, h2, ids, th, at, bucket = (np.concatenate(c) for c in zip(*held))
            held, n = [], 0
            order = np.lexsort((at, th, ids))
            h1, h2, ids, th, at, bucket = (c[order] for c in (h1, h2, ids, th, at, bucket))
            later = _first_docs(h1, h2, ids) < ids
            r = _ranges(ids[later], th[later], at[later], k)
            rows = [(int(h1[0] % U(buckets)), _pack(0, r["id"], r["th"], r["lo"].astype(np.int32), r["hi"].astype(np.int32)))]
            own = np.flatnonzero(~later)
            own = own[np.argsort(bucket[own], kind="stable")]
            edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[own]) != 0])) if len(own) else []
            for part in np.split(own, edge[1:]) if len(own) else []:
                new = np.concatenate([[True], (ids[part][1:] != ids[part][:-1]) | (th[part][1:] != th[part][:-1])])
                doc = np.flatnonzero(new)
                rows.append(
                    (int(bucket[part[0]]), _pack(1, ids[part][doc], th[part][doc], np.diff(np.append(doc, len(part))).astype(np.int32), np.diff(at[part], prepend=0).astype(np.int32), h1[part], h2[part]))
                )
            return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())})

        for batch in batches:
            ids_in, th_in = batch["id"].to_numpy(zero_copy_only=False), batch["th"].to_numpy(zero_copy_only=False)
            for lo, before, h, at, doc in _windows(X.texts_of(batch["text"]), k):
                h1 = X.windows(h, k)[at]
                hot = np.flatnonzero(sk.counts(h1) >= 2)
                if len(hot):
                    at, doc = at[hot], doc[hot]
                    h2 = (X.windows(X.mix(h), k, SECOND)[at] >> U(32)).astype(np.uint32)
                    bucket = (X.mix(_anchors(h, k)[at]) % U(buckets)).astype(np.int32)
                    held.append((h1[hot], h2, ids_in[lo:][doc], th_in[lo:][doc], at - before[doc], bucket))
                    n += len(hot)
                if n >= HELD:
                    yield settle()
        if n:
            yield settle()

    def group(t: pa.Table) -> pa.Table:
        out, parts = [], []
        for blob in t["blob"]:
            kind, a = _unpack(blob.as_py())
            if kind == 0:
                out.append(dict(zip(("id", "th", "lo", "hi"), a)))
            else:
                ids, th, size, gaps, h1, h2 = a
                parts.append((h1, h2, np.repeat(ids, size), np.repeat(th, size), np.cumsum(gaps)))
        if parts:
            h1, h2, ids, th, at = (np.concatenate(c) for c in zip(*parts))
            later = np.flatnonzero(_first_docs(h1, h2, ids) < ids)
            later = later[np.lexsort((at[later], th[later], ids[later]))]
            out.append(_ranges(ids[later], th[later], at[later], k))
        return pa.table({c: pa.array(np.concatenate([r[c] for r in out]), kind) for c, kind in (("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()))})

    return src.mapInArrow(lean(candidates), "bucket int, blob binary").groupBy("bucket").applyInArrow(group, "id long, th long, lo int, hi int")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """id_col, n_words, n_removed, kept: the words left of each document, joined by one space."""
    ranges = repeated_ranges(docs, id_col, text_col, k).groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    src = docs.select(
        F.col(id_col).alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.col(text_col).alias("text")
    )
    joined = src.join(ranges, ["id", "th"], "left").select("given", "text", "ranges")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = X.texts_of(batch["text"]), batch["ranges"]
            flat = lists.flatten()
            lo, hi = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            per = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            row, skip = np.repeat(np.arange(len(texts)), per), np.concatenate([[0], np.cumsum(per)])
            for a, b in X.slices(texts):
                data, offs = X.raw(texts[a:b])
                starts, ends, before = X.words(data, offs)
                own = slice(skip[a], skip[b])
                cover = np.zeros(len(starts) + 1, np.int64)
                base = before[row[own] - a]
                np.add.at(cover, base + lo[own], 1)
                np.add.at(cover, base + hi[own], -1)
                keep = np.cumsum(cover)[:-1] == 0
                s, size = starts[keep], (ends - starts)[keep] + 1
                out = np.append(data, np.uint8(32))[X.runs(s, size)]
                end = np.cumsum(size)
                out[end - 1] = 32
                kept = np.concatenate([[0], np.cumsum(keep)])[before]
                edge = np.concatenate([[0], end])[kept]
                bytes_out = out.tobytes()
                n = np.diff(before)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["given"][a:b],
                        pa.array(n, pa.int64()),
                        pa.array(n - np.diff(kept), pa.int64()),
                        pa.array([bytes_out[x : max(x, y - 1)] for x, y in zip(edge[:-1], edge[1:])], pa.binary()).cast(pa.string()),
                    ],
                    names=[id_col, "n_words", "n_removed", "kept"],
                )

    given = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(lean(strip), f"`{id_col}` {given}, n_words long, n_removed long, kept string")
