"""Token ids of whole texts by a tokenizer file, and a compressed file format for them.

Encoding. Texts are cut where every byte-level BPE pre-tokenizer with the usual pattern cuts anyway (before white space
that follows other characters, and between a letter and punctuation, the letter in ASCII, U+C0 to U+27F or U+400 to
U+47F). Different pieces of a batch are encoded once by the tokenizers library, many joined to one text: an id's bytes tell
where pieces end in its ids, and if they don't, each piece is encoded alone. A bounded cache keeps pieces between batches
and, in a worker, between tasks; once full it keeps those that were found again. A text with white space or control
characters outside ASCII, for which those cuts aren't certain, is encoded whole; so is any text with an added token's string.

File format. One zstandard dictionary is trained on serialized id arrays of a bounded sample and shared; each document
is compressed on its own, so one document is read without its neighbours. A file is

    b"CWTOK001" | sha256 of the dictionary (32) | blobs | index | n documents, index offset (8 bytes each) | b"CWTOKEND"

with an index entry (little-endian int64) for each document: doc_id, ids before it in the file, number of ids, blob
offset, blob length. Ids are stored as uint16 if the vocabulary allows, else uint32.

Defined results: null text is the empty text (its end id alone); documents are in ascending doc_id order, null ids
first, equal ids by xxhash64 of the text; repeated rows are all kept; texts of any length are encoded whole;
other columns of the input are not read; a table without rows gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .frames import lean, sampled, shared_dir

U = np.uint64
#: Pieces that a worker keeps between batches, about 40 bytes each, and bits of the number of slots they hash to.
CACHE, SLOTS = 1_000_000, 21
#: Documents and bytes of ids that the dictionary is trained on, at most, and its size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY = 2_000, 8 << 20, 64 << 10

#: Classes of bytes, as bits: white space, letters, punctuation but the apostrophe, bytes that may belong to white space
#: outside space and newline or to control characters that some engines count so, and first bytes of two that are a letter.
_BLANK, _LETTER, _PUNCT, _ODD, _LEAD, _FIRST = (1 << i for i in range(6))
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 10]] |= _BLANK
for _lo, _hi, _kind in (
    (65, 91, _LETTER), (97, 123, _LETTER), (33, 39, _PUNCT), (40, 48, _PUNCT), (58, 65, _PUNCT), (91, 97, _PUNCT), (123, 127, _PUNCT),
    (0, 10, _ODD), (11, 32, _ODD), (0xC2, 0xC3, _LEAD), (0xE1, 0xE4, _LEAD), (0xC3, 0xCA, _FIRST), (0xD0, 0xD2, _FIRST),
):
    _CLASS[_lo:_hi] |= _kind
#: Bytes of text that are encoded at once: an encoding holds far more than its ids.
AT_ONCE = 1 << 16


class Encoder:
    """Ids of batches of texts. One for each worker: it holds the cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.added = [str(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.widths = self._widths()
        self._empty()

    def _widths(self) -> np.ndarray | None:
        """Bytes of each id; None if a piece's ids may hang on what stands before it, or an id's bytes aren't its characters."""
        from tokenizers import pre_tokenizers

        t, pre = self.tokenizer, self.tokenizer.pre_tokenizer
        if t.normalizer or t.truncation or t.padding or not isinstance(pre, pre_tokenizers.ByteLevel) or pre.add_prefix_space or not pre.use_regex:
            return None
        if any(" " in x or "\n" in x for x in self.added):  # joined pieces could spell it
            return None
        vocab = t.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)
        out[np.fromiter(vocab.values(), np.int64, len(vocab))] = np.fromiter(map(len, vocab), np.int64, len(vocab))
        return out

    def _empty(self) -> None:
        # pieces by number: their hash, where their ids begin, how many, whether found again; slots lead to the numbers,
        # the rest is sorted. Arrays have room behind the `kept` pieces and the `filled` ids.
        self.kept = self.filled = 0
        self.key, self.at, self.n, self.again = (np.zeros(1 << 16, t) for t in (U, np.int64, np.int32, bool))
        self.ids = np.zeros(1 << 18, np.int32)
        self.slot_key, self.slot_of = np.zeros(1 << SLOTS, U), np.full(1 << SLOTS, -1, np.int32)
        self.more, self.more_of = np.zeros(0, U), np.zeros(0, np.int32)

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids end to end."""
        got: list[list[int]] = []
        for at in range(0, len(pieces), 4096):
            got += [e.ids for e in self.tokenizer.encode_batch_fast(pieces[at : at + 4096], add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int32, len(got))
        return n, np.fromiter(chain.from_iterable(got), np.int32, int(n.sum()))

    def _pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of a buffer; those that don't end in white space are encoded joined."""
        solid = (_CLASS[data[end - 1]] & _BLANK) == 0
        found = self._joined(data, start[solid], end[solid]) if self.widths is not None and solid.any() else None
        if found is None:
            raw = data.tobytes()
            return self._plain([raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())])
        if solid.all():
            return found
        rest = self._plain([data[a:b].tobytes().decode() for a, b in zip(start[~solid].tolist(), end[~solid].tolist())])
        n = np.zeros(len(start), np.int32)
        n[solid], n[~solid] = found[0], rest[0]
        ids, own = np.zeros(int(n.sum()), np.int32), np.repeat(solid, n)
        ids[own], ids[~own] = found[1], rest[1]
        return n, ids

    def _joined(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for pieces that end in another character than white space. None if ids don't begin where pieces do.

        One text is made of them. The pattern cuts before white space, so a piece that begins with it has the ids it has
        alone; others are preceded by a newline, which is an id of its own and left out again.
        """
        lead = (_CLASS[data[start]] & _BLANK) == 0
        size = end - start + lead
        to = np.cumsum(size)
        text, own = np.full(int(to[-1]), 10, np.uint8), np.ones(int(to[-1]), bool)
        own[(to - size)[lead]] = False
        text[own] = data[X.runs(start, end - start)]
        parts, a = [], 0
        while a < len(to):
            before = to[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(to, before + AT_ONCE, side="right")))
            found = self.tokenizer.encode_batch_fast([text[before : to[b - 1]].tobytes().decode()], add_special_tokens=False)
            parts.append(np.array(found[0].ids, np.int32))
            a = b
        ids = np.concatenate(parts)
        ends = np.cumsum(self.widths[ids])
        last = np.searchsorted(ends, to)
        if not len(ends) or ends[-1] != to[-1] or (ends[last] != to).any():
            return None
        first = np.concatenate([[0], last[:-1] + 1])
        if (self.widths[ids[first[lead]]] != 1).any():
            return None
        keep = np.ones(len(ids), bool)
        keep[first[lead]] = False
        return (last + 1 - first - lead).astype(np.int32), ids[keep]

    def _learn(self, keys: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Keep pieces under their different keys."""
        a, b = self.kept, self.kept + len(keys)
        if b > len(self.key):
            size = max(b, min(2 * len(self.key), CACHE))
            self.key, self.at, self.n, self.again = (np.concatenate([x[:a], np.zeros(size - a, x.dtype)]) for x in (self.key, self.at, self.n, self.again))
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.filled], np.zeros(max(len(ids), self.filled), np.int32)])
        self.key[a:b], self.n[a:b], self.again[a:b] = keys, n, False
        self.at[a:b] = np.cumsum(n, dtype=np.int64) - n + self.filled
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.kept, self.filled = b, self.filled + len(ids)
        number = np.arange(a, b, dtype=np.int32)
        for choice in (0, 1):
            slot = self._slot(keys, choice)
            free = np.flatnonzero(self.slot_of[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.slot_key[slot[put]], self.slot_of[slot[put]] = keys[put], number[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, number = keys[left], number[left]
            if not len(keys):
                return
        order = np.argsort(keys)
        place = np.searchsorted(self.more, keys[order])
        self.more, self.more_of = np.insert(self.more, place, keys[order]), np.insert(self.more_of, place, number[order])

    def _thin(self) -> None:
        """Of a full cache keep only pieces that were found again, half of it at most."""
        keep = np.flatnonzero(self.again[: self.kept])[-(CACHE // 2) :]
        keys, n, ids = self.key[keep], self.n[keep], self.ids[X.runs(self.at[keep], self.n[keep].astype(np.int64))]
        self._empty()
        self._learn(keys, n, ids)

    @staticmethod
    def _slot(keys: np.ndarray, choice: int) -> np.ndarray:
        return (keys & U((1 << SLOTS) - 1) if choice else keys >> U(64 - SLOTS)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of pieces, -1 for those not kept."""
        slot = self._slot(keys, 0)
        out = np.where(self.slot_key[slot] == keys, self.slot_of[slot], np.int32(-1))
        left = np.flatnonzero(out < 0)
        if len(left):
            own = keys[left]
            slot = self._slot(own, 1)
            out[left] = np.where(self.slot_key[slot] == own, self.slot_of[slot], np.int32(-1))
            left = left[out[left] < 0]
            if len(left) and len(self.more):
                i = np.minimum(np.searchsorted(self.more, keys[left]), len(self.more) - 1)
                out[left] = np.where(self.more[i] == keys[left], self.more_of[i], np.int32(-1))
        return out

    def _whole(self, texts: pa.Array, data: np.ndarray, kind: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Rows of texts for which the cuts aren't certain."""
        bad = np.flatnonzero(kind & (_ODD | _LEAD))
        a, b = data[bad], data[np.minimum(bad + 1, len(data) - 1)]
        odd = ((kind[bad] & _ODD) > 0) | ((a == 0xC2) & ((b == 0xA0) | (b == 0x85))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
        out = np.zeros(len(texts), bool)
        out[np.searchsorted(offs, bad[odd], side="right") - 1] = True
        raw = data.tobytes() if self.added else b""
        for token in self.added:
            if token.encode() in raw:
                out |= np.asarray(pa.compute.match_substring(texts, token).to_numpy(zero_copy_only=False), bool)
        return np.flatnonzero(out)

    @staticmethod
    def _cuts(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Whether texts may be cut before each byte, and the end."""
        out = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            now, before = kind[1:], kind[:-1]
            out[1:-1] = ((now & _BLANK) > (before & _BLANK)) | ((now & _PUNCT) > 0) & ((before & _LETTER) > 0)
            late = np.flatnonzero(((now & _PUNCT) > 0) & (data[:-1] > 127)) + 1  # after a letter of two bytes; not U+D7, U+F7
            late = late[late > 1]
            a, b = data[late - 2], data[late - 1]
            out[late[((kind[late - 2] & _FIRST) > 0) & ~((a == 0xC3) & ((b == 0x97) | (b == 0xB7)))]] = True
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, numbers of ids, ids end to end) for runs of the texts."""
        for lo, hi in X.slices(texts):
            own = texts[lo:hi]
            data, offs = X.raw(own)
            kind = _CLASS[data]
            whole = self._whole(own, data, kind, offs)
            mark = self._cuts(data, kind)
            for r in whole:
                mark[offs[r] : offs[r + 1]] = False
            mark[offs] = True
            cut = np.flatnonzero(mark)
            start, end = cut[:-1], cut[1:]
            held = np.searchsorted(start, offs)
            lone = np.zeros(len(start), bool)
            for r in whole:
                lone[held[r] : held[r + 1]] = True
            h = X.word_hashes(data, start, end)
            number = self._find(h)
            number[lone] = 0
            miss = np.flatnonzero(number < 0)
            if len(miss):
                u, first = np.unique(h[miss], return_index=True)
                if self.kept and self.kept + len(u) > CACHE:
                    self._thin()
                    number = self._find(h)
                    number[lone] = 0
                    miss = np.flatnonzero(number < 0)
                    u, first = np.unique(h[miss], return_index=True)
                self.again[number[number >= 0]] = True
                self._learn(u, *self._pieces(data, start[miss[first]], end[miss[first]]))
                number[miss] = self._find(h[miss])
            else:
                self.again[number] = True
            n, at, ids = self.n[number].astype(np.int64), self.at[number], self.ids
            if lone.any():
                raw = data.tobytes()
                own_n, own_ids = self._plain([raw[start[k] : end[k]].decode() for k in np.flatnonzero(lone)])
                n[lone], at[lone] = own_n, np.cumsum(own_n, dtype=np.int64) - own_n + len(ids)
                ids = np.concatenate([ids, own_ids])
            sums = np.concatenate([[0], np.cumsum(n)])
            yield lo, np.diff(sums[held]), ids[X.runs(at, n)] if len(n) else ids[:0]


_HELD: dict[tuple, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, kept from task to task with what it has learnt; one at a time."""
    found = os.stat(path)
    key = (path, found.st_mtime_ns, found.st_size)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(path)
    return _HELD[key]


def with_end(n: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same documents, each with the end id after its ids: offsets (one more than documents) and ids."""
    offs = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(int(offs[-1]), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[offs[1:] - 1] = False
    out[keep] = ids
    return offs, out


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def open_file(uri: str):
    """(file system, path in it) of a path or URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:"))


class TokenFile:
    """Reader of one file; reads the index, then single documents."""

    HEAD, TAIL = b"CWTOK001", b"CWTOKEND"

    def __init__(self, source, dictionary: bytes):
        self.source = source
        size = source.size()
        tail = source.read_at(24, size - 24)
        head = source.read_at(40, 0)
        if head[:8] != self.HEAD or tail[16:] != self.TAIL:
            raise ValueError("not a token file")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        n, at = np.frombuffer(tail[:16], "<i8")
        self.index = np.frombuffer(source.read_at(int(n) * 40, int(at)), "<i8").reshape(-1, 5)
        self.open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, i: int) -> np.ndarray:
        _, _, n, at, length = (int(x) for x in self.index[i])
        body = self.open.decompress(self.source.read_at(length, at))
        return np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4").astype(np.uint32)


def _train(docs: DataFrame, id_col: str, text_col: str, path: str) -> bytes:
    """A dictionary from the ids of SAMPLE_DOCS documents at most, chosen by the hash of their id."""
    rows = sampled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.col("id"), SAMPLE_DOCS).select("text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, room = encoder(path), SAMPLE_BYTES
        kind = "<u2" if enc.size <= 1 << 16 else "<u4"
        for batch in batches:
            for _, n, ids in enc.encode(X.texts_of(batch["text"])):
                for part in np.split(ids, np.cumsum(n)[:-1]):
                    blob = part.astype(kind).tobytes()
                    if len(blob) <= room:
                        room -= len(blob)
                        yield pa.RecordBatch.from_pydict({"ids": pa.array([blob], pa.binary())})

    found = [bytes(r["ids"]) for r in rows.coalesce(1).mapInArrow(lean(encoded), "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, found).as_bytes() if len(found) >= 16 else b""
    except zstandard.ZstdError:  # too little to train on
        return b""


def write_tokens(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> tuple[DataFrame, bytes]:
    """Write token files in ascending id order; (table of files: part, uri, docs, tokens, start; the dictionary).

    Ids are made where the rows lie and shuffled compressed; the files are range-partitioned by id.
    """
    spark = docs.sparkSession
    dictionary = _train(docs, id_col, text_col, path)
    held = spark.sparkContext.broadcast(dictionary)
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or not folder.startswith("file:") else "file://" + folder.removeprefix("file:")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = [i / parts for i in range(1, parts)]
    splits = src.agg(F.percentile_approx("id", share, 10_000)).first()[0] if share else None
    splits = sorted(set(splits or []))
    part_of = F.lit(0)
    if splits:
        part_of = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(F.lit(splits), lambda x: x < F.col("id"))))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = "<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4"
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(held.value) if held.value else None, write_content_size=True, write_checksum=False)
        for batch in batches:
            texts = X.texts_of(batch["text"])
            for lo, n, ids in enc.encode(texts):
                offs, out = with_end(n, ids, end_id)
                out = out.astype(kind)
                blobs = [squeeze.compress(out[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:])]
                own = slice(lo, lo + len(n))
                yield pa.RecordBatch.from_arrays(
                    [batch["part"][own], batch["id"][own], batch["th"][own], pa.array(n + 1, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "id", "th", "n", "blob"]
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, part = None, [], None
        fs, base = open_file(folder)

        def close() -> pa.RecordBatch:
            index = np.array(rows, "<i8").reshape(-1, 5)
            at = out.tell()
            out.write(index.tobytes() + np.array([len(rows), at], "<i8").tobytes() + TokenFile.TAIL)
            out.close()
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "uri": pa.array([f"{folder}/{name}"]), "docs": pa.array([len(rows)], pa.int64()), "tokens": pa.array([int(index[:, 2].sum())], pa.int64())}
            )

        for batch in batches:
            for p, i, n, blob in zip(batch["part"].to_pylist(), batch["id"].to_pylist(), batch["n"].to_pylist(), batch["blob"]):
                if p != part:
                    if out is not None:
                        yield close()
                    part, rows, name = p, [], f"{p:08d}-{uuid.uuid4().hex}.cwtok"
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}")
                    out.write(TokenFile.HEAD + hashlib.sha256(held.value).digest())
                blob = blob.as_buffer()
                rows.append((-(1 << 63) if i is None else i, sum_before(rows), n, out.tell(), len(blob)))
                out.write(blob)
        if out is not None:
            yield close()

    def sum_before(rows: list) -> int:
        return rows[-1][1] + rows[-1][2] if rows else 0

    files = (
        src.withColumn("part", part_of.cast("int"))
        .mapInArrow(lean(encoded), "part int, id long, th long, n long, blob binary")
        .repartitionById(len(splits) + 1, "part")
        .sortWithinPartitions("part", F.asc_nulls_first("id"), "th")
        .mapInArrow(lean(write), "part int, uri string, docs long, tokens long")
        .collect()
    )  # one row a file
    start, rows = 0, []
    for f in sorted(files, key=lambda f: f["part"]):
        rows.append((f["part"], f["uri"], f["docs"], f["tokens"], start))
        start += f["tokens"]
    return spark.createDataFrame(rows, "part int, uri string, docs long, tokens long, start long"), dictionary


def read_tokens(files: DataFrame, dictionary: bytes, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 and, if asked for, ids: every document of the files, decoded."""
    held = files.sparkSession.sparkContext.broadcast(dictionary)
    n = max(1, files.count())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch["uri"].to_pylist(), batch["start"].to_pylist()):
                fs, at = open_file(uri)
                with fs.open_input_file(at) as source:
                    f = TokenFile(source, held.value)
                    for lo in range(0, len(f.index), 1024):
                        index = f.index[lo : lo + 1024]
                        ids = [f.ids(lo + i) for i in range(len(index))]
                        cols = {
                            id_col: pa.array([None if x == -(1 << 63) else int(x) for x in index[:, 0]], pa.int64()),
                            "start": pa.array(index[:, 1] + start, pa.int64()),
                            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                            "ids_crc32": pa.array([crc(x) for x in ids], pa.int64()),
                        }
                        if with_ids:
                            cols["ids"] = pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_pydict(cols)

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.select("part", "uri", "start").repartitionById(n, F.col("part") % n).mapInArrow(lean(decode), schema)
