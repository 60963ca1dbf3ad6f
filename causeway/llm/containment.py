"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows of benchmark items.

A window is k consecutive words of an item; an item of fewer words is one window. A document contains a window only if
it contains all its words, so one word is a necessary prefix: the rarest over all documents. The join looks up each
document word among those prefix words, the word's place in the window gives the only place where the window could
begin (positional bound), which must lie in the document with room for the window (length bound), and the words there
are compared exactly.

The items are read in blocks of about BLOCK_BYTES of text (a longer item is a block of its own), each of which becomes
flat arrays on the driver, is broadcast, and is released before the next. One pass over the documents counts the words of
all blocks, if those are at most VOCABULARY; else each block's are counted in a pass of their own. With one block the
document side is never shuffled; with more, each block writes what it finds by the digest of the text, and those rows are
joined to the documents.

Defined results: null text has no words, so it is never contaminated; items with a null id or without words are left
out; repeated items count once; repeated documents get equal rows; texts of any length are scanned whole; a table without
rows gives none, and without items nothing is contaminated; columns named n_words, n_hit, items and contaminated are
replaced, all others kept.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .frames import lean, written

U = np.uint64
#: Text of the items that one broadcast may hold.
BLOCK_BYTES = 8 << 20
#: Distinct words of all blocks that are counted in one pass (8 bytes each, broadcast).
VOCABULARY = 4 << 20


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, lower-cased, and words before each text."""
    data, offs = X.raw(texts)
    data = X.LOWER[data]
    starts, ends, before = X.words(data, offs, X.ALNUM)
    return X.word_hashes(data, starts, ends), before


class Windows:
    """The windows of a block of items, with the items that each stands in, as flat arrays."""

    def __init__(self, rows: list[tuple[str, str]], k: int):
        self.names = np.array(sorted({i for i, _ in rows}), object)
        number = {x: j for j, x in enumerate(self.names.tolist())}
        h, before = _words(X.texts_of(pa.array([t for _, t in rows], pa.string())))
        size = np.diff(before)
        many = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))
        start = X.runs(before[:-1], many)
        length = np.repeat(np.minimum(size, k), many)
        item = np.repeat(np.array([number[i] for i, _ in rows], np.int64), many)
        # equal windows become one: sorted by their hash, then compared word by word
        key = np.zeros(len(start), U)
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            key[own] = X.mix(X.windows(h, n)[start[own]] ^ U(n))
        order = np.argsort(key, kind="stable")
        start, length, item, key = start[order], length[order], item[order], key[order]
        new = np.ones(len(start), bool)
        new[1:] = (key[1:] != key[:-1]) | (length[1:] != length[:-1])
        for j in range(k):
            same = np.flatnonzero(~new & (length > j))
            new[same[h[start[same] + j] != h[start[same - 1] + j]]] = True
        first = np.flatnonzero(new)
        self.words, self.start, self.length = h, start[first], length[first]
        pairs = np.unique(np.stack([np.cumsum(new) - 1, item]), axis=1) if len(start) else np.zeros((2, 0), np.int64)
        self.item, self.item_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(first) + 1))
        self.vocabulary = np.unique(h)

    def index(self, vocabulary: np.ndarray, counts: np.ndarray) -> None:
        """Choose each window's prefix word by the counts of a vocabulary that holds the block's; windows with a word of no
        document go."""
        place = np.searchsorted(vocabulary, self.words)
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.lexsort((vocabulary, counts))] = np.arange(len(vocabulary))
        rank, lost = rank[place], counts[place] == 0
        best, offset = np.full(len(self.start), len(vocabulary), np.int64), np.zeros(len(self.start), np.int64)
        live = np.ones(len(self.start), bool)
        for j in range(int(self.length.max()) if len(self.length) else 0):
            own = np.flatnonzero(self.length > j)
            at = self.start[own] + j
            live[own] &= ~lost[at]
            less = rank[at] < best[own]
            best[own[less]], offset[own[less]] = rank[at[less]], j
        window = np.flatnonzero(live)
        token = self.words[self.start[window] + offset[window]]
        order = np.argsort(token, kind="stable")
        self.window, self.offset = window[order], offset[window[order]]
        self.tokens, first = np.unique(token[order], return_index=True)
        self.first = np.append(first, len(order))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.tokens >> U(44)).astype(np.int64)] = True

    def items_of(self, doc: np.ndarray, window: np.ndarray, n: int) -> list[list[str]]:
        """The sorted items of the windows found in each of n documents."""
        both = np.unique(np.stack([doc, window]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
        many = self.item_at[both[1] + 1] - self.item_at[both[1]]
        item = self.item[X.runs(self.item_at[both[1]], many)]
        both = np.unique(np.stack([np.repeat(both[0], many), item]), axis=1) if len(item) else np.zeros((2, 0), np.int64)
        edge = np.searchsorted(both[0], np.arange(n + 1))
        names = self.names[both[1]].tolist()  # sorted, as items are numbered in the order of their names
        return [names[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def find(self, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of all occurrences in the texts whose words are h."""
        if not len(self.window):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.sieve[(h >> U(44)).astype(np.int64)])
        t = np.minimum(np.searchsorted(self.tokens, h[at]), len(self.tokens) - 1)
        own = self.tokens[t] == h[at]
        at, t = at[own], t[own]
        many = self.first[t + 1] - self.first[t]
        e = X.runs(self.first[t], many)
        at = np.repeat(at, many)
        win, start = self.window[e], at - self.offset[e]
        doc = np.searchsorted(before, at, side="right") - 1
        fits = (start >= before[doc]) & (start + self.length[win] <= before[doc + 1])
        win, start = win[fits], start[fits]
        good, length = np.ones(len(win), bool), self.length[win]
        for j in range(int(length.max()) if len(length) else 0):
            left = np.flatnonzero(good & (j < length))
            good[left] = h[start[left] + j] == self.words[self.start[win[left]] + j]
        return start[good], win[good]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(i, t, b) of the items that count, and the number of blocks b; repeated rows are one."""
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = 1 + size // BLOCK_BYTES
    return rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n))), n


def _windows(rows: DataFrame, b: int, k: int) -> Windows:
    return Windows(sorted((r["i"], r["t"]) for r in rows.where(F.col("b") == b).toLocalIterator()), k)


def _counts(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the vocabulary stands in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        total = np.zeros(len(v), np.int64)
        sieve = np.zeros(1 << 20, bool)
        sieve[(v >> U(44)).astype(np.int64)] = True
        for batch in batches:
            texts = X.texts_of(batch[0])
            for lo, hi in X.slices(texts):
                h, _ = _words(texts[lo:hi])
                h = h[sieve[(h >> U(44)).astype(np.int64)]]
                i = np.minimum(np.searchsorted(v, h), len(v) - 1)
                total += np.bincount(i[v[i] == h], minlength=len(v))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    out = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        for r in docs.select(text_col).mapInArrow(lean(count), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
            out[r["word"]] = r["n"]
    return out


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 13, share: int = 20
) -> DataFrame:
    """All columns of docs and n_words, n_hit, items (sorted), contaminated: n_hit > 0 and share * n_hit >= n_words."""
    rows, n = _blocks(items, item_col, item_text)
    src = docs.drop("n_words", "n_hit", "items", "contaminated")
    place = src.columns.index(text_col)
    if n > 1:
        return _many(src, written(rows, "items"), n, text_col, share, k)
    block = _windows(rows, 0, k)
    block.index(block.vocabulary, _counts(docs, text_col, block.vocabulary))
    held = docs.sparkSession.sparkContext.broadcast(block)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = held.value
        for batch in batches:
            texts = X.texts_of(batch.column(place))
            for lo, hi in X.slices(texts):
                h, before = _words(texts[lo:hi])
                start, w = win.find(h, before)
                cover = np.zeros(len(h) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + win.length[w], -1)
                sums = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
                n, hit = np.diff(before), np.diff(sums[before])
                doc = np.searchsorted(before, start, side="right") - 1
                lists = win.items_of(doc, w, hi - lo)
                cols = [c[lo:hi] for c in batch.columns]
                cols += [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(lists, pa.list_(pa.string())), pa.array((hit > 0) & (share * hit >= n))]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "n_words", "n_hit", "items", "contaminated"])

    return src.mapInArrow(lean(judge), _schema(src))


def _schema(src: DataFrame):
    from pyspark.sql import types as T

    out = T.StructType(list(src.schema.fields))
    return out.add("n_words", T.LongType()).add("n_hit", T.LongType()).add("items", T.ArrayType(T.StringType())).add("contaminated", T.BooleanType())


def _many(src: DataFrame, rows: DataFrame, n: int, text_col: str, share: int, k: int) -> DataFrame:
    """The same for several blocks, one after the other."""
    spark, frames = src.sparkSession, []
    texts = src.select(F.sha2(F.col(f"`{text_col}`"), 256).alias("key"), F.col(f"`{text_col}`").alias("text"))
    every = np.zeros(0, U)
    for b in range(n):
        every = np.union1d(every, _windows(rows, b, k).vocabulary)
        if len(every) > VOCABULARY:
            break
    counts = _counts(texts, "text", every) if len(every) <= VOCABULARY else None
    for b in range(n):
        block = _windows(rows, b, k)
        if counts is None:
            block.index(block.vocabulary, _counts(texts, "text", block.vocabulary))
        else:
            block.index(every, counts)
        held = spark.sparkContext.broadcast(block)

        def add(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            win = held.value
            for batch in batches:
                found = X.texts_of(batch["text"])
                for lo, hi in X.slices(found):
                    h, before = _words(found[lo:hi])
                    start, w = win.find(h, before)
                    doc = np.searchsorted(before, start, side="right") - 1
                    ranges: list[list[dict]] = [[] for _ in range(hi - lo)]
                    for d, s, size in zip(doc.tolist(), (start - before[doc]).tolist(), win.length[w].tolist()):
                        ranges[d].append({"lo": s, "hi": s + size})
                    some = np.unique(doc)
                    lists = win.items_of(doc, w, hi - lo)
                    cols = [batch["key"][lo:hi].take(pa.array(some)), pa.array([ranges[d] for d in some], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array([lists[d] for d in some], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "ranges", "items"])

        hits = texts.where("text is not null").mapInArrow(lean(add), "key string, ranges array<struct<lo:long,hi:long>>, items array<string>")
        frames.append(written(hits.groupBy("key").agg(F.first("ranges").alias("ranges"), F.first("items").alias("items")), "hits"))
        held.destroy()  # its hits are written
    hits = frames[0]
    for f in frames[1:]:
        hits = hits.unionByName(f)
    ranges, found_items, key, other = (f"{x}_{uuid.uuid4().hex}" for x in ("ranges", "items", "key", "other"))  # no column of docs has these names
    hits = hits.groupBy(F.col("key").alias(other)).agg(F.array_sort(F.flatten(F.collect_list("ranges"))).alias(ranges), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(found_items))
    place = src.columns.index(text_col)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = X.texts_of(batch.column(place))
            n = [np.diff(_words(found[lo:hi])[1]) for lo, hi in X.slices(found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())], names=[*batch.schema.names, "n_words"])

    from pyspark.sql import types as T

    counted = src.mapInArrow(lean(sized), T.StructType(list(src.schema.fields)).add("n_words", T.LongType()))
    out = counted.withColumn(key, F.sha2(F.col(f"`{text_col}`"), 256)).join(hits, F.col(key) == F.col(other), "left")
    hit = F.expr(
        f"aggregate({ranges}, named_struct('n', 0L, 'at', 0L), (s, r) -> named_struct("
        "'n', s.n + greatest(0L, r.hi - greatest(r.lo, s.at)), 'at', greatest(s.at, r.hi)), s -> s.n)"
    )
    out = out.withColumn("n_hit", F.coalesce(hit, F.lit(0).cast("long"))).withColumn("items", F.coalesce(found_items, F.array().cast("array<string>")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).drop(ranges, found_items, key, other)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
