"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line of the text, cut further after each pair of its words whose hash is a multiple of PIECE, so what
is inserted shifts no later cut; its digest also covers how often the same paragraph stood before it, so repeats don't cancel. Each digest goes into HASHES cells of the sketch; a cell
keeps a count, the exclusive-or of its digests and the sum of their check values. Two sketches of equal width subtract
cell by cell; peeling cells that hold one digest then gives the digests that only one version has. If peeling stops
early the sketches were too narrow, and both texts are sketched again at twice the width.

The fingerprint is the sketch of width CELLS with the paragraph count, in hex, so equal texts have equal fingerprints
and stored fingerprints can be subtracted later. Likeness is shared / all distinct paragraphs, from the recovered
differences alone: 1 for two empty texts.

Texts are range-partitioned by id once, each range also getting the first row of the next, so every document meets its
successor without a global sort in one task.

Defined results: null text is the empty text; null ids come before all others, equal ids are ordered by xxhash64 of the
text; a lone document is its own successor; repeated rows are each other's successors; texts of any length are sketched
whole; other columns of the input are not read, whatever their names; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .frames import lean

U = np.uint64
PIECE, CELLS, HASHES = 8, 24, 3
#: Documents whose sketches are built and peeled together.
ROWS = 256
#: A newline ends a paragraph; words are what stands between blanks.
_SEEDS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and paragraph digests of each text, in order."""
    data, offs = X.raw(texts)
    starts, ends, before = X.words(data, offs)
    if not len(starts):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, U)
    h = X.word_hashes(data, starts, ends)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    line = lines[starts]
    doc = np.repeat(np.arange(len(texts)), np.diff(before))
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])
    after = np.zeros(len(h), bool)
    after[2:] = (X.windows(h, 2)[:-1] % U(PIECE) == 0) & ~new[1:-1]
    cut = np.flatnonzero(new | after)
    # what stands between the words of a paragraph counts too, so hash its bytes
    last = np.append(cut[1:], len(starts)) - 1
    d = X.mix(X.word_hashes(data, starts[cut], ends[last]) ^ h[cut])
    own = doc[cut]
    order = np.lexsort((np.arange(len(d)), d, own))
    a, b = d[order], own[order]
    same = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
    head = np.flatnonzero(~same)
    times = np.empty(len(d), np.int64)
    times[order] = X.spread(np.diff(np.append(head, len(d))))
    d = X.mix(d + times.astype(U) * U(0xA0761D6478BD642F))
    return np.searchsorted(own, np.arange(len(texts) + 1)), d


class Sketches:
    """Sketches of several texts, of one width each: cells of text i are base[i] to base[i + 1]."""

    def __init__(self, offs: np.ndarray, d: np.ndarray, width: np.ndarray):
        n = len(offs) - 1
        self.base = np.concatenate([[0], np.cumsum(width)])
        row = np.repeat(np.arange(n), np.diff(offs))
        total = int(self.base[-1])
        self.width = width
        at = self.cells(d, row)
        self.count = np.bincount(at.ravel(), minlength=total).astype(np.int64)
        key, check = np.tile(d, HASHES), np.tile(X.mix(d ^ _SEEDS[0]), HASHES)
        self.key, self.check = np.zeros(total, U), np.zeros(total, U)
        order = np.argsort(at.ravel(), kind="stable")
        cell = at.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        if len(cell):
            self.key[cell[first]] = np.bitwise_xor.reduceat(key[order], first)
            self.check[cell[first]] = np.add.reduceat(check[order], first)

    def cells(self, d: np.ndarray, row: np.ndarray) -> np.ndarray:
        """HASHES different cells of each digest: one in each third of its sketch."""
        third = self.width[row] // HASHES
        return np.stack([self.base[row] + j * third + (X.mix(d * _SEEDS[j]) % third.astype(U)).astype(np.int64) for j in range(HASHES)])


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(only in a, only in b, recovered in full) for each pair of texts, by subtracting and peeling their sketches."""
    x, y = Sketches(*a, width), Sketches(*b, width)
    n = len(width)
    count, key, check = x.count - y.count, x.key ^ y.key, x.check - y.check
    only = np.zeros((2, n), np.int64)
    row_of = np.repeat(np.arange(n), width)
    live = np.flatnonzero(np.abs(count) == 1)
    for _ in range(200):
        one = live[np.abs(count[live]) == 1]
        sign = count[one]
        want = X.mix(key[one] ^ _SEEDS[0])
        one_ok = check[one] == np.where(sign > 0, want, U(0) - want)
        one, sign = one[one_ok], sign[one_ok]
        if not len(one):
            break
        row, d = row_of[one], key[one]
        # a digest may be alone in several of its cells
        pick = np.lexsort((d, row))
        row, d, sign = row[pick], d[pick], sign[pick]
        pick = np.concatenate([[True], (d[1:] != d[:-1]) | (row[1:] != row[:-1])])
        row, d, sign = row[pick], d[pick], sign[pick]
        only[0] += np.bincount(row[sign > 0], minlength=n)
        only[1] += np.bincount(row[sign < 0], minlength=n)
        at, c = x.cells(d, row), X.mix(d ^ _SEEDS[0])
        c = np.where(sign > 0, c, U(0) - c)
        for j in range(HASHES):
            np.subtract.at(count, at[j], sign)
            np.bitwise_xor.at(key, at[j], d)
            np.subtract.at(check, at[j], c)
        live = np.unique(at)
    left = (count != 0) | (key != 0)
    return only[0], only[1], np.bincount(row_of[left], minlength=n) == 0


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shared / all distinct paragraphs of each pair of texts, retrying wider sketches until every pair peels."""
    na, nb = np.diff(a[0]), np.diff(b[0])
    out = np.ones(len(na))
    todo = np.flatnonzero(na + nb > 0)
    # at least the difference of the counts has to come out
    width = np.maximum(CELLS, 2 * np.abs(na - nb))
    width += -width % HASHES
    while len(todo):
        only_a, only_b, done = differences(_take(a, todo), _take(b, todo), width[todo])
        shared = (na[todo] - only_a + nb[todo] - only_b) / 2
        full = shared + only_a + only_b
        out[todo[done]] = shared[done] / np.maximum(full[done], 1)
        todo = todo[~done]
        width[todo] *= 2
        for i in todo[width[todo] > 64 * (na + nb)[todo] + 64 * CELLS]:  # digests that collide never peel
            x, y = set(a[1][a[0][i] : a[0][i + 1]].tolist()), set(b[1][b[0][i] : b[0][i + 1]].tolist())
            out[i] = len(x & y) / len(x | y)
            todo = todo[todo != i]
    return np.clip(out, 0, 1)


def _take(a: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(rows) == len(a[0]) - 1:
        return a
    size = np.diff(a[0])[rows]
    return np.concatenate([[0], np.cumsum(size)]), a[1][X.runs(a[0][rows], size)]


def fingerprints(a: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The stored form: paragraphs (8 bytes), then CELLS counts (4), keys (8) and low check halves (4), in hex."""
    n = len(a[0]) - 1
    s = Sketches(*a, np.full(n, CELLS))
    out = np.zeros((n, 8 + CELLS * 16), np.uint8)
    out[:, :8] = np.diff(a[0]).astype("<i8").view(np.uint8).reshape(n, 8)
    out[:, 8 : 8 + 4 * CELLS] = s.count.astype("<i4").view(np.uint8).reshape(n, -1)
    out[:, 8 + 4 * CELLS : 8 + 12 * CELLS] = s.key.astype("<u8").view(np.uint8).reshape(n, -1)
    out[:, 8 + 12 * CELLS :] = (s.check & U(0xFFFFFFFF)).astype("<u4").view(np.uint8).reshape(n, -1)
    return [r.tobytes().hex() for r in out]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """(part, halo, id, given, th, text), sorted within partitions: each range of ids and, as halo, the row after it."""
    given = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = [i / parts for i in range(1, parts)]
    splits = sorted(set((src.agg(F.percentile_approx("id", share, 10_000)).first()[0] if share else None) or []))
    part = F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in splits]), lambda x: x < F.col("id"))) if splits else F.lit(0)
    src = src.withColumn("part", part)
    firsts = src.groupBy("part").agg(F.min("id").alias("id")).orderBy("part").collect()  # one row a range
    if not firsts:
        return src.withColumn("halo", F.lit(False))
    # the first id of each range also goes to the range before it, that of the first range to the last
    ids = [r["id"] for r in firsts]
    to = {ids[i]: firsts[i - 1]["part"] for i in range(len(ids))}
    table = F.create_map(*[x for k, v in to.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    rows = src.withColumn("to", F.explode(F.when(F.col("id").isin(ids), F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("h")), F.struct(F.try_element_at(table, F.col("id")).alias("p"), F.lit(True).alias("h")))).otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("h"))))))
    rows = rows.select(F.col("to.p").alias("part"), F.col("to.h").alias("halo"), "id", F.col("given").cast(given), "th", "text")
    return rows.repartitionById(len(splits) + 1, "part").sortWithinPartitions("part", "halo", "id", "th")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, id_col, text_col, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, last, halo = [], [], 0, None, None

        def flush() -> pa.RecordBatch:
            """All rows held but the last, which waits for its successor."""
            own, nxt = texts[:-1], texts[1:]
            made = [edited(a, b) for a, b in zip(own, nxt)]
            # each text is digested once; a text is the next of the one before it
            d = digests(pa.array(texts, pa.large_string()))
            e = digests(pa.array(made, pa.large_string()))
            n = len(own)
            a, b = _take(d, np.arange(n)), _take(d, np.arange(1, n + 1))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:-1], kind),
                    pa.array([len(t) for t in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in made]),
                    pa.array(fingerprints(a)),
                    pa.array(fingerprints(e)),
                    pa.array(likeness(a, e)),
                    pa.array(likeness(a, b)),
                ],
                names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        kind = pa.int64()
        for batch in batches:
            kind = batch["given"].type
            for p, h, i, t in zip(batch["part"].to_pylist(), batch["halo"].to_pylist(), batch["given"].to_pylist(), batch["text"].to_pylist()):
                if h and halo == p:
                    continue  # repeated rows: only the first follows the range
                halo = p if h else halo
                ids.append(i)
                texts.append(t)
                size += len(t)
                if h:
                    yield flush()
                    ids, texts, size = [], [], 0
                elif len(texts) > ROWS or (size > 1 << 21 and len(texts) > 1):
                    yield flush()
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    given = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {given}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(lean(run), schema)
