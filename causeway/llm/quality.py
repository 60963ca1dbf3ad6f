"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams of the whole text: hashed runs of three bytes (digits as one digit), and runs of six
words in which each word is told only by how far back the same word stood (one, two, three words, or further), which is
what repetition looks like in any language. Their class log-count ratios come from all labelled training rows; a linear hinge-loss model on the scaled,
length-normalised indicators is then fitted by dual coordinate descent on a bounded sample of labelled rows, and its
margin becomes a probability by logistic regression on rows that the fit didn't see. The sample is bounded in rows (SAMPLE)
and in bytes of features (SAMPLE_BYTES), as the driver holds it; learning reads the training rows twice.

Everything but that sample covers all data. Counts are summed as blocks of the feature table; the model has a fixed size
of SIZE floats, which bounds what is broadcast.

Defined results: null text is the empty text, which has no features and gets the score of the bias alone; a label that
isn't 0 or 1 is left out; several labels of one id count as 1 if at least half of them are; if only one class is
labelled, or none, every score is that class's share (0.5 without labels); equal texts get equal scores; texts of any
length are read whole; a table without rows gives none; a column of the score's name is replaced, all others kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .frames import lean, sampled_groups

U = np.uint64
BITS = 17
#: Labelled rows that the support vectors are fitted on, at most, and the share of them kept for calibration.
SAMPLE, CALIBRATE = 8_000, 0.25
#: Their features, 4 bytes each, half of it for either class.
SAMPLE_BYTES = 128 << 20
#: Labels whose ids may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
BLOCK = 1 << 12
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[48:58] = 48


#: Words of a repetition n-gram; each takes two bits.
REPEAT = 6
SIZE = (1 << BITS) + (1 << 2 * REPEAT)


def repeats(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repetition n-grams of each run of REPEAT words within one text, and the number of runs before each text."""
    starts, ends, before = X.words(data, offs)
    h = X.word_hashes(data, starts, ends)
    first = np.repeat(before[:-1], np.diff(before))
    at = np.arange(len(h))
    code = np.zeros(len(h), np.int64)
    for back in (3, 2, 1):
        same = np.zeros(len(h), bool)
        same[back:] = (h[back:] == h[:-back]) & (at[back:] - back >= first[back:])
        code[same] = back
    n = np.maximum(np.diff(before) - REPEAT + 1, 0)
    gram = np.zeros(max(0, len(h) - REPEAT + 1), np.int64)
    for k in range(REPEAT if len(gram) else 0):
        gram |= code[k : k + len(gram)] << 2 * k
    return gram[X.runs(before[:-1], n)], np.concatenate([[0], np.cumsum(n)])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and, sorted within each text, the distinct features of the texts."""
    data, offs = X.raw(texts)
    n = len(texts)
    b = _FOLD[data]
    if len(b) < 3:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    gram = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    h = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    size = np.maximum(np.diff(offs) - 2, 0)
    seen = np.zeros(1 << BITS, bool)
    gram, runs = repeats(data, offs)
    out, total = [], np.zeros(n + 1, np.int64)
    for i, (lo, k) in enumerate(zip(offs[:-1].tolist(), size.tolist())):
        own = h[lo : lo + k]
        if k > 4096:
            seen[own] = True
            own = np.flatnonzero(seen)
            seen[own] = False
        else:
            own = np.unique(own)
        own = np.concatenate([own, np.unique(gram[runs[i] : runs[i + 1]]) + (1 << BITS)])
        out.append(own)
        total[i + 1] = len(own)
    return np.cumsum(total), np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def margins(self, offs: np.ndarray, feats: np.ndarray) -> np.ndarray:
        n = np.diff(offs)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[feats], dtype=np.float64)])
        return (sums[offs[1:]] - sums[offs[:-1]]) / np.sqrt(np.maximum(n, 1)) + self.bias

    def scores(self, offs: np.ndarray, feats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(offs, feats) + self.b, -30, 30)))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM on scale * indicator / sqrt(number of indicators)."""
    w, bias = np.zeros(len(scale)), 0.0
    values = [scale[r] / math.sqrt(max(1, len(r))) for r in rows]
    q = np.array([v @ v + 1 for v in values])
    # the rarer class weighs as much as the other
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    cost = c * np.where(y > 0, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9))
    alpha, order, rng = np.zeros(len(rows)), np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and intercept by Newton steps on smoothed targets; the slope isn't negative."""
    up = (y > 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (len(y) - up + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def training_rows(docs: DataFrame, labels: DataFrame, keep: Column | None, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, y) of the labelled documents that may be learnt from."""
    votes = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    votes = votes.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    own = docs if keep is None else docs.where(keep)
    own = own.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if labels.count() <= BROADCAST_ROWS:
        votes = F.broadcast(votes)
    return own.join(votes, "id")


def fit(rows: DataFrame) -> Model:
    """Learn from (id, text, y)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, SIZE), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            texts, y = X.texts_of(batch["text"]), batch["y"].to_numpy(zero_copy_only=False)
            for lo, hi in X.slices(texts):
                offs, feats = features(texts[lo:hi])
                own = np.repeat(y[lo:hi], np.diff(offs))
                for k in (0, 1):
                    total[k] += np.bincount(feats[own == k], minlength=SIZE)
                n += np.bincount(y[lo:hi], minlength=2)
        for at in range(0, SIZE, BLOCK):
            part = total[:, at : at + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "blob": pa.array([part.astype("<i8").tobytes()], pa.binary())})
        yield pa.RecordBatch.from_pydict({"block": pa.array([-1], pa.int32()), "blob": pa.array([n.astype("<i8").tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), "<i8") for b in t["blob"])
        return pa.table({"block": t["block"][:1], "blob": pa.array([total.tobytes()], pa.binary())})

    counts, n = np.zeros((2, SIZE)), np.zeros(2)
    for r in rows.select("text", "y").mapInArrow(lean(count), "block int, blob binary").groupBy("block").applyInArrow(add, "block int, blob binary").toLocalIterator():
        v = np.frombuffer(r["blob"], "<i8")
        if r["block"] < 0:
            n = v.astype(float)
        else:
            counts[:, r["block"] : r["block"] + BLOCK] = v.reshape(2, -1)
    if n.min() == 0:
        share = float(n[1] / n.sum()) if n.sum() else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SIZE, np.float32), 0.0, 0.0, math.log(share / (1 - share)))
    # smoothed shares of each class's documents that have the feature
    ratio = np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2))
    # both classes are sampled, by the hash of the id

    def indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = X.texts_of(batch["text"])
            for lo, hi in X.slices(texts):
                offs, feats = features(texts[lo:hi])
                blobs = [feats[a:b].astype("<u4").tobytes() for a, b in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), batch["y"][lo:hi], batch["h"][lo:hi]], names=["f", "y", "h"])

    picked = sampled_groups(rows, F.col("id"), "y", {k: int(n[k]) for k in (0, 1)}, SAMPLE // 2).select("text", "y", F.col("cw_h").alias("h"))
    marked = picked.mapInArrow(lean(indicators), "f binary, y int, h long")
    room = F.sum(F.octet_length("f")).over(Window.partitionBy("y").orderBy("h", "f").rowsBetween(Window.unboundedPreceding, 0))
    got = marked.withColumn("room", room).where(F.col("room") <= SAMPLE_BYTES // 2).select("f", "y", "h").collect()  # at most SAMPLE rows and SAMPLE_BYTES
    got.sort(key=lambda r: (r["h"], r["y"], bytes(r["f"])))
    feats, y = [np.frombuffer(r["f"], "<u4").astype(np.int64) for r in got], np.array([2 * r["y"] - 1 for r in got])
    step = round(1 / CALIBRATE)
    hold = np.arange(len(y)) % step == 0
    if len(set(y[hold].tolist())) < 2 or len(set(y[~hold].tolist())) < 2:
        hold = np.zeros(len(y), bool)
    train = np.flatnonzero(~hold)
    w, bias = dual_descent([feats[i] for i in train], y[train], ratio)
    weights = (w * ratio).astype(np.float32)
    model = Model(weights, bias, 1.0, 0.0)
    check = np.flatnonzero(hold) if hold.any() else train
    offs = np.concatenate([[0], np.cumsum([len(feats[i]) for i in check])])
    m = model.margins(offs, np.concatenate([feats[i] for i in check]))
    a, b = platt(m, y[check])
    # the sample has its own share of each class; the intercept goes back to the share of all labelled rows
    s = (y[check] > 0).mean()
    b += math.log(n[1] / n[0]) - math.log(s / (1 - s))
    return Model(weights, bias, a, b)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs and the score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.drop(name)
    place = src.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = X.texts_of(batch.column(place))
            s = [m.scores(*features(texts[lo:hi])) for lo, hi in X.slices(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(s) if s else np.zeros(0), pa.float64())], names=[*batch.schema.names, name])

    return src.mapInArrow(lean(run), T.StructType(list(src.schema.fields)).add(name, T.DoubleType()))
