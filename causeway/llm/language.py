"""Language identification by nearest centroid.

A text is a TF-IDF vector of its byte trigrams (letters only: A-Z lower-cased, every run of other ASCII is one blank),
hashed to DIMS places and normalised. Document frequencies come from all training rows. Each language gets a few
centroids by spherical k-means on a bounded sample of its rows; a text takes the language of the centroid with the
largest cosine. A cosine under the language's own threshold (a low quantile of its sample) rejects the prediction: the
prediction stays, `rejected` says so, and the score, which is the winner's share of the languages' best cosines, is
halved.

What is broadcast is languages x centroids x DIMS floats: languages over MOST_LANGUAGES are an error, not a broadcast.

Learning reads the texts twice: once for document frequencies and the number of rows of each language, once for the
samples of all languages together, whose centroids are found where each language's sample meets.

Defined results: `und` and score 0 for null texts, texts without a letter, or if nothing could be learnt; rows without a
language are never learnt from; equal texts get equal results, and ties go to the language that sorts first; texts of any
length are read whole; a table without rows gives none; columns named lang_pred, score and rejected are replaced, all
others kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .frames import lean, sampled_groups

DIMS, CENTROIDS, ROUNDS = 4096, 4, 8
#: Rows of each language that its centroids are fitted on, at most, and languages.
SAMPLE, MOST_LANGUAGES = 400, 400
#: Texts whose vectors are held at once.
ROWS = 128
_FOLD = np.full(256, 32, np.uint32)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def counts(texts: pa.Array) -> np.ndarray:
    """Trigram counts, one row of DIMS a text."""
    data, offs = X.raw(texts)
    n = len(texts)
    b = _FOLD[data]
    if len(b) < 3:
        return np.zeros((n, DIMS), np.float32)
    gram = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    # runs of blanks count nowhere
    keep = ~((b[1:-1] == 32) & ((b[:-2] == 32) | (b[2:] == 32)))
    size = np.maximum(np.diff(offs) - 2, 0)
    at = X.runs(offs[:-1], size)
    row = np.repeat(np.arange(n), size)
    at, row = at[keep[at]], row[keep[at]]
    place = (gram[at] * np.uint32(0x9E3779B1)) >> np.uint32(20)
    return np.bincount(row * DIMS + place, minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(texts)) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.maximum(norm, 1e-12)


def _pieces(texts: pa.Array):
    """Runs of at most ROWS texts and about half a megabyte."""
    for lo, hi in X.slices(texts):
        for a in range(lo, hi, ROWS):
            yield a, min(hi, a + ROWS)


def kmeans(v: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    rng = np.random.default_rng(seed)
    c = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(axis=1)
        c = np.stack([v[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, least: np.ndarray):
        self.langs, self.idf, self.centroids, self.owner, self.least = langs, idf.astype(np.float32), centroids.astype(np.float32), owner, least

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score, rejected."""
        if not self.langs:
            n = len(texts)
            return np.zeros(n, int), np.zeros(n), np.ones(n, bool)
        cos = np.clip(vectors(texts, self.idf) @ self.centroids.T, 0, 1)
        best = np.stack([cos[:, self.owner == j].max(axis=1) for j in range(len(self.langs))], axis=1).astype(np.float64)
        top = best.argmax(axis=1)
        cosine = best[np.arange(len(top)), top]
        rejected = cosine < self.least[top]
        share = cosine / np.maximum(best.sum(axis=1), 1e-12)
        return top, np.where(rejected, share / 2, share), rejected


def fit(rows: DataFrame) -> Model:
    """Learn from (id, text, lang)."""
    rows = rows.where("lang is not null and text is not null")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), Counter()
        for batch in batches:
            texts = X.texts_of(batch["text"])
            n.update(batch["lang"].to_pylist())
            for lo, hi in _pieces(texts):
                total += (counts(texts[lo:hi]) > 0).sum(axis=0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"d": pa.array([*some.tolist(), *[DIMS] * len(n)], pa.int32()), "lang": pa.array([*[None] * len(some), *n], pa.string()), "n": pa.array([*total[some].tolist(), *n.values()], pa.int64())}
        )

    found = rows.select("text", "lang").mapInArrow(lean(frequency), "d int, lang string, n long").groupBy("d", "lang").agg(F.sum("n").alias("n"))
    df, sizes = np.zeros(DIMS), {}
    for r in found.limit(DIMS + MOST_LANGUAGES + 1).collect():
        if r["d"] < DIMS:
            df[r["d"]] = r["n"]
        else:
            sizes[r["lang"]] = r["n"]
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: raise the bound knowingly, the centroids are broadcast")
    idf = (np.log((sum(sizes.values()) + 1) / (df + 1)) + 0.05).astype(np.float32)

    def centroids(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cw_h", "ascending"), ("text", "ascending")])
        texts = X.texts_of(t["text"])
        v = np.concatenate([vectors(texts[lo:hi], idf).astype(np.float16) for lo, hi in _pieces(texts)]).astype(np.float32)
        c = kmeans(v, CENTROIDS).astype(np.float32)
        least = float(np.quantile((v @ c.T).max(axis=1), 0.01)) * 0.7
        return pa.table({"lang": t["lang"][:1], "c": pa.array([c.tobytes()], pa.binary()), "least": pa.array([least])})

    picked = sampled_groups(rows, F.struct("id", "text"), "lang", sizes, SAMPLE).select("lang", "text", "cw_h")
    learnt = sorted(picked.groupBy("lang").applyInArrow(centroids, "lang string, c binary, least double").collect())  # a row a language
    blocks = [np.frombuffer(r["c"], np.float32).reshape(-1, DIMS) for r in learnt]
    owner = [j for j, c in enumerate(blocks) for _ in c]
    return Model([r["lang"] for r in learnt], idf, np.concatenate(blocks) if blocks else np.zeros((0, DIMS)), np.array(owner, int), np.array([r["least"] for r in learnt]))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs and lang_pred, score, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.drop("lang_pred", "score", "rejected")
    place = src.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            texts = X.texts_of(batch.column(place))
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in _pieces(texts):
                top, s, rejected = m.predict(texts[lo:hi])
                und = ~letters[lo:hi] if m.langs else np.ones(hi - lo, bool)
                pred = np.where(und, len(m.langs), top)
                cols = [c[lo:hi] for c in batch.columns]
                cols += [pa.array(names[pred].tolist(), pa.string()), pa.array(np.where(und, 0.0, s), pa.float64()), pa.array(und | rejected)]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = T.StructType(list(src.schema.fields)).add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("rejected", T.BooleanType())
    return src.mapInArrow(lean(run), schema)
