"""The pipeline's stages, each on what its predecessor kept, and the whole of it."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from causeway.llm import queries

from .conftest import SCHEMA, sentence
from .test_ops import base_spans, brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables: good and junk documents, copies, contaminated and private ones, nulls and repeated rows."""
    rng = random.Random(3)
    texts = [sentence(rng, rng.randrange(20, 60), 3000) + "." for _ in range(150)]
    item = sentence(rng, 30, 3000)
    texts += [sentence(rng, 20, 3000) + " " + item for _ in range(5)]
    texts += [texts[1], texts[2] + " more", texts[3]]
    texts += [f"{sentence(rng, 25, 3000)} write to me{i}@mail.example.org now" for i in range(5)]
    good = len(texts)
    texts += [" ".join(w + "!!" for w in sentence(rng, 30, 50).upper().split()) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t), "b", i) for i, t in enumerate(texts)]
    rows += [(1000, None, None, None, None, None, None), (1001, "", None, None, 0, None, None), rows[7], (None, texts[9] + " and no id", "en", "s", 1, "b", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < good), 0) for i in range(len(texts)) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, good


def test_stages(spark, folder):
    path, rows, good = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = P.quality_classifier(spark, docs, path)
    assert kept.columns == columns
    ids = {r["doc_id"] for r in kept.collect()}
    junk = set(range(good, good + 60))
    assert not ids & junk and set(range(good)) <= ids
    table = [tuple(r) for r in kept.collect()]
    one = P.ngram_jaccard_join(spark, spark.createDataFrame(table, docs.schema), path)
    comp = brute_components(table, P.WORDS, P.NUM, P.DEN)
    want = Counter(k[0] for k in comp.elements() if k[0] is None or k[2] is None or k[2] >= k[0])
    assert one.columns == columns and Counter(r["doc_id"] for r in one.collect()) == want
    clean = P.benchmark_decontamination(spark, one, path)
    gone = {r["doc_id"] for r in one.collect()} - {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns and gone == set(range(150, 155))
    private = P.personal_data(spark, clean, path)
    assert private.columns == columns and private.count() == clean.count()
    for r in private.where("text is not null").collect():
        assert not [s for s in base_spans(r["text"]) if s[0] == "email"] and r["n_chars"] == len(r["text"])
    assert private.where(F.col("text").contains("<email>")).count() == 5
    packed = P.pack(spark, private, path)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= P.WINDOW
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in private.collect()}


def test_run_chains_the_stages(spark, folder):
    path, _, _ = folder
    whole = P.run(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, path)
    key = lambda df: Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in df.collect())
    a, b = key(whole), key(docs)
    assert sum(a.values()) and Counter(k[0] for k in a.elements()) == Counter(k[0] for k in b.elements())


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(entry.oracle_sql())
