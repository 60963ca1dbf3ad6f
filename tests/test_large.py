"""Documents beyond what one task walks give the same rows as small ones; deep histories need no job a level."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from causeway.functions.frames import grouped
from causeway.operators import graph, hydrate
from causeway.plans import further, queries  # noqa: F401  further adds its queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are missing")


def result(spark, name):
    return Counter(str(r) for r in queries.QUERIES[name](spark, SF).collect())


@pytest.mark.parametrize("name", ["graph_ancestors", "graph_levels", "object_paths"])
def test_large_documents(spark, monkeypatch, name):
    want = result(spark, name)
    monkeypatch.setattr(graph, "LARGE", 100)
    monkeypatch.setattr(hydrate, "LARGE", 12)
    assert result(spark, name) == want and want


def test_a_chain_of_a_hundred_thousand_changes(spark):
    h = lambda c: F.unhex(F.sha2(c.cast("string"), 256))
    n = 100_000
    c = spark.range(n).select(F.lit("d").alias("doc"), h(F.col("id")).alias("hash"), F.col("id"), F.when(F.col("id") > 0, F.array(h(F.col("id") - 1))).otherwise(F.array().cast("array<binary>")).alias("deps"))
    c = c.withColumns({"actor": F.lit(b"\x01"), "seq": F.col("id") + 1, "max_op": 2 * F.col("id") + 2})
    last = c.where(F.col("id") == n - 1)
    assert graph.ancestors(c, last).count() == n
    clock = graph.clock_at(c, last).collect()
    assert [(r["max_op"], r["seq"]) for r in clock] == [(2 * n, n)]
    assert graph.levels(c).agg(F.max("level")).first()[0] == n - 1


def test_grouped_keeps_groups_whole_over_batches(spark):
    import pyarrow as pa

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).select((F.col("id") % 11).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("j"), F.col("id").alias("v"))
        one = lambda t: pa.table({"k": t["k"][:1], "n": pa.array([len(t)], pa.int64()), "s": pa.array([sum(t["v"].to_pylist())], pa.int64())})
        got = grouped(df, ["k", "j"], one, "k long, n long, s long").collect()
        want = df.groupBy("k", "j").agg(F.count("*").alias("n"), F.sum("v").alias("s")).select("k", "n", "s").collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, want))
        assert grouped(df.limit(0), ["k"], one, "k long, n long, s long").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
