"""Stores, expanded changes, list helpers and the driver contract."""

import json

import pytest
from pyspark.sql import functions as F

from causeway.functions import lists as L
from causeway.functions.schema import parse_cursor, parse_id, show_cursor, show_id, text_width
from causeway.operators import graph, hydrate, merge
from causeway.operators.transaction import Draft, frames
from causeway.sources import store

from .test_engine import ROOT, replicas


@pytest.fixture(scope="module")
def log(spark):
    changes, ops, _, _ = replicas(11)
    c, o = frames(spark, changes, ops)
    return c.cache(), o.cache()


def text_of(ops):
    return hydrate.to_json(ops).first()["json"]


def test_store_round_trip(spark, log, tmp_path):
    c, o = log
    path = str(tmp_path / "s")
    store.save_and_verify(c, o, path)
    c2, o2 = store.load(spark, path)
    assert text_of(o2) == text_of(o)
    # increments
    early = c.where("seq = 1")
    part = str(tmp_path / "p")
    some, _ = merge.apply_changes(early.limit(0), early)
    store.save(some, store.bundle_ops(some, o), part)
    n = store.append(c, o, part)
    assert n == c.count() - some.count() and store.append(c, o, part) == 0
    assert text_of(store.load(spark, part)[1]) == text_of(o)
    # a write that failed before its changes leaves nothing that is read
    half = str(tmp_path / "h")
    store.save(some, store.bundle_ops(some, o), half)
    o.withColumn("batch", F.lit("000000001-lost")).write.mode("append").partitionBy("batch").parquet(half + "/ops")
    assert store.load(spark, half)[1].count() == store.bundle_ops(some, o).count()
    store.append(c, o, half)
    assert text_of(store.load(spark, half)[1]) == text_of(o) and store.load(spark, half)[1].count() == o.count()
    # another head
    last = spark.read.parquet(path + "/heads").first()["batch"]
    spark.createDataFrame([("d", b"x", last)], "doc string, hash binary, batch string").write.mode("overwrite").partitionBy("batch").parquet(path + "/heads")
    with pytest.raises(ValueError, match="heads"):
        store.load(spark, path)
    assert store.load(spark, path, store.Options(verify=False))[0].count() == c.count()


def test_orphans_wait_or_stay_behind(spark, log, tmp_path):
    c, o = log
    first = graph.levels(c).where("level = 1").orderBy("hash").first()["hash"]
    rest = c.where(F.col("hash") != F.lit(first))
    store.save(rest, o, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="missing"):
        store.load(spark, str(tmp_path / "a"))
    kept, _ = store.load(spark, str(tmp_path / "a"), store.Options(partial="ignore"))
    gone = graph.dependents(c, c.where(F.col("hash") == F.lit(first)))
    assert kept.count() == c.count() - gone.count()
    store.save(rest, o, str(tmp_path / "b"), store.Options(orphans=False))
    assert spark.read.parquet(str(tmp_path / "b/changes")).count() == kept.count()


def test_bundles_and_save_after(log):
    c, o = log
    half = c.where("seq <= 2")
    a, ops = store.bundle(c, o, half)
    assert a.count() == half.count()
    closed, _ = merge.apply_changes(half.limit(0), half)
    rest, more = store.save_after(c, o, graph.heads(closed))
    assert rest.count() == c.count() - closed.count()
    assert store.bundle_ops(closed, o).count() + more.count() == o.count()


def test_expanded_changes(log):
    c, o = log
    e = store.expanded(c, o)
    c2, o2 = store.from_expanded(e)
    assert merge.differing(c.drop("extra"), c2.drop("extra")).count() == 0
    assert text_of(o2) == text_of(o)
    assert json.loads(e.first()["json"])["seq"] >= 1


def test_strings_become_texts(spark):
    d = Draft([], b"\x01", "d")
    d.put(ROOT, "a", "hé")
    d.put(ROOT, "b", "")
    d.put(ROOT, "c", 1)
    _, odf = frames(spark, [], d.pending)
    out = odf.unionByName(store.strings_to_text(odf))
    assert json.loads(text_of(out)) == {"a": "hé", "b": "", "c": 1}
    assert {r["action"] for r in out.where("key_str in ('a', 'b') and ctr > 3").collect()} == {4}


def test_list_helpers(spark):
    df = spark.createDataFrame([([1, 2, 3, 2],), ([],)], "a array<int>")
    a, two = F.col("a"), F.lit(2)
    r = df.select(
        L.at(a, -1).alias("at"), L.index_of(a, two).alias("i"), L.last_index_of(a, two).alias("l"), L.includes(a, two).alias("inc"), L.find(a, lambda x: x > 1).alias("f"), L.find_index(a, lambda x: x > 2).alias("fi"),
        L.every(a, lambda x: x > 0).alias("e"), L.some(a, lambda x: x > 2).alias("s"), L.part(a, 1, -1).alias("p"), L.join(a.cast("array<string>"), "-").alias("j"), L.pop(a).alias("pop"), L.shift(a).alias("sh"),
        L.push(a, F.lit(9)).alias("push"), L.unshift(a, F.lit(9)).alias("un"), L.splice(a, 1, 2, F.lit(7)).alias("sp"), L.fill(a, F.lit(0)).alias("fill"), L.reduce(a, F.lit(0), lambda x, y: x + y).alias("red"),
    ).collect()
    assert tuple(r[0]) == (2, 1, 3, True, 2, 2, True, True, [2, 3], "1-2-3-2", [1, 2, 3], [2, 3, 2], [1, 2, 3, 2, 9], [9, 1, 2, 3, 2], [1, 7, 2], [0, 0, 0, 0], 8)
    assert tuple(r[1]) == (None, -1, -1, False, None, -1, True, False, [], "", [], [], [9], [9], [7], [], 0)


def test_ids_cursors_and_widths(spark):
    df = spark.createDataFrame([("5@0aff",), ("_root",), ("x@1",), ("-7@01",), ("s",), ("e",)], "t string")
    ids = [r[0] for r in df.select(parse_id(F.col("t"))).collect()]
    assert (ids[0]["ctr"], bytes(ids[0]["actor"])) == (5, b"\x0a\xff") and ids[1]["ctr"] == 0 and ids[2] is None
    cur = [r[0] for r in df.select(parse_cursor(F.col("t"))).collect()]
    assert (cur[0]["move"], cur[3]["move"], cur[3]["ctr"], cur[4]["move"], cur[5]["move"]) == ("after", "before", 7, "start", "end") and cur[2] is None
    one = spark.createDataFrame([(7, b"\x01")], "c long, a binary")
    assert one.select(show_id(F.col("c"), F.col("a")), show_cursor(F.col("c"), F.col("a"), F.lit("before"))).first()[:] == ("7@01", "-7@01")
    w = spark.createDataFrame([("é😀",), ("👨‍👩‍👧",)], "s string")
    got = [tuple(r) for r in w.select(*[text_width(F.col("s"), e) for e in ("unicode", "utf8", "utf16", "grapheme")]).collect()]
    assert got == [(2, 6, 3, 2), (5, 18, 8, 1)]


def test_contract():
    import __spark_entry__ as entry

    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and "register_get" in q


def test_contract_is_read_without_a_session():
    """The lists are read by processes that have no Spark."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout.split()[0]) > 50, out.stderr


def test_cursor_bytes(spark):
    from causeway.functions.schema import cursor_bytes, parse_cursor_bytes

    given = [(0, b"", "start"), (0, b"", "end"), (1, b"\x01", "before"), (127, b"\x7f\x80", "after"), (128, b"a" * 200, "before"), (2**62 + 12345, b"\xff" * 16, "after")]
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "i int, ctr long, actor binary, move string")
    got = {r["i"]: r for r in df.select("i", cursor_bytes(F.col("ctr"), F.col("actor"), F.col("move")).alias("b")).select("i", "b", parse_cursor_bytes(F.col("b")).alias("p")).collect()}
    for i, (ctr, actor, move) in enumerate(given):
        p = got[i]["p"]
        assert (p["ctr"], p["actor"], p["move"]) == ((None, None, move) if move in ("start", "end") else (ctr, bytearray(actor), move))
    assert bytes(got[4]["b"]) == b"\x01\x03\xc8\x01" + b"a" * 200 + b"\x80\x01\x01"
    whole = bytes(got[5]["b"])
    bad = spark.createDataFrame([(b,) for b in (b"", b"\x01", b"\x02\x01", b"\x01\x04", whole[:-1], whole + b"\x01", whole[:8], b"\x01\x03\x01a\x05\x03")], "b binary")
    assert bad.select(parse_cursor_bytes(F.col("b")).alias("p")).where("p is not null").count() == 0
