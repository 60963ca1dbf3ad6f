"""Op logs at rest: Parquet tables, increments, bundles, and what loading may tolerate.

A store is a folder with `ops`, `heads` and `changes`, each in batches: a save is one batch, every increment another. A
batch's operations and heads are written first and its changes last, so the changes are the mark of what is whole: what a
failed write left behind names a batch that no change has, and is never read. Rows lie sorted by object and key within
files, so reads of one object skip the rest by statistics.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import cut
from ..functions.schema import CHANGES, MAKE_TEXT, MARK, OPS, SET, value
from ..operators import graph, marks, merge
from ..operators.register import visible

ORDER = ["doc", "obj_ctr", "obj_actor", "key_str", "key_ctr", "key_actor", "ctr", "actor"]


@dataclass
class Options:
    """verify: compare the stored heads; partial: "error" or "ignore" for changes whose dependencies are missing;
    strings: "keep", or "text" to turn visible strings into text objects; orphans: keep waiting changes on save; marks:
    "keep", or "rescue" to leave out marks that end before they begin or not at all."""

    verify: bool = True
    partial: str = "error"
    strings: str = "keep"
    orphans: bool = True
    marks: str = "keep"
    compression: str = "zstd"


def save(changes: DataFrame, ops: DataFrame, path: str, options: Options | None = None) -> None:
    """Write a whole store: changes, operations and heads."""
    o = options or Options()
    if not o.orphans:
        changes, _ = merge.apply_changes(changes.limit(0), changes)
        ops = merge.fork_at(changes, ops, graph.heads(changes).select("doc", "hash"))[1]
    _write(changes, ops, graph.heads(changes), path, 0, o.compression, "overwrite")


def _write(changes: DataFrame, ops: DataFrame, heads: DataFrame, path: str, number: int, compression: str = "zstd", mode: str = "append") -> None:
    """One batch: the changes come last."""
    batch = F.lit(f"{number:09d}-{uuid.uuid4().hex}")
    rows = ops.select(*OPS.names).repartition("doc").sortWithinPartitions(*ORDER)
    for part, df in (("ops", rows), ("heads", heads.select("doc", "hash")), ("changes", changes.select(*CHANGES.names))):
        df.withColumn("batch", batch).write.mode(mode).partitionBy("batch").option("compression", compression).parquet(f"{path}/{part}")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(changes, ops, heads) of whole batches, and the number of the last."""
    changes, ops = spark.read.schema(CHANGES).parquet(f"{path}/changes"), spark.read.schema(OPS).parquet(f"{path}/ops")
    # one name a batch, which the saves bound; the filter on it prunes folders
    whole = sorted(r["batch"] for r in changes.select("batch").distinct().collect()) if "batch" in changes.columns else []
    heads = spark.read.schema("doc string, hash binary").parquet(f"{path}/heads")
    last = whole[-1:] if "batch" in heads.columns else []
    ops = ops.where(F.col("batch").isin(whole)) if "batch" in ops.columns else ops
    return changes.select(*CHANGES.names), ops.select(*OPS.names), (heads.where(F.col("batch").isin(last)) if last else heads.limit(0)).select("doc", "hash"), int(whole[-1][:9]) if whole else 0


def load(spark: SparkSession, path: str, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes, ops) of a store."""
    o = options or Options()
    changes, ops, heads, _ = _read(spark, path)
    if o.verify and not heads_match(changes, heads):
        raise ValueError("the heads differ from those stored")
    if o.partial == "error":
        if not graph.missing_deps(changes, changes).isEmpty():
            raise ValueError("a dependency is missing")
    else:
        changes, _ = merge.apply_changes(changes.limit(0), changes)
        ops = bundle_ops(changes, ops)
    if o.strings == "text":
        ops = ops.unionByName(strings_to_text(ops))
    return changes, rescued(ops) if o.marks == "rescue" else ops


def rescued(ops: DataFrame) -> DataFrame:
    """The operations without marks that end before they begin or not at all."""
    bad = marks.bad_mark_order(ops).select("doc", "actor", F.explode(F.array(F.col("ctr"), F.col("ctr") + 1)).alias("ctr"))
    bad = bad.select("doc", "ctr", "actor", F.lit(MARK).alias("action"))
    return ops.join(bad, ["doc", "ctr", "actor", "action"], "left_anti").select(*OPS.names)


def heads_match(changes: DataFrame, stored: DataFrame) -> bool:
    own = graph.heads(changes).select("doc", "hash")
    return merge.differing(own, stored.select("doc", "hash")).isEmpty()


def save_and_verify(changes: DataFrame, ops: DataFrame, path: str) -> None:
    """Write, read back, and fail unless the rows are the same."""
    save(changes, ops, path)
    c, o = load(changes.sparkSession, path)
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    if not same(c.select("doc", "hash"), changes.select("doc", "hash")) or not same(o.select("doc", "ctr", "actor"), ops.select("doc", "ctr", "actor")):
        raise ValueError("what was written reads differently")


def append(changes: DataFrame, ops: DataFrame, path: str) -> int:
    """Write only what the store lacks: the number of changes added."""
    spark = changes.sparkSession
    have, _, _, last = _read(spark, path)
    new = cut(changes.select(*CHANGES.names).join(have.select("doc", "hash"), ["doc", "hash"], "left_anti").dropDuplicates(["doc", "hash"]))
    n = new.count()
    if n:
        _write(new, bundle_ops(new, ops), graph.heads(have.unionByName(new)), path, last + 1)
    return n


def bundle_ops(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """The operations of some changes."""
    c = changes.select("doc", "actor", "start_op", "max_op")
    return ops.select(*OPS.names).join(c, ["doc", "actor"]).where("ctr between start_op and max_op").select(*OPS.names)


def bundle(changes: DataFrame, ops: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, ops) of the hashes asked for (doc, hash)."""
    own = changes.join(of.select("doc", "hash").distinct(), ["doc", "hash"], "left_semi")
    return own, bundle_ops(own, ops)


def save_after(changes: DataFrame, ops: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, ops) that aren't ancestors of the heads `of`."""
    own = merge.save_after(changes, of)
    return own, bundle_ops(own, ops)


def expanded(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """(doc, hash, json): each change with its operations as one JSON text; `from_expanded` reads it back."""
    c = changes.select(*CHANGES.names)
    o = ops.select(*OPS.names).withColumnRenamed("ctr", "op_ctr")
    j = o.join(c.select("doc", "actor", "hash", "start_op", "max_op"), ["doc", "actor"]).where("op_ctr between start_op and max_op")
    hexed = lambda n: F.lower(F.hex(n)).alias(n)
    op = F.struct("op_ctr", "obj_ctr", hexed("obj_actor"), "key_str", "key_ctr", hexed("key_actor"), "insert", "action", F.to_json("value").alias("value"), "expand", "mark_name", F.transform("pred", lambda p: F.concat(p["ctr"].cast("string"), F.lit("@"), F.lower(F.hex(p["actor"])))).alias("pred"))
    own = j.groupBy("doc", "hash").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    head = F.struct(hexed("actor"), "seq", "start_op", "max_op", "time", "message", F.transform("deps", lambda d: F.lower(F.hex(d))).alias("deps"), hexed("extra"), "ops")
    return c.join(own, ["doc", "hash"], "left").select("doc", "hash", F.to_json(head).alias("json"))


_EXPANDED = (
    "actor string, seq bigint, start_op bigint, max_op bigint, time bigint, message string, deps array<string>, extra string, "
    "ops array<struct<op_ctr:bigint,obj_ctr:bigint,obj_actor:string,key_str:string,key_ctr:bigint,key_actor:string,insert:boolean,action:int,value:string,expand:boolean,mark_name:string,pred:array<string>>>"
)


def from_expanded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, ops) of `expanded` rows."""
    from ..functions.schema import VALUE

    r = rows.select("doc", "hash", F.from_json("json", _EXPANDED).alias("r"))
    changes = r.select("doc", "hash", F.unhex("r.actor").alias("actor"), "r.seq", "r.start_op", "r.max_op", "r.time", "r.message", F.transform("r.deps", F.unhex).alias("deps"), F.unhex("r.extra").alias("extra"))
    o = r.select("doc", F.unhex("r.actor").alias("actor"), F.explode("r.ops").alias("o"))
    pred = F.transform(F.coalesce("o.pred", F.array().cast("array<string>")), lambda p: F.struct(F.split(p, "@")[0].cast("long").alias("ctr"), F.unhex(F.split(p, "@")[1]).alias("actor")))
    ops = o.select(
        "doc", F.col("o.op_ctr").alias("ctr"), "actor", "o.obj_ctr", F.unhex("o.obj_actor").alias("obj_actor"), "o.key_str", "o.key_ctr", F.unhex("o.key_actor").alias("key_actor"), "o.insert", "o.action",
        F.from_json("o.value", VALUE).alias("value"), "o.expand", "o.mark_name", pred.alias("pred"),
    )
    return changes.select(*CHANGES.names), ops.select(*OPS.names)


def strings_to_text(ops: DataFrame, actor: bytes = b"\xff") -> DataFrame:
    """Operations that replace every visible string of a map by a text object of its characters."""
    from pyspark.sql import Window

    live = visible(ops).where((F.col("action") == SET) & (F.col("value.type") == "str") & F.col("key_str").isNotNull())
    most = ops.groupBy("doc").agg(F.max("ctr").alias("most"))
    n = F.length("value.s")
    own = live.join(most, "doc").withColumn("size", n)
    before = F.coalesce(F.sum(F.col("size") + 1).over(Window.partitionBy("doc").orderBy("ctr", "actor").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("id", F.col("most") + 1 + before)
    none = F.array().cast("array<struct<ctr:bigint,actor:binary>>")
    null = lambda kind: F.lit(None).cast(kind)
    make = own.select(
        "doc", F.col("id").alias("ctr"), F.lit(actor).alias("actor"), "obj_ctr", "obj_actor", "key_str", null("long").alias("key_ctr"), null("binary").alias("key_actor"), F.lit(False).alias("insert"), F.lit(MAKE_TEXT).cast("int").alias("action"),
        F.lit(None).cast(OPS["value"].dataType).alias("value"), null("boolean").alias("expand"), null("string").alias("mark_name"), F.array(F.struct("ctr", "actor")).alias("pred"),
    )
    chars = own.where("size > 0").select("doc", "id", F.posexplode(F.filter(F.split("value.s", ""), lambda c: c != "")).alias("i", "c"))
    text = chars.select(
        "doc", (F.col("id") + 1 + F.col("i")).alias("ctr"), F.lit(actor).alias("actor"), F.col("id").alias("obj_ctr"), F.lit(actor).alias("obj_actor"), null("string").alias("key_str"),
        F.when(F.col("i") > 0, F.col("id") + F.col("i")).otherwise(0).cast("long").alias("key_ctr"), F.when(F.col("i") > 0, F.lit(actor)).alias("key_actor"), F.lit(True).alias("insert"), F.lit(SET).cast("int").alias("action"),
        value("str", F.col("c")).alias("value"), null("boolean").alias("expand"), null("string").alias("mark_name"), none.alias("pred"),
    )
    return make.unionByName(text).select(*OPS.names)
