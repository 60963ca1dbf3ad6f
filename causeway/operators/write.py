"""Writes as relations: edits of many keys of many documents become operations in one pass.

An edit replaces what is visible at its key in its scope, so its predecessors come from the register of that scope. An
edit that changes nothing makes no operation; one that repeats a conflicted winner deletes the losers. Interactive edits
of one document are in transaction.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import DELETE, ID, INCREMENT, MARK, SET, op_id
from .register import visible

PRED = f"array<{ID.simpleString()}>"
OBJ_KEY = ["doc", "obj_ctr", "obj_actor", "key_str"]


def _registers(ops: DataFrame, scope: DataFrame | None) -> DataFrame:
    """(obj, key_str, ids, win, counters): ids visible at each map key, the winner, the visible counters."""
    live = visible(ops, scope).where((F.col("key_str").isNotNull()) & (F.col("action") != MARK))
    counter = F.when(F.col("value.type") == "counter", op_id())
    return live.groupBy(*OBJ_KEY).agg(F.sort_array(F.collect_list(op_id())).alias("ids"), F.max_by(F.struct("ctr", "actor", "action", "value"), op_id()).alias("win"), F.sort_array(F.collect_list(counter)).alias("counters"))


def map_edits(ops: DataFrame, edits: DataFrame, actor: bytes, scope: DataFrame | None = None) -> DataFrame:
    """Operations for edits (doc, obj_ctr, obj_actor, key_str, action, value, n), at most one of a key.

    action is SET, DELETE, INCREMENT or a make. An increment where no counter is visible fails.
    """
    regs = _registers(ops, scope)
    on = [F.col(f"e.{c}").eqNullSafe(F.col(f"r.{c}")) for c in OBJ_KEY]
    j = edits.alias("e").join(regs.alias("r"), on, "left").select("e.*", "ids", "win", "counters")
    none = F.array().cast(PRED)
    same = (F.col("action") == SET) & (F.col("win.action") == SET) & F.col("win.value").eqNullSafe(F.col("value")) & (F.col("value.type") != "counter")
    losers = F.filter("ids", lambda x: (x["ctr"] != F.col("win.ctr")) | (x["actor"] != F.col("win.actor")))
    n = F.coalesce(F.size("ids"), F.lit(0))
    bad = F.raise_error(F.concat(F.lit("no counter at "), F.col("key_str"))).cast(PRED)
    pred = F.when(same, losers).when(F.col("action") == INCREMENT, F.when(F.coalesce(F.size("counters"), F.lit(0)) > 0, F.col("counters")).otherwise(bad)).otherwise(F.coalesce("ids", none))
    j = j.where(~(F.coalesce(same, F.lit(False)) & (n <= 1)) & ~((F.col("action") == DELETE) & (n == 0)))
    out = j.withColumn("pred", pred).withColumn("action", F.when(same, DELETE).otherwise(F.col("action")))
    out = out.withColumn("value", F.when(F.col("action") != DELETE, F.col("value")))
    most = ops.groupBy("doc").agg(F.max("ctr").alias("most"))
    ctr = F.coalesce("most", F.lit(0)) + F.row_number().over(Window.partitionBy("doc").orderBy("n"))
    out = out.join(most, "doc", "left").withColumn("ctr", ctr)
    return out.select(
        "doc",
        F.col("ctr").cast("long").alias("ctr"),
        F.lit(actor).alias("actor"),
        "obj_ctr",
        "obj_actor",
        "key_str",
        F.lit(None).cast("long").alias("key_ctr"),
        F.lit(None).cast("binary").alias("key_actor"),
        F.lit(False).alias("insert"),
        F.col("action").cast("int").alias("action"),
        "value",
        F.lit(None).cast("boolean").alias("expand"),
        F.lit(None).cast("string").alias("mark_name"),
        "pred",
    )


def update_map(ops: DataFrame, wanted: DataFrame, actor: bytes, scope: DataFrame | None = None) -> DataFrame:
    """Operations that bring map objects to the wanted values (doc, obj_ctr, obj_actor, key_str, value).

    Keys of those objects that aren't wanted are deleted.
    """
    objs = wanted.select("doc", "obj_ctr", "obj_actor").distinct()
    regs = _registers(ops, scope)
    own = regs.alias("r").join(objs.alias("o"), [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("doc", "obj_ctr", "obj_actor")], "left_semi").select(*OBJ_KEY)
    on = [F.col(f"w.{c}").eqNullSafe(F.col(f"r.{c}")) for c in OBJ_KEY]
    j = wanted.alias("w").join(own.alias("r"), on, "full")
    edits = j.select(*[F.coalesce(f"w.{c}", f"r.{c}").alias(c) for c in OBJ_KEY], F.when(F.col("w.doc").isNull(), DELETE).otherwise(SET).alias("action"), F.col("w.value").alias("value"))
    edits = edits.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("obj_ctr", "obj_actor", "key_str")))
    return map_edits(ops, edits, actor, scope)
