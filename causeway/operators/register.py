"""Visibility and registers: which operations are live, who wins a key, what a counter adds up to.

Visibility and counters are settled by operation id: what replaces or increments each operation is a flag and a sum,
hashed with partial sums, and joined back to the operations by that id, without a sort. A second shuffle by key ranks what
is visible, with partial maxima, so a hot key doesn't meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import DELETE, INCREMENT, KEY, MARK, elem_or_key, op_id


def covered(ops: DataFrame, clock: DataFrame | None) -> DataFrame:
    """Operations that a clock (doc, actor, max_op) covers; all without a clock."""
    if clock is None:
        return ops
    at = clock.select("doc", "actor", "max_op")
    return ops.join(at, ["doc", "actor"]).where("ctr <= max_op").drop("max_op")


def scoped(ops: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """Covered operations and `visible`, `inc`: live at the clock, and the sum of its covered increments.

    An increment is never visible and replaces nothing, unless what it follows is no counter.
    """
    own = covered(ops, clock)
    inc = F.when(F.col("action") == INCREMENT, F.coalesce("value.i", F.col("value.u").cast("long")))
    pred = own.select("doc", F.explode("pred").alias("p"), (F.col("action") != INCREMENT).alias("replaced"), inc.alias("inc"))
    # flags and sums of fixed width: hashed, with partial sums before the shuffle
    told = pred.groupBy("doc", F.col("p.ctr").alias("ctr"), F.col("p.actor").alias("actor")).agg(F.sum("inc").alias("cw_inc"), F.max("replaced").alias("cw_replaced"), F.count("inc").alias("cw_incs"))
    rows = own.join(told.hint("shuffle_hash"), ["doc", "ctr", "actor"], "left")
    # an increment of what is no counter replaces it, which only its predecessor's row can tell
    counter = F.coalesce(F.col("value.type") == "counter", F.lit(False))
    live = ~F.coalesce("cw_replaced", F.lit(False)) & ~F.col("action").isin(INCREMENT, DELETE) & ((F.coalesce("cw_incs", F.lit(0)) == 0) | counter)
    total = F.when(counter, F.coalesce("cw_inc", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return rows.withColumns({"visible": live, "inc": total}).drop("cw_inc", "cw_replaced", "cw_incs").select(*own.columns, "visible", "inc")


def visible(ops: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """Live operations with their key and, for counters, the value that their increments lead to."""
    out = scoped(ops, clock).where("visible").drop("visible")
    value = F.when(F.col("value.type") == "counter", F.col("value").withField("i", F.col("value.i") + F.col("inc"))).otherwise(F.col("value"))
    return out.withColumn("value", value).drop("inc").withColumn("key", elem_or_key())


def winners(ops: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """The register view: of each key the visible operation with the largest id, the number visible, and conflict."""
    live = visible(ops, clock).where(F.col("action") != MARK)
    rest = [c for c in live.columns if c not in KEY]
    out = live.groupBy(*KEY).agg(F.max_by(F.struct(*rest), op_id()).alias("w"), F.count("*").alias("n"))
    return out.select(*KEY, "w.*", "n", (F.col("n") > 1).alias("conflict"))


def at_obj(df: DataFrame, ctr: int = 0, actor: bytes | None = None) -> DataFrame:
    """Rows of one object; the root by default."""
    return df.where((F.col("obj_ctr") == ctr) & F.col("obj_actor").eqNullSafe(F.lit(actor).cast("binary")))


def get(view: DataFrame, key: str) -> DataFrame:
    """The winner of a map key, from the register view."""
    return view.where(F.col("key_str") == key)


def get_all(ops: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """Every visible operation with its place among those of its key, ascending by id."""
    from pyspark.sql import Window

    return visible(ops, clock).where(F.col("action") != MARK).withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("ctr", "actor")))


def keys(view: DataFrame) -> DataFrame:
    """Visible map keys of each object."""
    return view.where("key_str is not null").select("doc", "obj_ctr", "obj_actor", "key_str").distinct()


def map_range(view: DataFrame, low: str | None = None, high: str | None = None, low_open: bool = False, high_closed: bool = False) -> DataFrame:
    """Winners of a range of map keys; bounds may be missing."""
    out = view.where("key_str is not null")
    if low is not None:
        out = out.where(F.col("key_str") > low if low_open else F.col("key_str") >= low)
    if high is not None:
        out = out.where(F.col("key_str") <= high if high_closed else F.col("key_str") < high)
    return out


def length(view: DataFrame, width: Column | None = None) -> DataFrame:
    """Keys of maps, elements of lists, or summed width of texts, by object."""
    return view.groupBy("doc", "obj_ctr", "obj_actor").agg((F.count("*") if width is None else F.coalesce(F.sum(width), F.lit(0))).cast("long").alias("length"))


def conflicts(ops: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """Keys with several visible values: a map from id to value."""
    from ..functions.schema import plain, show_id

    live = visible(ops, clock).where(F.col("action") != MARK)
    out = live.groupBy(*KEY).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(show_id(F.col("ctr"), F.col("actor")).alias("id"), plain().alias("value")))).alias("all"))
    return out.where("n > 1").withColumn("values", F.map_from_entries("all")).drop("all")


def counter_diff(ops: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """For counters visible at both clocks, their value at each and the difference."""
    side = lambda c, n: visible(ops, c).where("value.type = 'counter'").select(*KEY, "ctr", "actor", F.col("value.i").alias(n))
    both = side(before, "old").join(side(after, "new").select("doc", "ctr", "actor", "new"), ["doc", "ctr", "actor"])
    return both.withColumn("diff", F.col("new") - F.col("old"))


def stats(ops: DataFrame, changes: DataFrame) -> DataFrame:
    """Operations, changes and actors of each document."""
    a = ops.groupBy("doc").agg(F.count("*").alias("num_ops"), F.count_distinct("actor").alias("num_actors"))
    b = changes.groupBy("doc").agg(F.count("*").alias("num_changes"))
    return a.join(b, "doc", "full").select("doc", F.coalesce("num_ops", F.lit(0)).alias("num_ops"), F.coalesce("num_changes", F.lit(0)).alias("num_changes"), F.coalesce("num_actors", F.lit(0)).alias("num_actors"))
