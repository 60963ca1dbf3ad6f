"""Applying changes: what a replica lacks, what may be applied, in which order.

State is a function of the set of operations, so merging is a union of what one side lacks. Changes whose dependencies
are missing wait in a queue; nothing is ever dropped for its age.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut
from ..functions.schema import INCREMENT
from .graph import ancestors, changes_since, clock_of, closure, edges, levels


def added(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Changes of the other replica that this one lacks."""
    return theirs.join(mine.select("doc", "hash"), ["doc", "hash"], "left_anti")


def duplicates(changes: DataFrame) -> DataFrame:
    """(doc, actor, seq, n): sequence numbers that several different changes claim."""
    return changes.select("doc", "actor", "seq", "hash").distinct().groupBy("doc", "actor", "seq").agg(F.count("*").alias("n")).where("n > 1")


def checked(changes: DataFrame) -> DataFrame:
    """The same rows, failing at run time if any (actor, seq) is claimed twice."""
    bad = duplicates(changes).agg(F.count("*").alias("bad"))
    fail = F.when(F.col("bad") > 0, F.raise_error(F.concat(F.lit("duplicate sequence numbers: "), F.col("bad").cast("string")))).otherwise(F.lit(True)).cast("boolean")
    return changes.crossJoin(F.broadcast(bad)).where(F.coalesce(fail, F.lit(True))).drop("bad")  # one row


def apply_changes(mine: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, queued): all changes once, split by whether every ancestor is there. Applying again changes nothing.

    What waits is what depends, however far, on a change with a missing dependency; nothing else is walked.
    """
    every = cut(mine.unionByName(added(mine, theirs)).dropDuplicates(["doc", "hash"]))
    known = every.select("doc", F.col("hash").alias("dep"))
    stuck = edges(every).join(known, ["doc", "dep"], "left_anti").select("doc", "hash")
    waiting = closure(stuck, edges(every).select("doc", F.col("dep").alias("hash"), F.col("hash").alias("next")))
    return every.join(waiting, ["doc", "hash"], "left_anti"), every.join(waiting, ["doc", "hash"], "left_semi")


def release_order(changes: DataFrame) -> DataFrame:
    """Ready changes with their level: all of a level can be applied at once."""
    return changes.join(levels(changes), ["doc", "hash"])


def drop_branch(queued: DataFrame, bad: DataFrame) -> DataFrame:
    """The queue without some changes (doc, hash) and all that depend on them."""
    gone = closure(bad, edges(queued).select("doc", F.col("dep").alias("hash"), F.col("hash").alias("next")))
    return queued.join(gone, ["doc", "hash"], "left_anti")


def merge_ops(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Union of two op logs by operation id."""
    return mine.unionByName(theirs.join(mine.select("doc", "ctr", "actor"), ["doc", "ctr", "actor"], "left_anti"))


def fork_at(changes: DataFrame, ops: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, ops) of a new replica that has exactly the ancestors of the heads `of`."""
    own = changes.join(ancestors(changes, of), ["doc", "hash"], "left_semi")
    clock = clock_of(own)
    return own, ops.join(clock.select("doc", "actor", "max_op"), ["doc", "actor"]).where("ctr <= max_op").drop("max_op")


def save_after(changes: DataFrame, of: DataFrame) -> DataFrame:
    """Changes that aren't ancestors of the heads `of`."""
    from .graph import clock_at

    return changes_since(changes, clock_at(changes, of))


def op_order(ops: DataFrame) -> DataFrame:
    """Operations by object, key and id: the order in which a batch is merged and stored."""
    return ops.repartition("doc", "obj_ctr", "obj_actor").sortWithinPartitions("doc", "obj_ctr", "obj_actor", "key_str", "key_ctr", "key_actor", "ctr", "actor")


def successors(ops: DataFrame) -> DataFrame:
    """(doc, ctr, actor, succ_ctr, succ_actor, inc): predecessors turned round; inc for increments of counters."""
    s = ops.select("doc", F.explode("pred").alias("p"), F.col("ctr").alias("succ_ctr"), F.col("actor").alias("succ_actor"), "action", F.col("value.i").alias("by"))
    s = s.select("doc", F.col("p.ctr").alias("ctr"), F.col("p.actor").alias("actor"), "succ_ctr", "succ_actor", "action", "by")
    base = ops.select("doc", "ctr", "actor", (F.col("value.type") == "counter").alias("counter"))
    return s.join(base, ["doc", "ctr", "actor"]).select("doc", "ctr", "actor", "succ_ctr", "succ_actor", F.when((F.col("action") == INCREMENT) & F.col("counter"), F.col("by")).alias("inc"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one but not the other, with the side; empty if and only if they are equal as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def changes_from_ops(ops: DataFrame, changes: DataFrame) -> DataFrame:
    """(doc, hash, num_ops, ops): each change with its operations in order, deletes included."""
    c = changes.select("doc", "actor", "hash", "start_op", "max_op")
    return ops.join(c, ["doc", "actor"]).where("ctr between start_op and max_op").groupBy("doc", "hash").agg(F.count("*").alias("num_ops"), F.array_sort(F.collect_list(F.struct("ctr", "action", "key_str"))).alias("ops"))


def numbered(edits: DataFrame, start: DataFrame) -> DataFrame:
    """Operation counters of new edits: the document's next counter and on, in the order of `n`."""
    w = Window.partitionBy("doc").orderBy("n")
    return edits.join(start, "doc", "left").withColumn("ctr", F.coalesce("max_op", F.lit(0)) + F.row_number().over(w)).drop("max_op")
