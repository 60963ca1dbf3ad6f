"""Sequence order, positions, text and cursors.

The order of a list or text is the depth-first pre-order of its insert tree, siblings by descending id. Objects are many
and mostly small, so each is ordered by itself in a stream of Arrow batches; `order_by_doubling` orders objects too large for that with joins
alone (an Euler tour and pointer doubling, logarithmic rounds). `placed` gives each object to the one that fits its size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut, grouped
from ..functions.schema import op_id, text_width
from .register import winners

OBJ = ["doc", "obj_ctr", "obj_actor"]
#: Elements of an object, deleted ones too, above which it is ordered by joins.
LARGE = 4096


def inserts(ops: DataFrame) -> DataFrame:
    """(doc, obj, ctr, actor, key_ctr, key_actor): the insert tree; the parent of a first element is (0, null)."""
    return ops.where("insert").select(*OBJ, "ctr", "actor", "key_ctr", "key_actor")


def preorder(ids: list[tuple[int, bytes]], parents: list[tuple[int, bytes]]) -> list[int]:
    """Pre-order places of elements given their ids and parents, siblings by descending id; no recursion."""
    kids: dict[tuple[int, bytes], list[int]] = {}
    for i, p in enumerate(parents):
        kids.setdefault(p, []).append(i)
    for own in kids.values():
        own.sort(key=ids.__getitem__)  # the stack gives the largest first
    place, at, stack = [-1] * len(ids), 0, list(kids.get((0, b""), ()))
    while stack:
        i = stack.pop()
        place[i] = at
        at += 1
        stack += kids.get(ids[i], ())
    return place


def order(ops: DataFrame) -> DataFrame:
    """(doc, obj, ctr, actor, pos): the place of every element, deleted ones too."""

    def one(t: pa.Table) -> pa.Table:
        ids = list(zip(t["ctr"].to_pylist(), t["actor"].to_pylist()))
        parents = [(c or 0, a or b"") for c, a in zip(t["key_ctr"].to_pylist(), t["key_actor"].to_pylist())]
        return t.select([*OBJ, "ctr", "actor"]).append_column("pos", pa.array(preorder(ids, parents), pa.int64()))

    return grouped(inserts(ops), OBJ, one, "doc string, obj_ctr long, obj_actor binary, ctr long, actor binary, pos long").where("pos >= 0")


def order_by_doubling(ops: DataFrame, rounds: int = 64) -> DataFrame:
    """The same as `order`, by joins: each element's successor in an Euler tour, then distances by pointer doubling."""
    t = inserts(ops).select(*OBJ, op_id().alias("id"), F.struct(F.coalesce("key_ctr", F.lit(0)).alias("ctr"), F.coalesce("key_actor", F.unhex(F.lit(""))).alias("actor")).alias("up"))
    w = Window.partitionBy(*OBJ, "up").orderBy(F.desc("id.ctr"), F.desc("id.actor"))
    t = cut(t.withColumn("sibling", F.lead("id").over(w)).withColumn("first", F.row_number().over(w) == 1))
    child = t.where("first").select(*OBJ, F.col("up").alias("id"), F.col("id").alias("child"))
    root = F.struct(F.lit(0).cast("long").alias("ctr"), F.unhex(F.lit("")).alias("actor"))
    node = lambda i, down: F.struct(i.alias("id"), F.lit(down).alias("down"))
    # entering a node leads to its first child, or to leaving it; leaving leads to the next sibling, or leaving the parent
    enter = t.join(child, [*OBJ, "id"], "left").select(*OBJ, node(F.col("id"), True).alias("at"), F.when(F.col("child").isNotNull(), node(F.col("child"), True)).otherwise(node(F.col("id"), False)).alias("to"), F.lit(1).alias("d"))
    leave = t.select(
        *OBJ,
        node(F.col("id"), False).alias("at"),
        F.when(F.col("sibling").isNotNull(), node(F.col("sibling"), True)).when(F.col("up") != root, node(F.col("up"), False)).alias("to"),
        F.lit(0).alias("d"),
    )
    ptr = cut(enter.unionByName(leave).withColumn("lost", F.lit(False)))  # d: entries from `at` on before `to`; lost: it ends at a missing parent
    for _ in range(rounds):
        if ptr.where("to is not null").isEmpty():
            break
        on = ptr.select(*OBJ, F.col("at").alias("to"), F.col("to").alias("next"), F.col("d").alias("more"), F.col("lost").alias("gone"))
        # what has come to an end isn't joined again
        step = ptr.where("to is not null").join(on, [*OBJ, "to"], "left")
        step = step.select(*OBJ, "at", F.col("next").alias("to"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.coalesce("gone", F.lit(True)).alias("lost"))
        ptr = cut(step.unionByName(ptr.where("to is null").select(*step.columns)))
    here = ptr.where("at.down and not lost").select(*OBJ, F.col("at.id.ctr").alias("ctr"), F.col("at.id.actor").alias("actor"), "d")
    total = here.groupBy(*OBJ).agg(F.max("d").alias("all"))
    keyed = [F.col(f"h.{c}").eqNullSafe(F.col(f"t.{c}")) for c in OBJ]
    return here.alias("h").join(total.alias("t"), keyed).select(*[f"h.{c}" for c in OBJ], "ctr", "actor", (F.col("all") - F.col("d")).cast("long").alias("pos"))


def placed(ops: DataFrame) -> DataFrame:
    """The same as `order`: objects of more than LARGE elements by joins, the others one by one in Python."""
    large = cut(inserts(ops).groupBy(*OBJ).count().where(F.col("count") > LARGE).select(*OBJ))
    if large.isEmpty():
        return order(ops)
    return order(ops.join(large, OBJ, "left_anti")).unionByName(order_by_doubling(ops.join(large, OBJ, "left_semi")))


def elements(ops: DataFrame, clock: DataFrame | None = None, encoding: str = "unicode", view: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """The sequence view: visible elements with pos, index (0, 1, ..), start and width, and the winner's value.

    Deleted elements aren't there; positions count visible ones alone. The register view and the places are made anew
    unless they are given.
    """
    win = (winners(ops, clock) if view is None else view).where("key_str is null")
    own = win.withColumn("e_ctr", F.when(F.col("insert"), F.col("ctr")).otherwise(F.col("key_ctr"))).withColumn("e_actor", F.when(F.col("insert"), F.col("actor")).otherwise(F.col("key_actor")))
    at = (placed(ops) if at is None else at).select("doc", F.col("ctr").alias("e_ctr"), F.col("actor").alias("e_actor"), "pos")
    return positions(own.join(at, ["doc", "e_ctr", "e_actor"]), encoding)


def positions(rows: DataFrame, encoding: str = "unicode") -> DataFrame:
    """index, start and width of rows that have pos, by running counts within each object."""
    width = F.when(F.col("value.type") == "str", text_width(F.col("value.s"), encoding)).otherwise(1)
    w = Window.partitionBy(*OBJ).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("width", width.cast("long"))
    return out.withColumn("index", F.count("*").over(w)).withColumn("start", F.coalesce(F.sum("width").over(w), F.lit(0)))


def list_range(view: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """Elements of an index range."""
    out = view.where(F.col("index") >= low)
    return out if high is None else out.where(F.col("index") < high)


def at_text_index(view: DataFrame, i: int) -> DataFrame:
    """The element that holds a text position, by object."""
    return view.where((F.col("start") <= i) & (F.lit(i) < F.col("start") + F.col("width")))


def text(view: DataFrame) -> DataFrame:
    """The text of each object: strings joined, other values as U+FFFC."""
    piece = F.when(F.col("value.type") == "str", F.col("value.s")).otherwise("￼")
    return view.groupBy(*OBJ).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("s")))), lambda x: x["s"]), "").alias("text"))


def cursor_at(view: DataFrame, index: Column) -> DataFrame:
    """The element id at an index: what a cursor remembers."""
    return view.where(F.col("index") == index).select(*OBJ, F.col("e_ctr").alias("ctr"), F.col("e_actor").alias("actor"))


def cursor_positions(ops: DataFrame, cursors: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """(.., position) for cursors (doc, obj, ctr, actor, move).

    `after` moves to the next visible element; `before` to the nearest visible ancestor in the insert tree, else 0;
    `start` and `end` are the ends.
    """
    view = elements(ops, clock)
    at = placed(ops)
    shown = view.select("doc", F.col("e_ctr").alias("ctr"), F.col("e_actor").alias("actor"), F.lit(1).alias("shown"))
    w = Window.partitionBy(*OBJ).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rank = at.join(shown, ["doc", "ctr", "actor"], "left").withColumn("position", F.coalesce(F.sum("shown").over(w), F.lit(0)))
    rank = cut(rank.select(*OBJ, "ctr", "actor", "position", F.col("shown").isNotNull().alias("shown")))
    keep = cursors.select(*OBJ, "ctr", "actor", "move").distinct()
    after = keep.where("move = 'after'").join(rank.select("doc", "ctr", "actor", "position"), ["doc", "ctr", "actor"])
    up = inserts(ops).select("doc", "ctr", "actor", F.col("key_ctr").alias("up_ctr"), F.col("key_actor").alias("up_actor"))
    walk = cut(keep.where("move = 'before'").select(*OBJ, "ctr", "actor", "move", F.col("ctr").alias("at_ctr"), F.col("actor").alias("at_actor")))
    found = None
    while True:
        step = walk.join(rank.select("doc", F.col("ctr").alias("at_ctr"), F.col("actor").alias("at_actor"), "position", "shown"), ["doc", "at_ctr", "at_actor"], "left")
        step = cut(step)
        done = step.where("coalesce(shown, true)").select(*OBJ, "ctr", "actor", "move", F.coalesce("position", F.lit(0)).alias("position"))
        found = done if found is None else found.unionByName(done)
        walk = step.where("not coalesce(shown, true)").select(*OBJ, "ctr", "actor", "move", "at_ctr", "at_actor")
        walk = walk.join(up.withColumnsRenamed({"ctr": "at_ctr", "actor": "at_actor"}), ["doc", "at_ctr", "at_actor"]).select(*OBJ, "ctr", "actor", "move", F.col("up_ctr").alias("at_ctr"), F.col("up_actor").alias("at_actor"))
        walk = cut(walk)
        if walk.isEmpty():
            break
    sizes = view.groupBy(*OBJ).agg(F.count("*").alias("size"))
    ends = keep.where("move in ('start', 'end')").alias("c").join(sizes.alias("s"), [F.col(f"c.{x}").eqNullSafe(F.col(f"s.{x}")) for x in OBJ], "left")
    ends = ends.select(*[f"c.{x}" for x in OBJ], "ctr", "actor", "move", F.when(F.col("move") == "start", 0).otherwise(F.coalesce("size", F.lit(0))).cast("long").alias("position"))
    return after.select(*OBJ, "ctr", "actor", "move", "position").unionByName(found).unionByName(ends)

