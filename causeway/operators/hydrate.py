"""Documents as nested values: paths, JSON out, JSON in.

A document of at most LARGE rows is walked in one task: one shuffle by document, whatever the depth. Larger ones
are folded from the leaves up, one join a level, and need not fit a task's Python. JSON comes in row by row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import by_size, cut, grouped
from ..functions.schema import MAKE_LIST, MAKE_MAP, MAKE_TEXT, MAKES, OPS, SET, VALUE, show_id
from .register import winners
from .sequence import OBJ, elements, inserts, preorder

#: Rows of a document that one task may walk.
LARGE = 1 << 18


def objects(view: DataFrame) -> DataFrame:
    """(doc, obj_ctr, obj_actor, kind, parent_ctr, parent_actor, key, ctr, actor): visible objects and where they hang."""
    return view.where(F.col("action").isin(*MAKES)).select(
        "doc", F.col("ctr").alias("id_ctr"), F.col("actor").alias("id_actor"), F.when(F.col("action") == MAKE_LIST, "list").when(F.col("action") == MAKE_TEXT, "text").otherwise("map").alias("kind"), "obj_ctr", "obj_actor", "key", "key_str"
    )


def parents(view: DataFrame) -> DataFrame:
    """(doc, id_ctr, id_actor, depth, path): the path of each reachable object from the root, as an array of props."""
    o = cut(objects(view).select("doc", "id_ctr", "id_actor", "obj_ctr", "obj_actor", F.coalesce("key_str", "key").alias("prop")))

    def walk(t: pa.Table) -> pa.Table:
        kids: dict[tuple, list[tuple]] = {}
        for r in zip(*[t[c].to_pylist() for c in ("obj_ctr", "obj_actor", "id_ctr", "id_actor", "prop")]):
            kids.setdefault((r[0], r[1] if r[0] else None), []).append(r[2:])
        out, front = [], [((0, None), [])]
        while front:
            obj, path = front.pop()
            for ctr, actor, prop in kids.get(obj, ()):
                out.append((ctr, actor, [*path, prop]))
                front.append(((ctr, actor), out[-1][2]))
        doc = t["doc"][0].as_py()
        return pa.table({"doc": pa.array([doc] * len(out), pa.string()), "id_ctr": pa.array([r[0] for r in out], pa.int64()), "id_actor": pa.array([r[1] for r in out], pa.binary()), "depth": pa.array([len(r[2]) for r in out], pa.int32()), "path": pa.array([r[2] for r in out], pa.list_(pa.string()))})

    small, large = by_size(o, "doc", LARGE)
    out = grouped(small, ["doc"], walk, "doc string, id_ctr long, id_actor binary, depth int, path array<string>")
    return out if large is None else out.unionByName(_parents_by_level(large))


def _parents_by_level(o: DataFrame) -> DataFrame:
    """The same by one join a level."""
    front = cut(o.where("obj_ctr = 0").select("doc", "id_ctr", "id_actor", F.lit(1).alias("depth"), F.array("prop").alias("path")))
    out = front
    while True:
        below = o.where("obj_ctr > 0").join(front.select("doc", F.col("id_ctr").alias("obj_ctr"), F.col("id_actor").alias("obj_actor"), "depth", "path"), ["doc", "obj_ctr", "obj_actor"])
        front = cut(below.select("doc", "id_ctr", "id_actor", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("prop")).alias("path")))
        if front.isEmpty():
            return out
        out = out.unionByName(front)


def json_scalar(v: str = "value") -> Column:
    """A tagged scalar as JSON text; bytes become arrays of numbers, doubles that JSON can't hold null."""
    quoted = F.expr(f"substr(to_json(named_struct('x', {v}.s)), 6, length(to_json(named_struct('x', {v}.s))) - 6)")
    d = F.col(f"{v}.d")
    number = F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), "null").otherwise(F.expr(f"substr(to_json(named_struct('x', {v}.d)), 6, length(to_json(named_struct('x', {v}.d))) - 6)"))
    hexed = F.hex(f"{v}.b")
    byte = F.transform(F.sequence(F.lit(1), F.octet_length(f"{v}.b")), lambda i: F.conv(F.substring(hexed, 2 * i - 1, F.lit(2)), 16, 10))
    return (
        F.when(F.col(f"{v}.type") == "str", quoted)
        .when(F.col(f"{v}.type").isin("int", "counter", "timestamp"), F.col(f"{v}.i").cast("string"))
        .when(F.col(f"{v}.type") == "uint", F.col(f"{v}.u").cast("string"))
        .when(F.col(f"{v}.type") == "f64", number)
        .when(F.col(f"{v}.type") == "boolean", F.col(f"{v}.bool").cast("string"))
        .when(F.col(f"{v}.type").isin("bytes", "unknown"), F.concat(F.lit("["), F.array_join(F.when(F.octet_length(f"{v}.b") > 0, byte).otherwise(F.array().cast("array<string>")), ","), F.lit("]")))
        .otherwise("null")
    )


def _quote(c: Column) -> Column:
    t = F.to_json(F.struct(c.alias("x")))
    return F.substring(t, F.lit(6), F.length(t) - 6)


def to_json(ops: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """(doc, json): the whole document, map keys sorted, at a clock."""
    view = winners(ops, clock)
    text = F.when((F.col("action") == SET) & (F.col("value.type") == "str"), F.col("value.s")).alias("s")
    shown = view.select(*OBJ, F.col("key_str").alias("k"), F.when(F.col("insert"), F.col("ctr")).otherwise(F.col("key_ctr")).alias("e_ctr"), F.when(F.col("insert"), F.col("actor")).otherwise(F.col("key_actor")).alias("e_actor"), "ctr", "actor", "action", json_scalar().alias("json"), text)
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    tree = inserts(ops).select(*OBJ, null("string", "k"), F.col("key_ctr").alias("e_ctr"), F.col("key_actor").alias("e_actor"), "ctr", "actor", null("int", "action"), null("string", "json"), null("string", "s"))
    small, large = by_size(cut(shown.unionByName(tree)), "doc", LARGE)  # the insert tree has no action
    out = grouped(small, ["doc"], _nested, "doc string, json string").where("json is not null")
    if large is None:
        return out
    large = cut(large.select("doc").distinct())
    return out.unionByName(_fold(ops.join(large, "doc", "left_semi"), clock))


def _nested(t: pa.Table) -> pa.Table:
    """One document's JSON from its winners and insert tree."""
    shown: dict[tuple, list] = {}
    trees: dict[tuple, tuple[list, list]] = {}
    for oc, oa, k, ec, ea, ctr, actor, action, scalar, s in zip(*[t[c].to_pylist() for c in ("obj_ctr", "obj_actor", "k", "e_ctr", "e_actor", "ctr", "actor", "action", "json", "s")]):
        obj = (oc, oa if oc else None)
        if action is None:
            ids, ups = trees.setdefault(obj, ([], []))
            ids.append((ctr, actor))
            ups.append((ec or 0, ea or b""))
        else:
            shown.setdefault(obj, []).append((k, (ec, ea), (ctr, actor), action, scalar, s))
    places = {obj: dict(zip(ids, preorder(ids, ups))) for obj, (ids, ups) in trees.items()}
    quote = lambda x: json.dumps(x, ensure_ascii=False)
    out: list[str] = []
    # what is still to be written, last first: finished text, or an object with its kind
    todo: list = [((0, None), MAKE_MAP)] if shown else []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        obj, kind = x
        rows = shown.get(obj, [])
        if kind in (MAKE_LIST, MAKE_TEXT):
            at = places.get(obj, {})
            rows = sorted((r for r in rows if r[0] is None and at.get(r[1], -1) >= 0), key=lambda r: at[r[1]])
        else:
            rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0].encode())
        if kind == MAKE_TEXT:
            out.append(quote("".join("\ufffc" if r[5] is None else r[5] for r in rows)))
            continue
        parts: list = ["[" if kind == MAKE_LIST else "{"]
        for i, (k, _, ident, action, scalar, _) in enumerate(rows):
            parts.append("," * (i > 0) + ("" if k is None else quote(k) + ":"))
            parts.append((ident, action) if action in MAKES else scalar)
        parts.append("]" if kind == MAKE_LIST else "}")
        todo += reversed(parts)
    return pa.table({"doc": t["doc"][:1], "json": pa.array(["".join(out) or None], pa.string())})


def _fold(ops: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """The same from the leaves up, one join a level."""
    view = winners(ops, clock)
    maps = view.where("key_str is not null").select(*OBJ, F.col("key_str").alias("k"), F.lit(0).cast("long").alias("pos"), "ctr", "actor", "action", json_scalar().alias("json"), F.col("value.s").alias("s"))
    seqs = elements(ops, clock).select(*OBJ, F.lit(None).cast("string").alias("k"), "pos", "ctr", "actor", "action", json_scalar().alias("json"), F.col("value.s").alias("s"))
    rows = cut(maps.unionByName(seqs))
    made = cut(objects(view).select("doc", "id_ctr", "id_actor", "kind").unionByName(rows.select("doc").distinct().select("doc", F.lit(0).cast("long").alias("id_ctr"), F.lit(None).cast("binary").alias("id_actor"), F.lit("map").alias("kind"))))
    # depth of every object, then fold from the deepest
    tree = rows.where(F.col("action").isin(*MAKES)).select("doc", F.col("ctr").alias("id_ctr"), F.col("actor").alias("id_actor"), "obj_ctr", "obj_actor")
    front = cut(made.where("id_ctr = 0").select("doc", "id_ctr", "id_actor").withColumn("depth", F.lit(0)))
    depth = front
    level = 0
    while True:
        level += 1
        on = tree.alias("t").join(front.alias("f"), [F.col("t.doc") == F.col("f.doc"), F.col("t.obj_ctr") == F.col("f.id_ctr"), F.col("t.obj_actor").eqNullSafe(F.col("f.id_actor"))])
        front = cut(on.select("t.doc", "t.id_ctr", "t.id_actor").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        depth = depth.unionByName(front)
    depth = cut(depth)
    deepest = depth.agg(F.max("depth").alias("d")).first()["d"] or 0
    done = None
    for level in range(deepest, -1, -1):
        own = depth.where(F.col("depth") == level).alias("p").join(made.alias("q"), [F.col("p.doc") == F.col("q.doc"), F.col("p.id_ctr") == F.col("q.id_ctr"), F.col("p.id_actor").eqNullSafe(F.col("q.id_actor"))]).select("q.doc", "q.id_ctr", "q.id_actor", "q.kind")
        r = own.alias("o").join(rows.alias("r"), [F.col("o.doc") == F.col("r.doc"), F.col("o.id_ctr") == F.col("r.obj_ctr"), F.col("o.id_actor").eqNullSafe(F.col("r.obj_actor"))], "left")
        r = r.select("o.*", "k", "pos", F.col("r.ctr").alias("ctr"), F.col("r.actor").alias("actor"), "action", F.col("r.json").alias("json"), "s")
        if done is not None:
            r = r.alias("a").join(done.alias("d"), [F.col("a.doc") == F.col("d.doc"), F.col("a.ctr") == F.col("d.c_ctr"), F.col("a.actor").eqNullSafe(F.col("d.c_actor"))], "left")
            r = r.select("a.doc", "id_ctr", "id_actor", "kind", "k", "pos", "action", F.coalesce("d.c_json", "a.json").alias("json"), "s")
        item = F.when(F.col("kind") == "map", F.concat(_quote(F.col("k")), F.lit(":"), F.col("json"))).when(F.col("kind") == "text", F.when(F.col("s").isNotNull() & (F.col("action") == SET), F.col("s")).otherwise("￼")).otherwise(F.col("json"))
        one = F.when(F.col("action").isNotNull(), F.struct("k", "pos", item.alias("item")))
        out = r.groupBy("doc", "id_ctr", "id_actor", "kind").agg(F.array_sort(F.collect_list(one)).alias("l"))
        items = F.transform("l", lambda x: x["item"])
        body = F.when(F.col("kind") == "map", F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))).when(F.col("kind") == "text", _quote(F.array_join(items, ""))).otherwise(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
        done = cut(out.select("doc", F.col("id_ctr").alias("c_ctr"), F.col("id_actor").alias("c_actor"), body.alias("c_json")))
    return done.select("doc", F.col("c_json").alias("json"))


def _variant(v) -> tuple[int, dict | None]:
    """Action and tagged value of a JSON value."""
    if isinstance(v, dict):
        return MAKE_MAP, None
    if isinstance(v, list):
        return MAKE_LIST, None
    out = dict.fromkeys(f.name for f in VALUE.fields)
    if v is None:
        out["type"] = "null"
    elif isinstance(v, bool):
        out |= {"type": "boolean", "bool": v}
    elif isinstance(v, str):
        out |= {"type": "str", "s": v}
    elif isinstance(v, int) and -(1 << 63) <= v < 1 << 63:
        out |= {"type": "int", "i": v}
    elif isinstance(v, int) and 0 <= v < 1 << 64:
        out |= {"type": "uint", "u": Decimal(v)}
    else:
        out |= {"type": "f64", "d": float(v)}
    return SET, out


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key of a JSON object is repeated")
    return out


def _no_number(name: str):
    raise ValueError(f"no JSON number: {name}")


def operations(doc: str, value, actor: bytes) -> list[dict]:
    """Operations that build a nested value, breadth first, the keys of a map sorted."""
    if not isinstance(value, dict):
        raise ValueError("the root of a document must be an object")
    out, front = [], [(0, value)]
    for obj, v in front:  # grows as objects are met
        before = None
        items = sorted(v.items(), key=lambda kv: kv[0].encode()) if isinstance(v, dict) else [(None, x) for x in v]
        for k, x in items:
            action, tagged = _variant(x)
            ctr = len(out) + 1
            out.append(
                {"doc": doc, "ctr": ctr, "actor": actor, "obj_ctr": obj, "obj_actor": actor if obj else None, "key_str": k, "key_ctr": None if k is not None else before or 0, "key_actor": actor if k is None and before else None,
                 "insert": k is None, "action": action, "value": tagged, "expand": None, "mark_name": None, "pred": []}
            )
            before = ctr if k is None else None
            if action != SET:
                front.append((ctr, x))
    return out


def from_json(docs: DataFrame, actor: bytes, json_col: str = "json") -> DataFrame:
    """Operations that build JSON documents (doc, json) in breadth-first order; the root must be an object.

    Strings become scalars; integers int (uint beyond 64 signed bits, doubles beyond 64 bits), other numbers doubles.
    Rows are parsed where they lie: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(OPS)
        for batch in batches:
            rows: list[dict] = []
            for doc, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                if text is not None:
                    rows += operations(doc, json.loads(text, object_pairs_hook=_unique, parse_constant=_no_number), actor)
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc").cast("string"), json_col).mapInArrow(run, OPS)


def whole(ops: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """(doc, obj, pos, prop, id, kind, conflict): every visible place of every reachable object, objects in id order."""
    view = cut(winners(ops, clock))
    at = elements(ops, clock, view=view).select("doc", "ctr", "actor", "index")
    rows = view.join(at, ["doc", "ctr", "actor"], "left")
    reach = parents(view).select("doc", F.col("id_ctr").alias("obj_ctr"), F.col("id_actor").alias("obj_actor"))
    root = view.where("obj_ctr = 0").select(*OBJ).distinct()
    keep = reach.unionByName(root).distinct()
    rows = rows.alias("r").join(keep.alias("k"), [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in OBJ], "left_semi")
    return rows.select("doc", show_id(F.col("obj_ctr"), F.coalesce("obj_actor", F.unhex(F.lit("")))).alias("obj"), F.coalesce("key_str", F.col("index").cast("string")).alias("prop"), show_id(F.col("ctr"), F.col("actor")).alias("id"), "action", "conflict")

