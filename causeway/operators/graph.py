"""Queries over the change graph: heads, ancestors, clocks, missing dependencies, levels, fragments.

A change's ancestors are exactly the changes that its vector clock covers, as every actor's changes are sequential. So
once a clock is known nothing is traversed. A walk takes one job: the graph of a document of at most LARGE edges is walked
in one Arrow group, whatever its depth. Documents with more are walked by joins, a round a level; frontiers are
checkpointed in the shared folder, and what is found is one file set a round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import by_size, cut, grouped

#: Edges of a document that one task may walk.
LARGE = 1 << 20


def edges(changes: DataFrame) -> DataFrame:
    """(doc, hash, dep)"""
    return changes.select("doc", "hash", F.explode("deps").alias("dep"))


def heads(changes: DataFrame) -> DataFrame:
    """Changes that no other change depends on."""
    on = edges(changes).select("doc", F.col("dep").alias("hash")).distinct()
    return changes.join(on, ["doc", "hash"], "left_anti")


def closure(start: DataFrame, step: DataFrame) -> DataFrame:
    """All (doc, hash) reachable from `start` by (doc, hash, next), `start` included."""
    # new names: both sides may come from the same changes
    start = start.select(F.col("doc").alias("of"), F.col("hash").alias("from")).distinct()
    small, large = by_size(step, "doc", LARGE)

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        to: dict[bytes, list[bytes]] = {}
        if len(right):
            for a, b in zip(left["hash"].to_pylist(), left["next"].to_pylist()):
                to.setdefault(a, []).append(b)
        front = right["from"].to_pylist()
        seen = set(front)
        while front:
            for x in to.get(front.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    front.append(x)
        doc = left["doc"][0].as_py() if len(left) else right["of"][0].as_py()
        return pa.table({"doc": pa.array([doc] * len(seen), pa.string()), "hash": pa.array(sorted(seen), pa.binary())})

    if large is None:
        return cut(small.groupBy("doc").cogroup(start.groupBy("of")).applyInArrow(walk, "doc string, hash binary"))
    docs = cut(large.select("doc").distinct())
    there = F.col("of") == docs["doc"]
    own = small.groupBy("doc").cogroup(start.join(docs, there, "left_anti").groupBy("of")).applyInArrow(walk, "doc string, hash binary")
    begin = start.join(docs, there, "left_semi").select(F.col("of").alias("doc"), F.col("from").alias("hash"))
    return cut(own).unionByName(_closure_by_level(begin, large))


def _closure_by_level(start: DataFrame, step: DataFrame) -> DataFrame:
    """The same by a join a level."""
    seen = front = cut(start)
    while True:
        front = cut(front.join(step, ["doc", "hash"]).select("doc", F.col("next").alias("hash")).distinct().join(seen, ["doc", "hash"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def ancestors(changes: DataFrame, of: DataFrame) -> DataFrame:
    """(doc, hash): the changes of `of` (doc, hash) and everything they depend on, as far as it is known."""
    step = edges(changes).select("doc", "hash", F.col("dep").alias("next"))
    return closure(of.join(changes.select("doc", "hash"), ["doc", "hash"], "left_semi"), step)


def dependents(changes: DataFrame, of: DataFrame) -> DataFrame:
    """(doc, hash): the changes of `of` and everything that depends on them."""
    return closure(of, edges(changes).select("doc", F.col("dep").alias("hash"), F.col("hash").alias("next")))


def clock_at(changes: DataFrame, of: DataFrame) -> DataFrame:
    """(doc, actor, max_op, seq) of a set of heads (doc, hash)."""
    return clock_of(changes.join(ancestors(changes, of), ["doc", "hash"], "left_semi"))


def clock_of(changes: DataFrame) -> DataFrame:
    """The clock that covers all the given changes."""
    return changes.groupBy("doc", "actor").agg(F.max("max_op").alias("max_op"), F.max("seq").alias("seq"))


def clock_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The least clock that covers both."""
    return a.unionByName(b).groupBy("doc", "actor").agg(F.max("max_op").alias("max_op"), F.max("seq").alias("seq"))


def clock_covers(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, covers): whether clock a covers clock b, for each document of b."""
    j = b.select("doc", "actor", F.col("max_op").alias("want")).join(a.select("doc", "actor", "max_op"), ["doc", "actor"], "left")
    return j.groupBy("doc").agg(F.min(F.coalesce(F.col("max_op"), F.lit(0)) >= F.col("want")).alias("covers"))


def changes_since(changes: DataFrame, clock: DataFrame) -> DataFrame:
    """Changes that a clock doesn't cover: what a peer at that clock lacks."""
    own = changes.join(clock.select("doc", "actor", F.col("seq").alias("have")), ["doc", "actor"], "left")
    return own.where(F.col("have").isNull() | (F.col("seq") > F.col("have"))).drop("have")


def missing_deps(changes: DataFrame, queued: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(doc, hash): dependencies of queued changes, and heads asked for, that are neither applied nor queued."""
    want = edges(queued).select("doc", F.col("dep").alias("hash"))
    if of is not None:
        want = want.unionByName(of.select("doc", "hash"))
    have = changes.select("doc", "hash").unionByName(queued.select("doc", "hash"))
    return want.distinct().join(have, ["doc", "hash"], "left_anti")


def last_local_change(changes: DataFrame, actor: bytes) -> DataFrame:
    """The actor's change with the largest seq, by document."""
    own = changes.where(F.col("actor") == F.lit(actor))
    return own.groupBy("doc").agg(F.max_by(F.struct(*own.columns), "seq").alias("c")).select("c.*")


def change_of_op(changes: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, ctr, actor, hash): the change that holds each operation id."""
    c = changes.select("doc", "actor", "hash", "start_op", "max_op")
    return ids.join(c, ["doc", "actor"]).where("ctr between start_op and max_op").select("doc", "ctr", "actor", "hash")


def has_heads(changes: DataFrame, of: DataFrame) -> DataFrame:
    """(doc, known): whether all the asked heads are applied."""
    j = of.select("doc", "hash").join(changes.select("doc", "hash", F.lit(True).alias("k")), ["doc", "hash"], "left")
    return j.groupBy("doc").agg(F.min(F.coalesce("k", F.lit(False))).alias("known"))


def levels(changes: DataFrame) -> DataFrame:
    """(doc, hash, level): length of the longest path to a change without dependencies; an order to apply changes in.

    Rounds release every change whose dependencies all have a level, as a causal queue does; what never gets one (its
    dependencies are missing) has no row.
    """
    rows = changes.select("doc", "hash", "deps").withColumn("size", F.size("deps") + 1)
    large = cut(rows.groupBy("doc").agg(F.sum("size").alias("size")).where(F.col("size") > LARGE).select("doc"))

    def walk(t: pa.Table) -> pa.Table:
        deps = dict(zip(t["hash"].to_pylist(), t["deps"].to_pylist()))
        after: dict[bytes, list[bytes]] = {}
        for h, own in deps.items():
            for d in own:
                after.setdefault(d, []).append(h)
        wait = {h: len(own) for h, own in deps.items()}
        level = {h: 0 for h, n in wait.items() if not n}
        front = list(level)
        while front:
            h = front.pop()  # every path to it has been counted
            for x in after.get(h, ()):
                wait[x] -= 1
                level[x] = max(level.get(x, 0), level[h] + 1)
                if not wait[x]:
                    front.append(x)
        out = [h for h in level if not wait[h]]
        return pa.table({"doc": pa.array([t["doc"][0].as_py()] * len(out), pa.string()), "hash": pa.array(out, pa.binary()), "level": pa.array([level[h] for h in out], pa.int32())})

    kind = "doc string, hash binary, level int"
    if large.isEmpty():
        return grouped(rows, ["doc"], walk, kind)
    own = grouped(rows.join(large, "doc", "left_anti"), ["doc"], walk, kind)
    return own.unionByName(_levels_by_round(changes.join(large, "doc", "left_semi")))


def _levels_by_round(changes: DataFrame) -> DataFrame:
    """The same by a join a level."""
    e = edges(changes)
    needs = changes.select("doc", "hash", F.size("deps").alias("needs"))
    done = front = cut(needs.where("needs = 0").select("doc", "hash", F.lit(0).alias("level")))
    i = 0
    while True:
        i += 1
        # only dependents of the last round can become ready
        touched = e.join(front.select("doc", F.col("hash").alias("dep")), ["doc", "dep"], "left_semi").select("doc", "hash").distinct()
        ready = (
            e.join(touched, ["doc", "hash"], "left_semi")
            .join(done.select("doc", F.col("hash").alias("dep"), F.lit(1).alias("met")), ["doc", "dep"], "left")
            .groupBy("doc", "hash")
            .agg(F.count("*").alias("n"), F.sum("met").alias("met"))
            .where("n = met")
        )
        front = cut(ready.select("doc", "hash", F.lit(i).alias("level")).join(done, ["doc", "hash"], "left_anti"))
        if front.isEmpty():
            return done
        done = done.unionByName(front)


def hash_level(h) -> object:
    """Leading zero bytes of a hash."""
    return (F.length(F.regexp_extract(F.hex(h), "^((?:00)*)", 1)) / 2).cast("int")


def fragments(changes: DataFrame, level: int = 1) -> DataFrame:
    """(doc, head, level, members): each change of at least the level, with the changes it covers that no earlier
    fragment head below it covers.

    A member belongs to the first head (by level of the graph) that reaches it.
    """
    rows = changes.select("doc", "hash", "deps").withColumn("level", hash_level(F.col("hash")))
    large = cut(rows.groupBy("doc").agg(F.sum(F.size("deps") + 1).alias("size")).where(F.col("size") > LARGE).select("doc"))

    def walk(t: pa.Table) -> pa.Table:
        deps = dict(zip(t["hash"].to_pylist(), t["deps"].to_pylist()))
        tops = {h: n for h, n in zip(t["hash"].to_pylist(), t["level"].to_pylist()) if n >= level}
        out = []
        for head in tops:
            seen, front = {head}, [head]
            while front:
                for x in deps.get(front.pop(), ()):
                    if x not in seen and x not in tops:
                        seen.add(x)
                        front.append(x)
            out.append((t["doc"][0].as_py(), head, tops[head], len(seen)))
        return pa.Table.from_pylist([dict(zip(("doc", "head", "level", "members"), r)) for r in out], schema=pa.schema([("doc", pa.string()), ("head", pa.binary()), ("level", pa.int32()), ("members", pa.int64())]))

    kind = "doc string, head binary, level int, members long"
    if large.isEmpty():
        return grouped(rows, ["doc"], walk, kind)
    own = grouped(rows.join(large, "doc", "left_anti"), ["doc"], walk, kind)
    return own.unionByName(_fragments_by_level(changes.join(large, "doc", "left_semi"), level))


def _fragments_by_level(changes: DataFrame, level: int) -> DataFrame:
    """The same by a join a level."""
    heads_of = changes.where(hash_level(F.col("hash")) >= level).select("doc", F.col("hash").alias("head"), hash_level(F.col("hash")).alias("level"))
    down = edges(changes).select("doc", "hash", F.col("dep").alias("next"))
    # walk down from all heads at once, stopping at other heads
    seen = cut(heads_of.select("doc", "head", F.col("head").alias("hash")))
    front = seen
    stop = heads_of.select("doc", F.col("head").alias("hash"))
    while True:
        front = cut(
            front.join(down, ["doc", "hash"]).select("doc", "head", F.col("next").alias("hash")).distinct().join(stop, ["doc", "hash"], "left_anti").join(seen, ["doc", "head", "hash"], "left_anti")
        )
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.groupBy("doc", "head").agg(F.count("*").alias("members")).join(heads_of, ["doc", "head"]).select("doc", "head", "level", "members")


def by_hash(changes: DataFrame, of: DataFrame) -> DataFrame:
    """The changes of some hashes (doc, hash), whole: metadata, dependencies and place."""
    return changes.join(of.select("doc", "hash").distinct(), ["doc", "hash"], "left_semi")


def hash_of_seq(changes: DataFrame, of: DataFrame) -> DataFrame:
    """(doc, actor, seq, hash) of asked sequence numbers (doc, actor, seq); the hash is null if there is no such change."""
    return of.select("doc", "actor", "seq").distinct().join(changes.select("doc", "actor", "seq", "hash"), ["doc", "actor", "seq"], "left")
