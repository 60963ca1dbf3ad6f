"""The engine's queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import cut
from ..functions.schema import parse_cursor, parse_id, show_cursor, show_id, text_width
from ..operators import anonymize, codec, diff, graph, hydrate, marks, merge, register, sequence, sync, write
from . import synth as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DAY1, DAY2 = "2024-01-04", "2024-01-08"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def w(*parts: str) -> str:
    return "with " + ",".join(parts)




def num():
    """A register's value as a double."""
    return F.coalesce(F.col("value.d"), F.col("value.i").cast("double"))


N_SQL = "coalesce(cast(total as double), v)"
who = S.actor_no

# -- registers


@query(w(S.SQL_OPS, S.sql_live(), S.sql_win()) + f" select doc, k, {N_SQL} as val, ctr, actor as who, n > 1 as conflict, n from win")
def register_get(spark, sf_dir):
    v = register.winners(S.ops(spark, sf_dir))
    return v.select("doc", F.col("key_str").alias("k"), num().alias("val"), "ctr", who("actor").alias("who"), "conflict", "n")


@query(w(S.SQL_OPS, S.sql_live(DAY2), S.sql_win()) + f" select doc, k, {N_SQL} as val, ctr, actor as who, n > 1 as conflict from win")
def register_get_at(spark, sf_dir):
    o = S.ops(spark, sf_dir)
    v = register.winners(o, S.clock_before(o, DAY2))
    return v.select("doc", F.col("key_str").alias("k"), num().alias("val"), "ctr", who("actor").alias("who"), "conflict")


@query(w(S.SQL_OPS, S.sql_live()) + f" select doc, k, {N_SQL} as val, ctr, actor as who, row_number() over (partition by doc, k order by ctr, actor) as place from live")
def register_get_all(spark, sf_dir):
    v = register.get_all(S.ops(spark, sf_dir))
    return v.select("doc", F.col("key_str").alias("k"), num().alias("val"), "ctr", who("actor").alias("who"), F.col("place").cast("long").alias("place"))


@query(w(S.SQL_OPS, S.sql_live()) + " select distinct doc, k from live")
def register_keys(spark, sf_dir):
    return register.keys(register.winners(S.ops(spark, sf_dir))).select("doc", F.col("key_str").alias("k"))


@query(w(S.SQL_OPS, S.sql_live(), S.sql_win()) + f" select doc, list(k || '=' || cast(round({N_SQL} * 100) as bigint) order by k) as vals from win group by doc")
def register_values(spark, sf_dir):
    v = register.winners(S.ops(spark, sf_dir))
    item = F.concat("key_str", F.lit("="), F.round(num() * 100).cast("long").cast("string"))
    return v.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("key_str", item.alias("x")))), lambda s: s["x"]).alias("vals"))


@query(w(S.SQL_OPS, S.sql_live(), S.sql_win()) + f" select doc, k, {N_SQL} as val, n > 1 as conflict from win where k >= 'click/2' and k < 'purchase'")
def register_map_range(spark, sf_dir):
    v = register.map_range(register.winners(S.ops(spark, sf_dir)), "click/2", "purchase")
    return v.select("doc", F.col("key_str").alias("k"), num().alias("val"), "conflict")


@query(w(S.SQL_OPS, S.sql_live(DAY2), S.sql_win()) + f" select doc, k, {N_SQL} as val from win where k > 'click/2' and k <= 'view/3'")
def register_map_range_at(spark, sf_dir):
    o = S.ops(spark, sf_dir)
    v = register.map_range(register.winners(o, S.clock_before(o, DAY2)), "click/2", "view/3", low_open=True, high_closed=True)
    return v.select("doc", F.col("key_str").alias("k"), num().alias("val"))


@query(w(S.SQL_OPS, S.sql_live(DAY1, "a"), S.sql_live(None, "b")) + " select doc, (select count(distinct k) from a where a.doc = b.doc) as then_length, count(distinct k) as length from b group by doc")
def register_length(spark, sf_dir):
    o = S.ops(spark, sf_dir)
    now = register.length(register.winners(o)).select("doc", "length")
    then = register.length(register.winners(o, S.clock_before(o, DAY1))).select("doc", F.col("length").alias("then_length"))
    return now.join(then, "doc", "left").select("doc", F.coalesce("then_length", F.lit(0).cast("long")).alias("then_length"), "length")


@query(w(S.SQL_OPS, S.sql_live()) + " select doc, k, count(*) as n, list(ctr || '@0' || actor order by ctr, actor) as ids from live group by doc, k having count(*) > 1")
def register_conflicts(spark, sf_dir):
    c = register.conflicts(S.ops(spark, sf_dir))
    ids = F.array_sort(F.transform(F.map_keys("values"), lambda x: F.struct(F.split(x, "@")[0].cast("long").alias("c"), x.alias("x"))))
    return c.select("doc", F.expr("substr(key, 2)").alias("k"), "n", F.transform(ids, lambda x: x["x"]).alias("ids"))


@query(w(S.SQL_OPS, S.sql_live(DAY1, "a"), S.sql_live(DAY2, "b")) + " select b.doc, b.k, b.ctr, a.total as old, b.total as new, cast(b.total - a.total as bigint) as diff from a join b on a.doc = b.doc and a.ctr = b.ctr where a.counter")
def register_counter_diff(spark, sf_dir):
    o = S.ops(spark, sf_dir)
    d = register.counter_diff(o, S.clock_before(o, DAY1), S.clock_before(o, DAY2))
    return d.select("doc", F.expr("substr(key, 2)").alias("k"), "ctr", "old", "new", "diff")


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select doc, (select count(*) from ops o where o.doc = c.doc) as num_ops, count(*) as num_changes, count(distinct actor) as num_actors from changes c group by doc")
def document_stats(spark, sf_dir):
    return register.stats(S.ops(spark, sf_dir), S.changes(spark, sf_dir))


@query(w(S.SQL_OPS, S.sql_live(DAY2)) + " select doc, count(*) as visible, count(*) filter (counter) as counters, count(distinct actor) as actors from live group by doc")
def visible_at_clock(spark, sf_dir):
    o = S.ops(spark, sf_dir)
    v = register.visible(o, S.clock_before(o, DAY2))
    return v.groupBy("doc").agg(F.count("*").alias("visible"), F.sum((F.col("value.type") == "counter").cast("long")).alias("counters"), F.count_distinct("actor").alias("actors"))


# -- change graph


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select doc, hash, actor as who from changes where hash not in (select dep from edges)")
def graph_heads(spark, sf_dir):
    return graph.heads(S.changes(spark, sf_dir)).select("doc", F.lower(F.hex("hash")).alias("hash"), who("actor").alias("who"))


def _heads_before(c: DataFrame, day: str) -> DataFrame:
    return graph.heads(c.where(F.col("ep") < F.lit(day).cast("timestamp"))).select("doc", "hash")


@query(w(S.SQL_OPS) + f" select doc, actor as who, max(ctr) as max_op from ops where ep < timestamp '{DAY2}' group by doc, actor")
def graph_clock_at(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    return graph.clock_at(c, _heads_before(c, DAY2)).select("doc", who("actor").alias("who"), "max_op")


@query(
    w(S.SQL_OPS, S.SQL_CHANGES)
    + f""", up as (with recursive walk as (select doc, hash from changes where ep = (select max(ep) from changes where ep < timestamp '{DAY2}') union select e.doc, e.dep from edges e join walk on walk.hash = e.hash and walk.doc = e.doc) select * from walk)
    select doc, count(*) as n, min(hash) as least from up group by doc"""
)
def graph_ancestors(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    last = c.where(F.col("ep") < F.lit(DAY2).cast("timestamp")).agg(F.max("ep").alias("m"))
    of = c.join(F.broadcast(last), c["ep"] == last["m"]).select("doc", "hash")  # one row
    return graph.ancestors(c, of).groupBy("doc").agg(F.count("*").alias("n"), F.min(F.lower(F.hex("hash"))).alias("least"))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + f" select doc, hash, actor as who, seq, num_ops from changes where ep >= timestamp '{DAY2}'")
def graph_changes_since(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    out = graph.changes_since(c, graph.clock_of(c.where(F.col("ep") < F.lit(DAY2).cast("timestamp"))))
    return out.select("doc", F.lower(F.hex("hash")).alias("hash"), who("actor").alias("who"), "seq", "num_ops")


@query(w(S.SQL_OPS, S.SQL_CHANGES) + f" select distinct e.doc, e.dep as hash from edges e join changes c on c.hash = e.dep join changes d on d.hash = e.hash where c.ep >= timestamp '{DAY1}' and d.ep >= timestamp '{DAY1}' and d.seq % 3 = 0 and c.seq % 3 <> 0")
def graph_missing_deps(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    day = F.lit(DAY1).cast("timestamp")
    out = graph.missing_deps(c.where(F.col("ep") < day), c.where((F.col("ep") >= day) & (F.col("seq") % 3 == 0)))
    return out.select("doc", F.lower(F.hex("hash")).alias("hash"))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select doc, hash, seq from changes c where actor = 2 and seq = (select max(seq) from changes d where d.doc = c.doc and d.actor = 2)")
def graph_last_local_change(spark, sf_dir):
    return graph.last_local_change(S.changes(spark, sf_dir), b"\x02").select("doc", F.lower(F.hex("hash")).alias("hash"), "seq")


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select o.doc, o.ctr, o.actor as who, c.hash from ops o join changes c on c.doc = o.doc and c.actor = o.actor and c.ep = o.ep where o.action = 3")
def graph_change_of_op(spark, sf_dir):
    o = S.ops(spark, sf_dir).where("action = 3").select("doc", "ctr", "actor")
    return graph.change_of_op(S.changes(spark, sf_dir), o).select("doc", "ctr", who("actor").alias("who"), F.lower(F.hex("hash")).alias("hash"))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select c.doc, c.hash, cast(d.r as int) as level from changes c join (select doc, ep, row_number() over (partition by doc order by ep) - 1 as r from days) d on d.doc = c.doc and d.ep = c.ep")
def graph_levels(spark, sf_dir):
    return graph.levels(S.changes(spark, sf_dir)).select("doc", F.lower(F.hex("hash")).alias("hash"), "level")


@query(
    w(S.SQL_OPS, S.SQL_CHANGES)
    + """, down as (with recursive walk as (select doc, hash from changes where seq = 3 and actor = 1 union select e.doc, e.hash from edges e join walk on walk.hash = e.dep and walk.doc = e.doc) select * from walk) select doc, count(*) as n from down group by doc"""
)
def graph_dependents(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    return graph.dependents(c, c.where("seq = 3").where(who("actor") == 1).select("doc", "hash")).groupBy("doc").agg(F.count("*").alias("n"))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + f" select doc, bool_and(ep < timestamp '{DAY2}') as known from changes where hash not in (select dep from edges) group by doc")
def graph_has_heads(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    return graph.has_heads(c.where(F.col("ep") < F.lit(DAY2).cast("timestamp")), graph.heads(c))


@query(
    w(S.SQL_OPS, S.SQL_CHANGES)
    + f""", a as (select doc, actor, max(seq) as seq from changes where ep < timestamp '{DAY2}' group by doc, actor), b as (select doc, actor, max(seq) as seq from changes where actor <> 3 group by doc, actor)
    select coalesce(a.doc, b.doc) as doc, coalesce(a.actor, b.actor) as who, greatest(coalesce(a.seq, 0), coalesce(b.seq, 0)) as seq from a full join b on a.doc = b.doc and a.actor = b.actor"""
)
def graph_clock_merge(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    m = graph.clock_merge(graph.clock_of(c.where(F.col("ep") < F.lit(DAY2).cast("timestamp"))), graph.clock_of(c.where(who("actor") != 3)))
    return m.select("doc", who("actor").alias("who"), "seq")


@query(w(S.SQL_OPS) + f", a as (select doc, actor, max(ctr) as m from ops where ep < timestamp '{DAY2}' group by doc, actor), b as (select doc, actor, max(ctr) as m from ops where ep < timestamp '{DAY1}' group by doc, actor) select b.doc, bool_and(coalesce(a.m, 0) >= b.m) as covers from b left join a on a.doc = b.doc and a.actor = b.actor group by b.doc")
def graph_clock_covers(spark, sf_dir):
    o = S.ops(spark, sf_dir)
    return graph.clock_covers(S.clock_before(o, DAY2), S.clock_before(o, DAY1))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select hash, case when substr(hash, 1, 2) <> '00' then 0 when substr(hash, 3, 2) <> '00' then 1 else 2 end as level from changes")
def graph_hash_levels(spark, sf_dir):
    return S.changes(spark, sf_dir).select(F.lower(F.hex("hash")).alias("hash"), graph.hash_level(F.col("hash")).alias("level"))


@query()
def graph_fragments(spark, sf_dir):
    return graph.fragments(S.changes(spark, sf_dir), 1).select("doc", F.lower(F.hex("head")).alias("head"), "level", "members")


@query(
    w(S.SQL_OPS, S.SQL_CHANGES)
    + """, tops as (select doc, before as ep from days where before is not null union select doc, max(ep) from days group by doc)
    select c.doc, c.hash, (select count(*) from ops o where o.doc = c.doc and o.ep <= c.ep and not (o.ep = c.ep and o.actor <> c.actor)) as ops_then from changes c"""
)
def history_snapshots(spark, sf_dir):
    """Every change's own version: its clock is its actor's counter and everyone's of the days before."""
    c = S.changes(spark, sf_dir)
    per = S.ops(spark, sf_dir).groupBy("doc", "actor", "ep").agg(F.count("*").alias("n"))
    days = per.groupBy("doc", "ep").agg(F.sum("n").alias("n"))
    upto = days.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("doc").orderBy("ep").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("doc", "ep", "before")
    return c.join(upto, ["doc", "ep"]).select("doc", F.lower(F.hex("hash")).alias("hash"), (F.col("before") + F.col("num_ops")).alias("ops_then"))


# -- merge


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select doc, hash from changes where actor = 1 or seq % 2 = 1")
def merge_changes_added(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    mine = c.where((who("actor") != 1) & (F.col("seq") % 2 == 0))
    return merge.added(mine, c).select("doc", F.lower(F.hex("hash")).alias("hash"))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + f", d as (select min(before) as gap from days where before >= timestamp '{DAY1}') select doc, count(*) filter (ep <= (select min(x.ep) from days x where x.doc = c.doc and x.before >= timestamp '{DAY1}' ) and ep < timestamp '{DAY1}') as applied, count(*) filter (ep > (select min(x.ep) from days x where x.doc = c.doc and x.ep >= timestamp '{DAY1}')) as queued from changes c group by doc")
def merge_apply_queue(spark, sf_dir):
    """A peer's changes arrive without those of the first day from DAY1 on: later ones wait."""
    c = S.changes(spark, sf_dir)
    gap = c.where(F.col("ep") >= F.lit(DAY1).cast("timestamp")).groupBy("doc").agg(F.min("ep").alias("gap"))
    arrived = c.join(gap, "doc", "left").where("gap is null or ep <> gap").drop("gap")
    mine = arrived.where("seq = 1 and size(deps) = 0")
    applied, queued = merge.apply_changes(mine, arrived)
    a, b = (x.groupBy("doc").agg(F.count("*").alias(n)) for x, n in ((applied, "applied"), (queued, "queued")))
    return a.join(b, "doc", "full").select("doc", F.coalesce("applied", F.lit(0).cast("long")).alias("applied"), F.coalesce("queued", F.lit(0).cast("long")).alias("queued"))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select doc, actor as who, seq, 2 as n from changes where seq % 7 = 2")
def merge_duplicates(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    forged = c.where("seq % 7 = 2").withColumn("hash", F.unhex(F.sha2("hash", 256)))
    return merge.duplicates(c.unionByName(forged).unionByName(c)).select("doc", who("actor").alias("who"), "seq", F.col("n").cast("int").alias("n"))


@query(w(S.SQL_OPS, S.sql_live(), S.sql_win()) + f" select doc, k, {N_SQL} as val, n from win")
def merge_converges(spark, sf_dir):
    """Two replicas with half of the log each, merged twice over, give the register view of the whole log."""
    o = S.ops(spark, sf_dir).drop("ep")
    a, b = o.where(who("actor") < 2), o.where("ctr % 3 > 0")
    rest = o.where((who("actor") >= 2) & (F.col("ctr") % 3 == 0))
    both = merge.merge_ops(merge.merge_ops(a, b), rest.unionByName(a.limit(0)))
    return register.winners(merge.merge_ops(both, b)).select("doc", F.col("key_str").alias("k"), num().alias("val"), "n")


@query(w(S.SQL_OPS) + f" select doc, count(*) as ops, count(distinct actor) as actors from ops where ep < timestamp '{DAY2}' group by doc")
def merge_fork_at(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    _, own = merge.fork_at(c, S.ops(spark, sf_dir), _heads_before(c, DAY2))
    return own.groupBy("doc").agg(F.count("*").alias("ops"), F.count_distinct("actor").alias("actors"))


@query(
    w(S.SQL_OPS)
    + """, p as (select n.doc, n.ctr as s_ctr, n.action, n.i, max(o.ctr) as ctr, o.actor from ops n join ops o on n.doc = o.doc and n.k = o.k and o.action <> 5 and n.ctr > o.ctr and (n.actor = o.actor or n.ep > o.ep) group by n.doc, n.ctr, n.action, n.i, o.actor)
    select p.doc, p.ctr, actor as who, s_ctr as succ_ctr, case when action = 5 then p.i end as inc from p"""
)
def merge_successors(spark, sf_dir):
    return merge.successors(S.ops(spark, sf_dir)).select("doc", "ctr", who("actor").alias("who"), "succ_ctr", "inc")


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select c.doc, c.hash, count(*) as num_ops, list(o.ctr || ':' || o.action order by o.ctr) as ops from changes c join ops o on o.doc = c.doc and o.actor = c.actor and o.ep = c.ep group by c.doc, c.hash")
def merge_changes_from_ops(spark, sf_dir):
    out = merge.changes_from_ops(S.ops(spark, sf_dir), S.changes(spark, sf_dir))
    return out.select("doc", F.lower(F.hex("hash")).alias("hash"), "num_ops", F.transform("ops", lambda x: F.concat_ws(":", x["ctr"].cast("string"), x["action"].cast("string"))).alias("ops"))


@query(
    w(S.SQL_OPS, S.SQL_CHANGES)
    + """, bad as (with recursive walk as (select doc, hash from changes where actor = 3 and seq = 2 union select e.doc, e.hash from edges e join walk on walk.hash = e.dep and walk.doc = e.doc) select * from walk)
    select doc, hash from changes where hash not in (select hash from bad)"""
)
def merge_drop_branch(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    return merge.drop_branch(c, c.where("seq = 2").where(who("actor") == 3).select("doc", "hash")).select("doc", F.lower(F.hex("hash")).alias("hash"))


@query(w(S.SQL_OPS) + " select doc, k, ctr, actor as who, 'b' as side from ops where action = 3 and ctr % 2 = 0")
def merge_differing(spark, sf_dir):
    o = S.ops(spark, sf_dir).select("doc", F.col("key_str").alias("k"), "ctr", who("actor").alias("who"), "action")
    return merge.differing(o.where("action <> 3 or ctr % 2 = 1"), o).drop("action")


# -- differences

_DIFF = w(S.SQL_OPS, S.sql_live(DAY1, "la"), S.sql_win("la", "a"), S.sql_live(DAY2, "lb"), S.sql_win("lb", "b")) + """,
d as (select coalesce(a.doc, b.doc) as doc, coalesce(a.k, b.k) as k, case when a.k is null then 'add' when b.k is null then 'del' when a.ctr = b.ctr and a.actor = b.actor then 'same' else 'put' end as class,
  coalesce(a.n, 0) as n_old, coalesce(b.n, 0) as n_new, a.total as old_total, b.total as new_total, b.v as new_v, b.counter from a full join b on a.doc = b.doc and a.k = b.k),
e as (select *, n_new > 1 and not (class = 'same' and n_old > 1) as conflict, class = 'same' and n_old > 1 and n_new = 1 as reput from d)"""


def _diff(spark, sf_dir) -> DataFrame:
    o = S.ops(spark, sf_dir)
    return diff.diff_at(o, S.clock_before(o, DAY1), S.clock_before(o, DAY2))


@query(_DIFF + " select doc, k, class, n_old, n_new, conflict, reput from e")
def diff_versions(spark, sf_dir):
    return _diff(spark, sf_dir).select("doc", F.expr("substr(key, 2)").alias("k"), "class", "n_old", "n_new", "conflict", "reput")


@query(
    _DIFF
    + """, p as (select *, case when class = 'del' then 'delete_map' when class in ('add', 'put') or reput then 'put_map' when counter and old_total <> new_total then 'increment' when class = 'same' and conflict then 'flag_conflict' end as patch from e)
    select doc, k as key, patch, case when patch = 'delete_map' then null when patch = 'increment' then cast(new_total - old_total as double) else coalesce(cast(new_total as double), new_v) end as val, conflict from p where patch is not null"""
)
def diff_patches(spark, sf_dir):
    return diff.map_patches(_diff(spark, sf_dir)).select("doc", "key", "patch", F.col("value").cast("double").alias("val"), "conflict")


@query(w(S.SQL_OPS, S.sql_live(), S.sql_win()) + f" select doc, 'k' || k as key, 'put' as patch, {N_SQL} as val, n > 1 as conflict from win")
def diff_current_state(spark, sf_dir):
    return diff.current_state(register.winners(S.ops(spark, sf_dir))).select("doc", "key", "patch", F.col("value").cast("double").alias("val"), "conflict")


@query(
    w(S.SQL_LISTS)
    + """, r as (select *, case when n % 5 = 0 then 'delete_seq' else 'insert' end as patch from pos where n > 4),
    q as (select doc, pos, patch, text, (select count(*) from pos p where p.doc = r.doc and p.pos < r.pos and not (p.n % 5 = 0)) as index from r where patch = 'insert')
    select doc, index, patch, text as val from q"""
)
def diff_list(spark, sf_dir):
    """From the version with the first four turns to now."""
    o = S.lists(spark, sf_dir)
    before = o.where("ctr <= 5").groupBy("doc", "actor").agg(F.max("ctr").alias("max_op"))
    p = diff.list_patches(o, before, None)
    return p.select("doc", "index", "patch", F.col("value").alias("val"))


# -- sequences


@query(w(S.SQL_LISTS) + " select doc, n, pos from pos")
def sequence_order(spark, sf_dir):
    return sequence.order(S.lists(spark, sf_dir)).select("doc", (F.col("ctr") - 1).alias("n"), "pos")


@query(w(S.SQL_LISTS) + " select doc, n, pos from pos")
def sequence_order_by_doubling(spark, sf_dir):
    return sequence.order_by_doubling(S.lists(spark, sf_dir)).select("doc", (F.col("ctr") - 1).alias("n"), "pos")


@query(w(S.SQL_LISTS) + " select doc, n, index, cast(start as bigint) as start, length(text) as width from shown")
def sequence_elements(spark, sf_dir):
    return sequence.elements(S.lists(spark, sf_dir)).select("doc", (F.col("e_ctr") - 1).alias("n"), "index", "start", "width")


@query(w(S.SQL_LISTS) + " select doc, index, text from shown where index >= 2 and index < 5")
def sequence_list_range(spark, sf_dir):
    return sequence.list_range(sequence.elements(S.lists(spark, sf_dir)), 2, 5).select("doc", "index", F.col("value.s").alias("text"))


@query(w(S.SQL_LISTS) + " select doc, n, index from shown where start <= 100 and 100 < start + length(text)")
def sequence_seek(spark, sf_dir):
    return sequence.at_text_index(sequence.elements(S.lists(spark, sf_dir)), 100).select("doc", (F.col("e_ctr") - 1).alias("n"), "index")


@query(w(S.SQL_LISTS) + " select doc, count(*) as length, cast(sum(length(text)) as bigint) as chars from shown group by doc")
def sequence_length(spark, sf_dir):
    e = sequence.elements(S.lists(spark, sf_dir))
    return e.groupBy("doc").agg(F.count("*").alias("length"), F.sum("width").alias("chars"))


@query(w(S.SQL_TEXTS) + " select doc, string_agg(s, '' order by i) as text from line group by doc")
def sequence_text(spark, sf_dir):
    return sequence.text(sequence.elements(S.texts(spark, sf_dir))).select("doc", "text")


@query("select doc_id, length(coalesce(text, '')) as points, strlen(coalesce(text, '')) as bytes, length(coalesce(text, '')) + (select count(*) from (select unnest(string_split(coalesce(text, ''), '')) as c) where unicode(c) > 65535) as units from documents")
def text_widths(spark, sf_dir):
    t = F.coalesce(F.col("text"), F.lit(""))
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", *[text_width(t, e).cast("long").alias(n) for e, n in (("unicode", "points"), ("utf8", "bytes"), ("utf16", "units"))])


@query()
def text_graphemes(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", text_width(F.coalesce("text", F.lit("")), "grapheme").alias("graphemes"))


@query(
    w(S.SQL_LISTS)
    + """, up as (with recursive walk as (select doc, n, n as cur from tree union all select w.doc, w.n, t.up from walk w join tree t on t.doc = w.doc and t.n = w.cur where w.cur % 5 = 0 and t.up > 0) select doc, n, min(cur) filter (cur % 5 <> 0) as found from walk group by doc, n)
    select p.doc, p.n, 'after' as move, (select count(*) from shown s where s.doc = p.doc and s.pos < p.pos) as position from pos p
    union all select u.doc, u.n, 'before', coalesce((select count(*) from shown s join pos q on q.doc = s.doc and q.n = u.found where s.doc = u.doc and s.pos < q.pos), 0) from up u
    union all select doc, n, 'start', 0 from pos
    union all select p.doc, p.n, 'end', (select count(*) from shown s where s.doc = p.doc) from pos p"""
)
def cursor_positions(spark, sf_dir):
    """A cursor of each move for every element."""
    o = S.lists(spark, sf_dir)
    c = o.where("insert").select("doc", "obj_ctr", "obj_actor", "ctr", "actor", F.explode(F.array(*map(F.lit, ("start", "end", "before", "after")))).alias("move"))
    return sequence.cursor_positions(o, c).select("doc", (F.col("ctr") - 1).alias("n"), "move", "position")


@query("select event_id as n, true as ok, case when event_id % 4 = 0 then 's' when event_id % 4 = 1 then 'e' when event_id % 4 = 2 then '-' || event_id || '@0' || user_id % 4 else event_id || '@0' || user_id % 4 end as text from events where event_id > 0")
def cursor_codec(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").where("event_id > 0").select("event_id", S.actor(F.col("user_id") % 4).alias("actor"))
    move = F.element_at(F.array(F.lit("start"), F.lit("end"), F.lit("before"), F.lit("after")), (F.col("event_id") % 4 + 1).cast("int"))
    e = e.withColumn("move", move).withColumn("text", show_cursor(F.col("event_id"), F.col("actor"), F.col("move")))
    p = parse_cursor(F.col("text"))
    ok = (p["move"] == F.col("move")) & (F.col("move").isin("start", "end") | ((p["ctr"] == F.col("event_id")) & (p["actor"] == F.col("actor"))))
    return e.select(F.col("event_id").alias("n"), ok.alias("ok"), "text")


@query("select event_id as n, event_id || '@0' || user_id % 4 as id, true as ok from events where event_id > 0")
def id_codec(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").where("event_id > 0").select("event_id", S.actor(F.col("user_id") % 4).alias("actor"))
    e = e.withColumn("id", show_id(F.col("event_id"), F.col("actor")))
    p = parse_id(F.col("id"))
    return e.select(F.col("event_id").alias("n"), "id", ((p["ctr"] == F.col("event_id")) & (p["actor"] == F.col("actor"))).alias("ok"))


# -- marks and spans


@query(
    w(S.SQL_TEXTS)
    + """ select m.doc, cast(a.start as bigint) as s, cast(b.start + length(b.s) as bigint) as e, 'bold' as name, 'true' as val from marked m join lat a on a.doc = m.doc and a.i = 1 join lat b on b.doc = m.doc and b.i = 2
    union all select m.doc, cast(a.start as bigint), cast(b.start + length(b.s) as bigint), 'colour', lang from marked m join lat a on a.doc = m.doc and a.i = n - 3 join lat b on b.doc = m.doc and b.i = n - 1 where lang is not null"""
)
def marks_intervals(spark, sf_dir):
    m = marks.intervals(S.texts(spark, sf_dir))
    return m.select("doc", F.col("start").alias("s"), F.col("end").alias("e"), "name", F.col("value").alias("val"))


@query(
    w(S.SQL_TEXTS)
    + """, flag as (select t.doc, t.i, t.s, t.start, coalesce(m.n is not null and t.i between 1 and 2, false) as b, case when m.n is not null and t.i between m.n - 3 and m.n - 1 then m.lang end as c from lat t left join marked m on m.doc = t.doc),
    y as (select *, concat_ws(',', case when b then 'bold=true' end, 'colour=' || c) as mk from flag), z as (select *, row_number() over (partition by doc order by i) - row_number() over (partition by doc, mk order by i) as g from y)
    select doc, mk as marks, cast(min(start) as bigint) as s, cast(max(start + length(s)) as bigint) as e, count(*) as n_lines from z group by doc, mk, g"""
)
def marks_spans(spark, sf_dir):
    s = marks.spans(S.texts(spark, sf_dir))
    return s.select("doc", "marks", F.col("start").alias("s"), F.col("end").alias("e"), (F.length("text") - F.length(F.replace("text", F.lit("\n")))).cast("long").alias("n_lines"))


@query(
    """with x as (select user_id%4 as obj, event_id as pos, value>50 as m, length(event_type) as w from events),
y as (select *, row_number() over (partition by obj order by pos) - row_number() over (partition by obj,m order by pos) as g,
             sum(w) over (partition by obj order by pos rows between unbounded preceding and current row) - w as start_at from x)
select obj, m, cast(min(start_at) as bigint) as span_start, cast(max(start_at+w) as bigint) as span_end, count(*) as n from y group by obj, m, g"""
)
def spans_of_events(spark, sf_dir):
    x = S.table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("obj"), F.col("event_id").alias("pos"), (F.col("value") > 50).alias("m"), F.length("event_type").cast("long").alias("w"))
    return marks.islands(x, ["obj"], ["m"], "pos", "w")


@query(
    w(S.SQL_TEXTS)
    + """ select doc, 'bold' as name, 'true' as val from marked m join lat a using (doc) join lat b using (doc) where a.i = 1 and b.i = 2 and 60 >= a.start and 60 < b.start + length(b.s)
    union all select doc, 'colour', lang from marked m join lat a using (doc) join lat b using (doc) where lang is not null and a.i = n - 3 and b.i = n - 1 and 60 >= a.start and 60 < b.start + length(b.s)"""
)
def marks_at_position(spark, sf_dir):
    return marks.marks_at(marks.intervals(S.texts(spark, sf_dir)), 60).select("doc", "name", F.col("value").alias("val"))


_EVEN = "select m.doc, n, m.lang, doc_id % 2 = 0 as bad from marked m join src using (doc)"


def _crossed(spark, sf_dir) -> DataFrame:
    """The texts, in which the bold mark of every document of even id ends before it begins."""
    o = S.texts(spark, sf_dir)
    even = F.substring("doc", 2, 20).cast("long") % 2 == 0
    at = F.when(even & (F.col("ctr") == 1_000_000), 4).when(even & (F.col("ctr") == 1_000_001), 2).otherwise(F.col("key_ctr"))
    return o.withColumn("key_ctr", at.cast("long"))


@query(w(S.SQL_TEXTS) + f" select doc, 'bold' as mark_name from ({_EVEN}) where bad")
def marks_bad_order(spark, sf_dir):
    return marks.bad_mark_order(_crossed(spark, sf_dir)).select("doc", "mark_name")


@query(
    w(S.SQL_TEXTS)
    + f""", e as ({_EVEN}) select m.doc, cast(a.start as bigint) as s, cast(b.start + length(b.s) as bigint) as e, 'bold' as name from e m join lat a on a.doc = m.doc and a.i = 1 join lat b on b.doc = m.doc and b.i = 2 where not bad
    union all select m.doc, cast(a.start as bigint), cast(b.start + length(b.s) as bigint), 'colour' from e m join lat a on a.doc = m.doc and a.i = n - 3 join lat b on b.doc = m.doc and b.i = n - 1 where lang is not null"""
)
def store_rescue_marks(spark, sf_dir):
    """Loading that tolerates marks in bad order leaves them out and keeps the others."""
    from ..sources import store

    m = marks.intervals(store.rescued(_crossed(spark, sf_dir)))
    return m.select("doc", F.col("start").alias("s"), F.col("end").alias("e"), "name")


# -- documents as values


@query("select 'k' || c_custkey as doc, cast(o_orderkey as varchar) as order_key, o_orderstatus as status, (select count(*) from lineitem where l_orderkey = o_orderkey) as items, cast(coalesce((select sum(l_quantity) from lineitem where l_orderkey = o_orderkey), 0) as bigint) as quantity from orders join customer on c_custkey = o_custkey")
def hydrate_orders(spark, sf_dir):
    j = hydrate.to_json(S.orders_tree(spark, sf_dir))
    kind = "struct<orders:map<string,struct<items:array<bigint>,status:string>>>"
    rows = j.select("doc", F.explode(F.from_json("json", kind)["orders"]).alias("order_key", "o"))
    return rows.select("doc", "order_key", F.col("o.status").alias("status"), F.size("o.items").cast("long").alias("items"), F.aggregate("o.items", F.lit(0).cast("long"), lambda a, x: a + x).alias("quantity"))


@query("select 'k' || o_custkey as doc, 'orders/' || o_orderkey || '/items' as path, 3 as depth from orders union all select 'k' || o_custkey, 'orders/' || o_orderkey, 2 from orders union all select distinct 'k' || o_custkey, 'orders', 1 from orders")
def object_paths(spark, sf_dir):
    p = hydrate.parents(register.winners(S.orders_tree(spark, sf_dir)))
    return p.select("doc", F.array_join("path", "/").alias("path"), "depth")


@query("select 'k' || o_custkey as doc, count(*) * 3 + 1 + (select count(*) from lineitem l join orders q on q.o_orderkey = l.l_orderkey where q.o_custkey = o.o_custkey) as places from orders o group by o_custkey")
def document_walk(spark, sf_dir):
    return hydrate.whole(S.orders_tree(spark, sf_dir)).groupBy("doc").agg(F.count("*").alias("places"))


@query("select user_id, event_type, cast(round(value * 100) as bigint) as cents, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_round_trip(spark, sf_dir):
    """Events as JSON documents in, as operations, and out again."""
    e = S.table(spark, sf_dir, "events")
    j = e.select(F.col("event_id").cast("string").alias("doc"), F.to_json(F.struct("user_id", "event_type", "value", F.from_json("props", "k bigint").alias("props"), F.array(F.lit(1), F.lit(None), F.lit(3)).alias("list"))).alias("json"))
    out = hydrate.to_json(hydrate.from_json(j, b"\x01"))
    back = out.select(F.from_json("json", "user_id bigint, event_type string, value double, props struct<k:bigint>, list array<int>").alias("r"))
    return back.where("size(r.list) = 3").select("r.user_id", "r.event_type", F.round(F.col("r.value") * 100).cast("long").alias("cents"), "r.props.k")


# -- sync


@query(
    w(S.SQL_OPS, S.SQL_CHANGES)
    + """, own as (select doc, hash from changes where actor < 2), size as (select doc, cast(ceil(count(*) * 10 / 8.0) * 8 as bigint) as m from own group by doc),
    hx as (select doc, hash, cast('0x' || substr(hash,7,2) || substr(hash,5,2) || substr(hash,3,2) || substr(hash,1,2) as bigint) as x, cast('0x' || substr(hash,15,2) || substr(hash,13,2) || substr(hash,11,2) || substr(hash,9,2) as bigint) as y, cast('0x' || substr(hash,23,2) || substr(hash,21,2) || substr(hash,19,2) || substr(hash,17,2) as bigint) as z, actor from changes),
    probe as (select h.doc, h.hash, h.actor, (x % m + i * (y % m) + (i * (i - 1) // 2) * (z % m)) % m as bit from hx h join size using (doc), (select unnest(range(0, 7)) as i)),
    bits as (select distinct doc, bit from probe where actor < 2)
    select c.doc, c.hash, coalesce(p.maybe, false) as maybe from changes c left join (select p.doc, p.hash, count(b.bit) = count(*) as maybe from probe p left join bits b on b.doc = p.doc and b.bit = p.bit group by p.doc, p.hash) p on p.doc = c.doc and p.hash = c.hash"""
)
def sync_bloom(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    bits, sizes = sync.bloom(c.where(who("actor") < 2).select("doc", "hash"))
    return sync.contains(bits, sizes, c).select("doc", F.lower(F.hex("hash")).alias("hash"), "maybe")


@query(
    SQL["sync_bloom"].replace("select c.doc, c.hash, coalesce(p.maybe, false) as maybe from changes c left join", ", known as (select c.doc, c.hash, coalesce(p.maybe, false) as maybe from changes c left join", 1).lstrip().replace("\n    , known", ", known")
    + f"""), new as (select k.doc, k.hash from known k join changes c on c.doc = k.doc and c.hash = k.hash where not maybe and c.ep >= timestamp '{DAY1}'),
    send as (with recursive walk as (select doc, hash from new union select e.doc, e.hash from edges e join walk on walk.hash = e.dep and walk.doc = e.doc) select * from walk) select doc, hash from send"""
)
def sync_hashes_to_send(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    bits, sizes = sync.bloom(c.where(who("actor") < 2).select("doc", "hash"))
    return sync.hashes_to_send(c, _heads_before(c, DAY1), bits, sizes).select("doc", F.lower(F.hex("hash")).alias("hash"))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + f" select doc, count(*) filter (ep >= timestamp '{DAY2}') * 3 > count(*) as whole from changes group by doc")
def sync_whole_document(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    return sync.whole_document(c, c.where(F.col("ep") >= F.lit(DAY2).cast("timestamp")))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select doc, count(*) as n from changes group by doc")
def sync_session(spark, sf_dir):
    """What a replica holds once it has exchanged messages with another until both agree.

    Each starts with the early changes, those of two of the four actors, and all of every other document.
    """
    c = cut(S.changes(spark, sf_dir).drop("ep", "num_ops"))
    early = F.col("time") < F.unix_millis(F.lit(DAY1).cast("timestamp"))
    even = F.substring("doc", 2, 9).cast("int") % 2 == 0
    none = c.limit(0)
    a, qa = merge.apply_changes(none, c.where(early | even | (who("actor") < 2)))
    b, qb = merge.apply_changes(none, c.where(early | ~even | (who("actor") >= 2)))
    a, qa, b, qb = sync.session(a, qa, b, qb)
    return b.groupBy("doc").agg(F.count("*").alias("n"))


# -- codecs

_RUNS = "select user_id % 4 as g, event_id as pos, event_type as val, length(event_type) as num from events"


def _column(spark, sf_dir) -> DataFrame:
    return S.table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("g"), F.col("event_id").alias("pos"), F.col("event_type").alias("val"), F.length("event_type").cast("long").alias("num"))


@query(f"with x as ({_RUNS}), y as (select *, row_number() over (partition by g order by pos) - row_number() over (partition by g, val order by pos) as d from x) select g, min(pos) as first, val, count(*) as count from y group by g, val, d")
def codec_runs(spark, sf_dir):
    return codec.runs(_column(spark, sf_dir), ["g"], "pos", "val").select("g", "first", "val", "count")


@query(f"with x as ({_RUNS}) select g, row_number() over (partition by g order by pos) - 1 as pos, val from x")
def codec_expand(spark, sf_dir):
    return codec.expand(codec.runs(_column(spark, sf_dir), ["g"], "pos", "val"), ["g"], "val")


@query(f"with x as ({_RUNS}), y as (select *, num > 6 as b from x), z as (select *, row_number() over (partition by g order by pos) - row_number() over (partition by g, b order by pos) as d from y), r as (select g, b, min(pos) as first, count(*) as n from z group by g, b, d) select g, case when (select b from r q where q.g = r.g order by first limit 1) then list_prepend(0, list(n order by first)) else list(n order by first) end as counts from r group by g")
def codec_bool_runs(spark, sf_dir):
    return codec.bool_runs(_column(spark, sf_dir).withColumn("b", F.col("num") > 6), ["g"], "pos", "b")


@query(f"with x as ({_RUNS}) select g, val, min(num) as only, count(distinct num) = 1 as is_only from x group by g, val")
def codec_only_value(spark, sf_dir):
    return codec.only_value(_column(spark, sf_dir), ["g", "val"], "num")


@query(f"with x as ({_RUNS}) select g, pos, pos - coalesce(lag(pos) over (partition by g order by pos), 0) as delta from x")
def codec_deltas(spark, sf_dir):
    return codec.deltas(_column(spark, sf_dir).withColumn("p", F.col("pos")), ["g"], "pos", "p").select("g", "pos", "delta")


@query(f"with x as ({_RUNS}) select g, pos, pos as value from x")
def codec_undelta(spark, sf_dir):
    d = codec.deltas(_column(spark, sf_dir).withColumn("p", F.col("pos")), ["g"], "pos", "p")
    return codec.undelta(d.select("g", "pos", "delta"), ["g"], "pos").select("g", "pos", "value")


@query(f"with x as ({_RUNS}), s as (select *, sum(num) over (partition by g order by pos rows between unbounded preceding and current row) as total from x) select g, pos, cast(total - num as bigint) as before, cast(total as bigint) as total from s")
def codec_prefix(spark, sf_dir):
    return codec.prefix(_column(spark, sf_dir), ["g"], "pos", "num").select("g", "pos", "before", "total")


@query(f"with x as ({_RUNS}), s as (select *, sum(num) over (partition by g order by pos rows between unbounded preceding and current row) as total from x) select g, min(pos) as pos from s where total >= 1000 group by g")
def codec_index_for_total(spark, sf_dir):
    return codec.index_for_total(_column(spark, sf_dir), ["g"], "pos", "num", 1000)


@query(f"with x as ({_RUNS}) select g, cast(sum(num) as bigint) as sum from x where pos >= 100 and pos < 600 group by g")
def codec_sum_range(spark, sf_dir):
    return codec.sum_range(_column(spark, sf_dir), ["g"], "pos", "num", 100, 600)


@query(f"with x as ({_RUNS}) select g, min(pos) as pos from x where val = 'purchase' group by g")
def codec_find_first(spark, sf_dir):
    return codec.find_first(_column(spark, sf_dir), ["g"], "pos", "val", "purchase")


@query(f"with x as ({_RUNS}) select g, pos, num from x where num between 5 and 6")
def codec_find_range(spark, sf_dir):
    return codec.find_range(_column(spark, sf_dir), ["g"], "pos", "num", 5, 6)


@query(f"with x as (select g, row_number() over (partition by g order by pos) - 1 as pos, val from ({_RUNS})) select g, case when pos < 10 then pos else pos - 2 end as pos, val from x where pos < 10 or pos >= 15 union all select distinct g, 10 + i, case i when 0 then 'a' when 1 then 'b' else 'c' end from x, (select unnest(range(0, 3)) as i)")
def codec_splice(spark, sf_dir):
    c = _column(spark, sf_dir)
    c = c.withColumn("pos", (F.row_number().over(Window.partitionBy("g").orderBy("pos")) - 1).cast("long")).select("g", "pos", "val")
    return codec.splice(c, ["g"], "pos", "val", 10, 5, ["a", "b", "c"])


@query(f"with x as ({_RUNS}) select g, pos, case val when 'click' then 'tap' when 'view' then 'look' else val end as val from x")
def codec_remap(spark, sf_dir):
    t = spark.createDataFrame([("click", "tap"), ("view", "look")], "old string, new string")
    return codec.remap(_column(spark, sf_dir).select("g", "pos", "val"), "val", t)


# -- writes


@query(
    w(S.SQL_OPS, S.sql_live(), S.sql_win())
    + """, edit as (select distinct doc, k from live where hash(1) is not null), p as (select l.doc, l.k, count(*) as n from live l group by l.doc, l.k)
    select w.doc, w.k, case when w.counter then 5 when w.n > 1 then 3 else null end as action, case when w.counter then p.n when w.n > 1 then p.n - 1 end as preds from win w join p using (doc, k) where w.counter or w.n > 1"""
)
def write_map_edits(spark, sf_dir):
    """Counters are incremented; other keys are put again as they are, which only removes the losers of conflicts."""
    o = S.ops(spark, sf_dir).drop("ep")
    v = register.winners(o)
    from ..functions.schema import INCREMENT, SET, VALUE, value

    own = F.when(F.col("value.type") == "counter", value("int", F.lit(3))).otherwise(F.col("value").cast(VALUE))
    e = v.select("doc", "obj_ctr", "obj_actor", "key_str", F.when(F.col("value.type") == "counter", INCREMENT).otherwise(SET).alias("action"), own.alias("value"), F.row_number().over(Window.partitionBy("doc").orderBy("key_str")).alias("n"))
    return write.map_edits(o, e, b"\x09").select("doc", F.col("key_str").alias("k"), "action", F.size("pred").cast("long").alias("preds"))


@query(w(S.SQL_OPS, S.sql_live(), S.sql_win()) + ", t as (select distinct doc from win) select doc, 'a' as k, 1.0 as val from t union all select doc, 'b', 2.0 from t")
def write_update_map(spark, sf_dir):
    """Every document is brought to two keys; reading it back gives just those."""
    from ..functions.schema import value

    o = S.ops(spark, sf_dir).drop("ep")
    docs = register.winners(o).select("doc").distinct()
    rows = [F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("a", 1.0), ("b", 2.0))]
    want = docs.select("doc", F.explode(F.array(*rows)).alias("r")).select("doc", F.lit(0).cast("long").alias("obj_ctr"), F.lit(None).cast("binary").alias("obj_actor"), F.col("r.k").alias("key_str"), value("f64", F.col("r.v")).alias("value"))
    return register.winners(o.unionByName(write.update_map(o, want, b"\x09"))).select("doc", F.col("key_str").alias("k"), num().alias("val"))


@query(w(S.SQL_LISTS) + " select doc, count(*) + 1 as length, first(text order by pos) as second from shown group by doc")
def write_edit_many(spark, sf_dir):
    """A draft of every conversation gets a new first turn."""
    from ..operators.transaction import Draft, edit_many

    def edit(d: Draft) -> None:
        made = d.get((0, b""), "turns")
        d.insert(made[1], 0, "hello")

    o = S.lists(spark, sf_dir)
    e = sequence.elements(o.unionByName(edit_many(o, b"\x05", edit)))
    return e.groupBy("doc").agg(F.count("*").alias("length"), F.max(F.when(F.col("index") == 1, F.col("value.s"))).alias("second"))


# -- storage, streams, privacy


@query("select s_suppkey, s_name, cast(round(s_acctbal * 100) as bigint) as cents, n_name from supplier join nation on n_nationkey = s_nationkey")
def chunks_round_trip(spark, sf_dir):
    """Suppliers as JSON documents, as operations, as binary chunks, and all the way back."""
    from ..functions.frames import written
    from ..functions.schema import CHANGES
    from ..sources import chunks

    s, n = S.table(spark, sf_dir, "supplier"), S.table(spark, sf_dir, "nation")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").cast("string").alias("doc"), F.to_json(F.struct("s_suppkey", "s_name", "s_acctbal", F.struct("n_name").alias("nation"))).alias("json"))
    o = written(hydrate.from_json(j, b"\x01"), "ops")
    none = F.array().cast("array<binary>")
    own = o.groupBy("doc").agg(F.max("ctr").alias("max_op"))
    c = own.select("doc", F.unhex(F.sha2("doc", 256)).alias("hash"), F.lit(b"\x01").alias("actor"), F.lit(1).cast("long").alias("seq"), F.lit(1).cast("long").alias("start_op"), "max_op", F.lit(0).cast("long").alias("time"), F.lit(None).cast("string").alias("message"), none.alias("deps"), F.lit(b"").alias("extra"))
    files = written(chunks.write(chunks.rehashed(c, o).select(*CHANGES.names), o), "chunks")
    back = written(chunks.read(files)[1], "ops")
    r = hydrate.to_json(back).select(F.from_json("json", "s_suppkey bigint, s_name string, s_acctbal double, nation struct<n_name:string>").alias("r"))
    return r.select("r.s_suppkey", "r.s_name", F.round(F.col("r.s_acctbal") * 100).cast("long").alias("cents"), "r.nation.n_name")


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select doc, count(*) as n, count(*) as places, true as in_order from changes group by doc")
def stream_causal_queue(spark, sf_dir):
    """Changes arrive in two files, the later half first; the stream releases them in causal order."""
    from ..functions.frames import written
    from ..streaming import queue

    c = S.changes(spark, sf_dir)
    rows = queue.as_stream_rows(c).withColumn("late", F.col("hash") > F.unhex(F.lit("80")))
    src = written(rows.where("late").drop("late"), "stream").inputFiles()[0].rsplit("/", 1)[0]
    rows.where("not late").drop("late").write.mode("append").parquet(src)
    out, cp = src + "-out", src + "-cp"
    stream = queue.released(spark.readStream.schema(queue.IN).option("maxFilesPerTrigger", 1).parquet(src))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    e = graph.edges(c).join(got.select("doc", "hash", F.col("place").alias("at")), ["doc", "hash"]).join(got.select("doc", F.col("hash").alias("dep"), F.col("place").alias("dep_at")), ["doc", "dep"], "left")
    ok = e.groupBy("doc").agg(F.min(F.coalesce(F.col("dep_at") < F.col("at"), F.lit(False))).alias("in_order"))
    return got.groupBy("doc").agg(F.count("*").alias("n"), F.count_distinct("place").alias("places")).join(ok, "doc", "left").select("doc", "n", "places", F.coalesce("in_order", F.lit(True)).alias("in_order"))


@query(w(S.SQL_OPS, S.sql_live(), S.sql_win()) + " select doc, ctr, n > 1 as conflict, n, counter from win")
def anonymize_shape(spark, sf_dir):
    """The anonymised log has the same winners, by counter, and the same conflicts."""
    v = register.winners(anonymize.anonymize(S.ops(spark, sf_dir).drop("ep"), "seed"))
    return v.select("doc", "ctr", "conflict", "n", (F.col("value.type") == "counter").alias("counter"))
