"""More of the engine's queries: stores, the change feed, drafts, types and helpers, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lists as L
from ..functions.frames import grouped, shared_dir, written
from ..functions.schema import MAKE_TEXT, OPS, cursor_bytes, parse_cursor_bytes
from ..operators import diff, feed, graph, hydrate, marks, merge, register, sequence, sync
from ..operators.transaction import Draft, edit_many
from ..sources import chunks, messages, store
from . import synth as S
from .queries import DAY1, DAY2, SQL, _DIFF, _heads_before, query, w, who

ROOT = (0, b"")


def _day(day: str):
    return F.lit(day).cast("timestamp")


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


# -- change graph


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select doc, hash, actor as who, seq, start_op, max_op, (select count(*) from edges e where e.doc = c.doc and e.hash = c.hash) as deps from changes c where seq = 2")
def graph_change_by_hash(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    got = graph.by_hash(c, c.where("seq = 2").select("doc", "hash"))
    return got.select("doc", F.lower(F.hex("hash")).alias("hash"), who("actor").alias("who"), "seq", "start_op", "max_op", F.size("deps").cast("long").alias("deps"))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + ", ask as (select distinct doc, actor, s from changes, (values (1), (3), (1000)) v(s)) select a.doc, a.actor as who, cast(a.s as bigint) as seq, c.hash from ask a left join changes c on c.doc = a.doc and c.actor = a.actor and c.seq = a.s")
def graph_hash_of_seq(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    of = c.select("doc", "actor", F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 3, 1000)])).alias("seq"))
    return graph.hash_of_seq(c, of).select("doc", who("actor").alias("who"), "seq", F.lower(F.hex("hash")).alias("hash"))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select doc, actor as who, max(max_op) as max_op, max(seq) as seq from changes group by doc, actor")
def graph_max_op(spark, sf_dir):
    return graph.clock_of(S.changes(spark, sf_dir)).select("doc", who("actor").alias("who"), "max_op", "seq")


# -- stores


def _held(c: DataFrame, o: DataFrame) -> DataFrame:
    a, b = c.groupBy("doc").agg(F.count("*").alias("changes")), o.groupBy("doc").agg(F.count("*").alias("ops"), F.sum("ctr").alias("ids"))
    return a.join(b, "doc", "full").select("doc", F.coalesce("changes", F.lit(0).cast("long")).alias("changes"), F.coalesce("ops", F.lit(0).cast("long")).alias("ops"), F.coalesce("ids", F.lit(0).cast("long")).alias("ids"))


_HELD = " select doc, (select count(*) from changes c where c.doc = o.doc{0}) as changes, count(*) as ops, cast(sum(ctr) as bigint) as ids from ops o where true{0} group by doc"


@query(w(S.SQL_OPS, S.SQL_CHANGES) + _HELD.format(""))
def store_save_and_load(spark, sf_dir):
    path = _folder(spark)
    store.save(S.changes(spark, sf_dir), S.ops(spark, sf_dir), path)
    return _held(*store.load(spark, path))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + _HELD.format(""))
def store_save_incremental(spark, sf_dir):
    """The changes before a day, then all of them twice: each is held once."""
    c, o, path = S.changes(spark, sf_dir), S.ops(spark, sf_dir), _folder(spark)
    early = c.where(F.col("ep") < _day(DAY1))
    store.save(early, store.bundle_ops(early, o), path)
    if not store.append(c, o, path) or store.append(c, o, path):
        raise ValueError("an increment was lost or repeated")
    return _held(*store.load(spark, path))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + _HELD.format(f" and ep >= timestamp '{DAY2}'"))
def store_save_after(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    return _held(*store.save_after(c, S.ops(spark, sf_dir), _heads_before(c, DAY2)))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select c.doc, count(distinct c.hash) as changes, count(*) as ops, cast(sum(o.ctr) as bigint) as ids from changes c join ops o on o.doc = c.doc and o.actor = c.actor and o.ep = c.ep where c.seq % 3 = 1 group by c.doc")
def store_bundle(spark, sf_dir):
    c = S.changes(spark, sf_dir)
    return _held(*store.bundle(c, S.ops(spark, sf_dir), c.where("seq % 3 = 1").select("doc", "hash")))


_GAP = w(S.SQL_OPS, S.SQL_CHANGES) + f", gap as (select doc, min(ep) as gap from changes where ep >= timestamp '{DAY1}' group by doc)"


def _with_gap(spark, sf_dir) -> DataFrame:
    """All changes but those of the first day from DAY1 on: later ones lack dependencies."""
    c = S.changes(spark, sf_dir)
    gap = c.where(F.col("ep") >= _day(DAY1)).groupBy("doc").agg(F.min("ep").alias("gap"))
    return c.join(gap, "doc", "left").where("gap is null or ep <> gap").drop("gap")


@query(_GAP + " select c.doc, count(distinct c.hash) as changes, count(*) as ops, cast(sum(o.ctr) as bigint) as ids from changes c join ops o on o.doc = c.doc and o.actor = c.actor and o.ep = c.ep left join gap g on g.doc = c.doc where g.gap is null or c.ep < g.gap group by c.doc")
def store_load_partial(spark, sf_dir):
    """Loading that leaves out changes whose dependencies are missing, and their operations."""
    path = _folder(spark)
    store.save(_with_gap(spark, sf_dir), S.ops(spark, sf_dir), path)
    return _held(*store.load(spark, path, store.Options(partial="ignore")))


@query(_GAP + " select c.doc, count(*) as kept, count(*) filter (g.gap is null or c.ep < g.gap) as settled from changes c left join gap g on g.doc = c.doc where g.gap is null or c.ep <> g.gap group by c.doc")
def store_orphans(spark, sf_dir):
    """Waiting changes are saved with the others, or left behind if the options say so."""
    c, o = _with_gap(spark, sf_dir), S.ops(spark, sf_dir)
    a, b = _folder(spark), _folder(spark)
    store.save(c, o, a)
    store.save(c, o, b, store.Options(orphans=False))
    kept = store.load(spark, a, store.Options(partial="keep", verify=False))[0]
    every = spark.read.parquet(f"{a}/changes").groupBy("doc").agg(F.count("*").alias("kept"))
    if kept.join(store.load(spark, b)[0].select("doc", "hash"), ["doc", "hash"], "left_anti").count():
        raise ValueError("loading in part and saving without orphans differ")
    settled = store.load(spark, b)[0].groupBy("doc").agg(F.count("*").alias("settled"))
    return every.join(settled, "doc", "left").select("doc", "kept", F.coalesce("settled", F.lit(0).cast("long")).alias("settled"))


@query(w(S.SQL_OPS, S.SQL_CHANGES) + " select c.doc, c.hash, c.actor as who, c.seq, count(*) as ops, cast(sum(o.ctr) as bigint) as ids, count(*) filter (o.action = 5) as increments from changes c join ops o on o.doc = c.doc and o.actor = c.actor and o.ep = c.ep group by all")
def store_expanded(spark, sf_dir):
    """Changes as JSON texts with their operations, and back."""
    c, o = store.from_expanded(store.expanded(S.changes(spark, sf_dir), S.ops(spark, sf_dir)))
    j = o.join(c.select("doc", "actor", "hash", "seq", "start_op", "max_op"), ["doc", "actor"]).where("ctr between start_op and max_op")
    own = j.groupBy("doc", "hash", who("actor").alias("who"), "seq").agg(F.count("*").alias("ops"), F.sum("ctr").alias("ids"), F.sum((F.col("action") == 5).cast("long")).alias("increments"))
    return own.withColumn("hash", F.lower(F.hex("hash")))


@query("select 'k' || o_custkey as doc, o_orderstatus as text, count(*) as n from orders group by all")
def store_strings_to_text(spark, sf_dir):
    """Every string of a map becomes a text object of its characters."""
    new = written(store.strings_to_text(S.orders_tree(spark, sf_dir)), "texts")
    return sequence.text(sequence.elements(new)).groupBy("doc", "text").agg(F.count("*").alias("n"))


# -- sync as bytes


def _sql_uleb(n: str) -> str:
    return f"case when {n} < 128 then printf('%02x', {n}) when {n} < 16384 then printf('%02x%02x', {n} % 128 + 128, {n} // 128) else printf('%02x%02x%02x', {n} % 128 + 128, {n} // 128 % 128 + 128, {n} // 16384) end"


_SQL_HEADS = f", tip as (select doc, {_sql_uleb('count(*)')} || string_agg(hash, '' order by hash) as heads from changes c where not exists (select 1 from edges e where e.doc = c.doc and e.dep = c.hash) group by doc)"


@query(w(S.SQL_OPS, S.SQL_CHANGES) + _SQL_HEADS + " select doc, '43' || heads as bytes from tip")
def sync_state_bytes(spark, sf_dir):
    """The heads that two replicas share, as a state's bytes; what is read back must be the same."""
    h = graph.heads(S.changes(spark, sf_dir)).select("doc", "hash")
    out = messages.states(messages.read_states(messages.states(h)))
    return out.select("doc", F.lower(F.hex("bytes")).alias("bytes"))


@query(
    SQL["sync_bloom"].split(", own as")[0]
    + _SQL_HEADS
    + ", own as"
    + SQL["sync_bloom"].split(", own as")[1].split("select c.doc, c.hash, coalesce")[0].replace(" where actor < 2)", ")").replace(" where actor < 2 group by", " group by")
    + f""", octet as (select doc, bit // 8 as nth, sum(1 << (bit % 8)) as v from bits group by all),
    slot as (select doc, unnest(range(0, m // 8)) as nth from size),
    filled as (select s.doc, string_agg(printf('%02x', cast(coalesce(v, 0) as bigint)), '' order by s.nth) as hx from slot s left join octet o on o.doc = s.doc and o.nth = s.nth group by s.doc),
    n as (select doc, count(*) as n from changes group by doc), f as (select doc, {_sql_uleb('n')} || '0a07' || hx as bloom from n join filled using (doc)), g as (select doc, bloom, length(bloom) // 2 as size from f)
    select doc, '42' || heads || '00' || '01' || '00' || {_sql_uleb('size')} || bloom || '00' || '020284' as bytes from tip join g using (doc)"""
)
def sync_message_bytes(spark, sf_dir):
    """A session's first message to a peer, as bytes; what is read back must give the same bytes."""
    c = S.changes(spark, sf_dir).drop("ep", "num_ops")
    m, _ = messages.from_bytes(messages.to_bytes(sync.generate(c, c.limit(0), sync.Peer())))
    return messages.to_bytes(m).select("doc", F.lower(F.hex("bytes")).alias("bytes"))


# -- types and helpers


@query("select 'k' || o_custkey as doc, 'map' as kind, count(*) + 1 as n from orders group by all union all select 'k' || o_custkey, 'list', count(*) from orders group by all")
def object_types(spark, sf_dir):
    return hydrate.objects(register.winners(S.orders_tree(spark, sf_dir))).groupBy("doc", "kind").agg(F.count("*").alias("n"))


@query(w(S.SQL_LISTS) + " select doc, n from shown where index = 2")
def cursor_at_index(spark, sf_dir):
    return sequence.cursor_at(sequence.elements(S.lists(spark, sf_dir)), F.lit(2)).select("doc", (F.col("ctr") - 1).alias("n"))


@query(
    """with e as (select event_id as n, '0' || user_id % 4 as a, event_id % 4 as m from events where event_id > 0),
    x as (select *, printf('%02x', case when n < 128 then n else n % 128 + 128 end) || case when n < 128 then '' when n < 16384 then printf('%02x', n // 128) else printf('%02x', n // 128 % 128 + 128) || printf('%02x', n // 16384) end as c from e)
    select n, true as ok, case m when 0 then '0101' when 1 then '0102' when 2 then '010301' || a || c || '01' else '010301' || a || c || '02' end as bytes from x"""
)
def cursor_as_bytes(spark, sf_dir):
    """A cursor at every event, as bytes and back."""
    e = S.table(spark, sf_dir, "events").where("event_id > 0").select("event_id", S.actor(F.col("user_id") % 4).alias("actor"))
    e = e.withColumn("move", F.element_at(F.array(*map(F.lit, ("start", "end", "before", "after"))), (F.col("event_id") % 4 + 1).cast("int")))
    e = e.withColumn("bytes", cursor_bytes(F.col("event_id"), F.col("actor"), F.col("move")))
    p = parse_cursor_bytes(F.col("bytes"))
    ok = (p["move"] == F.col("move")) & (F.col("move").isin("start", "end") | ((p["ctr"] == F.col("event_id")) & (p["actor"] == F.col("actor"))))
    return e.select(F.col("event_id").alias("n"), ok.alias("ok"), F.lower(F.hex("bytes")).alias("bytes"))


@query(
    """with a as (select user_id % 100 as u, list(event_type order by event_id) as l from events group by 1)
    select u, l[-1] as last, cast(coalesce(list_position(l, 'view'), 0) - 1 as int) as first_view, list_contains(l, 'purchase') as buys, cast(len(list_filter(l, lambda x: x = 'click')) as bigint) as clicks,
      array_to_string(l[2:3], ',') as part, cast(list_sum(list_transform(l, lambda x: length(x))) as bigint) as letters, cast(len(l) + 1 as bigint) as pushed, array_to_string(list_concat(list_concat(l[1:1], ['new']), l[4:5]), ',') as spliced from a"""
)
def list_helpers(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 100).alias("u")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("l"))
    a = F.col("l")
    return e.select(
        "u", L.at(a, -1).alias("last"), L.index_of(a, F.lit("view")).alias("first_view"), L.includes(a, F.lit("purchase")).alias("buys"), F.size(L.keep(a, lambda x: x == "click")).cast("long").alias("clicks"),
        L.join(L.part(a, 1, 3)).alias("part"), L.reduce(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("letters"), F.size(L.push(a, F.lit("x"))).cast("long").alias("pushed"), L.join(L.part(L.splice(a, 1, 2, F.lit("new")), 0, 4)).alias("spliced"),
    )


# -- differences


@query(_DIFF + " select doc, k, class, conflict from e where doc in ('d1', 'd4', 'd7')")
def diff_objects(spark, sf_dir):
    """The difference within the root objects of three documents."""
    o = S.ops(spark, sf_dir)
    roots = o.where(F.col("doc").isin("d1", "d4", "d7")).select("doc", "obj_ctr", "obj_actor").distinct()
    d = diff.of_object(diff.diff_at(o, S.clock_before(o, DAY1), S.clock_before(o, DAY2)), roots)
    return d.select("doc", F.expr("substr(key, 2)").alias("k"), "class", "conflict")


@query(_DIFF + " select doc, k, class, n_old, n_new from e")
def diff_cursor(spark, sf_dir):
    """A cursor that has seen the operations before one day is moved on to another."""
    o = S.ops(spark, sf_dir)
    at = feed.DiffCursor()
    at.update(o.where(F.col("ep") < _day(DAY1)).drop("ep"))
    return at.advance(o.where(F.col("ep") < _day(DAY2)).drop("ep")).select("doc", F.expr("substr(key, 2)").alias("k"), "class", "n_old", "n_new")


def _orders_at(spark, sf_dir, last: int) -> tuple[DataFrame, DataFrame]:
    """The tree of orders, and the clock at which it has the orders up to a number, without their items."""
    o = S.orders_tree(spark, sf_dir)
    return o, o.select("doc", "actor").distinct().withColumn("max_op", F.lit(10 * last + 9).cast("long"))


@query("select 'k' || o_custkey as doc, cast(o_orderkey as varchar) as k, case when o_orderkey > 500 then 'add' else 'same' end as class from orders")
def diff_by_path(spark, sf_dir):
    o, before = _orders_at(spark, sf_dir, 500)
    now = o.groupBy("doc", "actor").agg(F.max("ctr").alias("max_op"))
    return feed.diff_path(o, before, now, ["orders"], recursive=False).select("doc", F.expr("substr(key, 2)").alias("k"), "class")


@query(
    """with n as (select 'k' || o_custkey as doc, cast(o_orderkey as varchar) as k from orders where o_orderkey > 500)
    select doc, 'orders' as path, k as key, 'put_map' as patch from n union all select doc, 'orders/' || k, 'status', 'put_map' from n union all select doc, 'orders/' || k, 'items', 'put_map' from n"""
)
def diff_patch_paths(spark, sf_dir):
    o, before = _orders_at(spark, sf_dir, 500)
    now = register.winners(o)
    p = diff.with_paths(diff.map_patches(diff.diff(register.winners(o, before), now)), now)
    return p.select("doc", F.array_join("path", "/").alias("path"), "key", "patch")


@query(
    w(S.SQL_LISTS)
    + """, q as (select doc, pos, text, (select count(*) from pos p where p.doc = r.doc and p.pos < r.pos and p.n % 5 <> 0) as index from pos r where n > 4 and n % 5 <> 0),
    i as (select *, case when index = 1 + lag(index) over (partition by doc order by pos) then 0 else 1 end as new from q),
    g as (select *, sum(new) over (partition by doc order by pos) as run from i)
    select doc, 'insert' as patch, min(index) as index, count(*) as length, array_to_string(list(text order by pos), '|') as vals from g group by doc, run"""
)
def diff_coalesced(spark, sf_dir):
    """Adjacent inserts of a list as one splice."""
    o = S.lists(spark, sf_dir)
    before = o.where("ctr <= 5").groupBy("doc", "actor").agg(F.max("ctr").alias("max_op"))
    p = diff.coalesced(diff.list_patches(o, before, None))
    return p.select("doc", "patch", "index", "length", F.array_join("values", "|").alias("vals"))


_SPANS = """, flag as (select t.doc, t.i, t.s, t.start, coalesce(m.n is not null and t.i between 1 and 2, false) as bold, case when m.n is not null and t.i between m.n - 3 and m.n - 1 then m.lang end as c from lat t left join marked m on m.doc = t.doc)"""


@query(
    w(S.SQL_TEXTS)
    + _SPANS
    + """, y as (select *, concat_ws(',', case when bold then 'bold=true' end, 'colour=' || c) as mk from flag), z as (select *, row_number() over (partition by doc order by i) - row_number() over (partition by doc, mk order by i) as g from y),
    sp as (select doc, mk, string_agg(s, '' order by i) as text, min(start) as start from z group by doc, mk, g), docs as (select distinct doc from sp where mk <> ''),
    old as (select doc, string_agg(s, '' order by i) as text from line group by doc)
    select doc, 'add' as class, mk as marks, cast(start as bigint) as s, length(text) as n from sp where doc in (select doc from docs)
    union all select o.doc, 'del', '', 0, length(o.text) from old o where doc in (select doc from docs)"""
)
def diff_spans(spark, sf_dir):
    """From the texts without marks to the texts with them: one plain span gives way to several."""
    o = S.texts(spark, sf_dir)
    before = o.where("action <> 7").groupBy("doc", "actor").agg(F.max("ctr").alias("max_op"))
    d = feed.diff_spans(o, before, None)
    return d.select("doc", "class", "marks", F.col("start").alias("s"), F.length("text").alias("n"))


# -- drafts: every part is a document with its name, on which an edit is made


def _parts(spark, sf_dir) -> DataFrame:
    j = S.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("doc"), F.to_json(F.struct("p_name", "p_type", F.array("p_brand", F.lit("x"), F.lit("y")).alias("tags"))).alias("json"))
    return hydrate.from_json(j, b"\x01")


def _edited(spark, sf_dir, edit) -> DataFrame:
    o = _parts(spark, sf_dir)
    return written(o.unionByName(edit_many(o, b"\x02", edit)), "edited")


def _body(d: Draft):
    body = d.put_object(ROOT, "body", MAKE_TEXT)
    d.splice_text(body, 0, 0, d.get(ROOT, "p_name")[0])
    return body


def _body_text(o: DataFrame) -> DataFrame:
    """The text objects alone: their operations are actor 2's."""
    return sequence.text(sequence.elements(o).where(F.col("obj_actor") == F.lit(b"\x02"))).select("doc", "text")


@query("select 'p' || p_partkey as doc, cast(1 + p_partkey % 2 as bigint) as changes, 3 + 3 * (p_partkey % 2) as ops, cast(15 + 6 * (p_partkey % 2) as bigint) as ids from part")
def chunk_bundles(spark, sf_dir):
    """Every part as a document of two changes: the second of each, or both, as a bundle's bytes and back.

    Changes count where the hash that reading gives is the one before.
    """
    o = written(_parts(spark, sf_dir), "parts")
    of_two = written(o.select("doc", "actor").distinct().withColumn("seq", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))), "seqs")
    h = lambda n: F.unhex(F.sha2(F.concat("doc", F.lit("/"), n.cast("string")), 256))
    deps = F.when(F.col("seq") == 1, F.array().cast("array<binary>")).otherwise(F.array(h(F.lit(1))))
    c = of_two.select("doc", h(F.col("seq")).alias("hash"), "actor", "seq", (F.col("seq") * 3 - 2).alias("start_op"), (F.col("seq") * 3).alias("max_op"), F.lit(0).cast("long").alias("time"), F.lit(None).cast("string").alias("message"), deps.alias("deps"), F.lit(b"").alias("extra"))
    c = written(chunks.rehashed(c, o).drop("bytes"), "changes")
    of = c.where("seq = 2 or cast(substr(doc, 2) as int) % 2 = 1").select("doc", "hash", F.lit("b").alias("name"))
    back, ops = chunks.read(chunks.bundles(c, o, of))
    return _held(back.join(of, ["doc", "hash"], "left_semi"), ops)


@query("select 'p' || p_partkey as doc, substr(p_name, 1, 2) || 'XY' || substr(p_name, 6) as text from part")
def write_splice_text(spark, sf_dir):
    def edit(d: Draft) -> None:
        d.splice_text(_body(d), 2, 3, "XY")

    return _body_text(_edited(spark, sf_dir, edit))


@query("select 'p' || p_partkey as doc, p_type as text from part")
def write_update_text(spark, sf_dir):
    """A text is brought to another by the shortest edit script."""

    def edit(d: Draft) -> None:
        d.update_text(_body(d), d.get(ROOT, "p_type")[0])

    return _body_text(_edited(spark, sf_dir, edit))


@query("select 'p' || p_partkey as doc, u.s, u.e, u.name from part, (values (0::bigint, 1::bigint, 'bold'), (2, 6, 'bold'), (1, 3, 'link')) u(s, e, name)")
def write_marks(spark, sf_dir):
    """A mark that expands at its end, another that doesn't, a stretch without the first, and text typed at both ends."""

    def edit(d: Draft) -> None:
        body = _body(d)
        d.mark(body, 0, 4, "bold", True, "after")
        d.mark(body, 1, 3, "link", "x", "none")
        d.unmark(body, 1, 2, "bold")
        d.splice_text(body, 4, 0, "++")

    m = marks.intervals(_edited(spark, sf_dir, edit))
    return m.select("doc", F.col("start").alias("s"), F.col("end").alias("e"), "name")


@query("select 'p' || p_partkey as doc, u.span, u.kind, case u.span when 1 then substr(p_name, 1, 3) when 3 then substr(p_name, 4) else chr(65532) end as text from part, (values (1::bigint, 'text'), (2, 'block'), (3, 'text')) u(span, kind)")
def write_blocks(spark, sf_dir):
    """A block splits a text in two."""

    def edit(d: Draft) -> None:
        d.split_block(_body(d), 3)

    return marks.spans(_edited(spark, sf_dir, edit)).where(F.col("obj_actor") == F.lit(b"\x02")).select("doc", "span", "kind", "text")


@query("select 'p' || p_partkey as doc, u.k from part, (values ('p_name'), ('p_type'), ('tags'), ('kept')) u(k)")
def write_rollback(spark, sf_dir):
    """What was pending is forgotten; what follows is kept."""

    def edit(d: Draft) -> None:
        d.put(ROOT, "lost", 1)
        d.rollback()
        d.put(ROOT, "kept", 2)

    return register.keys(register.winners(_edited(spark, sf_dir, edit))).where("obj_ctr = 0").select("doc", F.col("key_str").alias("k"))


@query("select 'p' || p_partkey as doc, cast(u.i as bigint) as index, case u.i when 0 then p_brand when 1 then 'z' when 2 then 'y' else 'more' end as val from part, (values (0), (1), (2), (3)) u(i)")
def write_update_list(spark, sf_dir):
    """A list is brought to other values: equal ones stay, one is put, one is added."""

    def edit(d: Draft) -> None:
        tags = d.get(ROOT, "tags")[1]
        d.update_object(tags, [d.get(tags, 0)[0], "z", "y", "more"])

    return sequence.elements(_edited(spark, sf_dir, edit)).select("doc", "index", F.col("value.s").alias("val"))


@query("select 'p' || p_partkey as doc, cast(u.i as bigint) as index, case u.i when 1 then 'in' when 0 then p_brand else 'y' end as val from part, (values (0), (1), (2)) u(i)")
def write_splice_list(spark, sf_dir):
    def edit(d: Draft) -> None:
        d.splice(d.get(ROOT, "tags")[1], 1, 1, ["in"])

    return sequence.elements(_edited(spark, sf_dir, edit)).select("doc", "index", F.col("value.s").alias("val"))


@query("select 'p' || p_partkey as doc, 2 as seq, cast(4 as bigint) as ops, true as follows from part")
def write_commit(spark, sf_dir):
    """Two commits of a draft: the second depends on the first."""
    names = OPS.names

    def one(t: pa.Table) -> pa.Table:
        rows = t.select(names).to_pylist()
        d = Draft(rows, b"\x02", rows[0]["doc"])
        d.put(ROOT, "a", 1)
        first, _ = d.commit("first")
        for k in "bcde":
            d.put(ROOT, k, 2)
        second, own = d.commit("second")
        ok = first["hash"] in second["deps"] and first["max_op"] + 1 == second["start_op"] and d.commit()[0] is None
        return pa.table({"doc": [rows[0]["doc"]], "seq": pa.array([second["seq"]], pa.int32()), "ops": pa.array([len(own)], pa.int64()), "follows": [ok]})

    return grouped(_parts(spark, sf_dir), ["doc"], one, "doc string, seq int, ops long, follows boolean")


@query(w(S.SQL_OPS) + f" select doc, count(*) filter (ep < timestamp '{DAY2}') as then_ops, count(*) as now_ops from ops group by doc")
def write_isolated(spark, sf_dir):
    """A fork at old heads has the operations of then; merged with the rest it has all."""
    c, o = S.changes(spark, sf_dir), S.ops(spark, sf_dir).drop("ep")
    _, then = merge.fork_at(c, o, _heads_before(c, DAY2))
    a, b = then.groupBy("doc").agg(F.count("*").alias("then_ops")), merge.merge_ops(then, o).groupBy("doc").agg(F.count("*").alias("now_ops"))
    return b.join(a, "doc", "left").select("doc", F.coalesce("then_ops", F.lit(0).cast("long")).alias("then_ops"), "now_ops")
