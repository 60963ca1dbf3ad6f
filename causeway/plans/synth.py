"""Deterministic op logs over the driver's tables, as DataFrames and as SQL for the same relations.

events: four actors edit map keys; they exchange changes at day boundaries, so an operation has seen its own actor's
earlier operations and all of earlier days. Low values delete, clicks make and increment counters.
conversations: each is a list whose turns hang off earlier turns. documents: each is a text of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.schema import DELETE, INCREMENT, MAKE_LIST, MAKE_MAP, MAKE_TEXT, SET, value

ACTORS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def actor(n: Column) -> Column:
    """One byte."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))


def actor_no(a: str | Column) -> Column:
    return F.conv(F.hex(a), 16, 10).cast("long")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op log of the events, with `ep`, the day of each operation.

    Predecessors come from one window pass per key: the last replacing operation of each actor that was seen.
    """
    e = table(spark, sf_dir, "events")
    click = F.col("event_type") == "click"
    action = F.when(click & (F.col("value") >= 30), INCREMENT).when(~click & (F.col("value") < 25), DELETE).otherwise(SET)
    rows = e.select(
        F.concat(F.lit("d"), (F.col("user_id") % 10).cast("string")).alias("doc"),
        (F.col("event_id") + 1).alias("ctr"),
        ((F.col("user_id") + F.col("event_id")) % ACTORS).alias("who"),
        F.concat("event_type", F.lit("/"), (F.col("user_id") % 50).cast("string")).alias("key_str"),
        action.alias("action"),
        F.when(action == SET, F.when(click, value("counter", F.floor("value"))).otherwise(value("f64", F.col("value")))).when(action == INCREMENT, value("int", F.floor("value"))).alias("value"),
        F.date_trunc("day", "ts").alias("ep"),
    )
    w = Window.partitionBy("doc", "key_str").orderBy(F.unix_timestamp("ep"))
    earlier, mine = w.rangeBetween(Window.unboundedPreceding, -1), Window.partitionBy("doc", "key_str", "who").orderBy("ctr").rowsBetween(Window.unboundedPreceding, -1)
    replaces = F.col("action") != INCREMENT
    last = [F.when(F.col("who") == a, F.max(F.when(replaces, F.col("ctr"))).over(mine)).otherwise(F.max(F.when(replaces & (F.col("who") == a), F.col("ctr"))).over(earlier)) for a in range(ACTORS)]
    pred = F.array(*[F.struct(c.alias("ctr"), actor(F.lit(a)).alias("actor")) for a, c in enumerate(last)])
    rows = rows.withColumn("pred", F.filter(pred, lambda p: p["ctr"].isNotNull()))
    null = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        "doc", "ctr", actor(F.col("who")).alias("actor"), F.lit(0).cast("long").alias("obj_ctr"), null("binary").alias("obj_actor"), "key_str", null("long").alias("key_ctr"), null("binary").alias("key_actor"),
        F.lit(False).alias("insert"), F.col("action").cast("int").alias("action"), "value", null("boolean").alias("expand"), null("string").alias("mark_name"), "pred", "ep",
    )


#: The same relation in SQL: saw(n, o) is n.ctr > o.ctr and (n.actor = o.actor or n.ep > o.ep).
SQL_OPS = """
ops as (select 'd' || (user_id % 10) as doc, event_id + 1 as ctr, (user_id + event_id) % 4 as actor, event_type || '/' || (user_id % 50) as k,
   case when event_type = 'click' and value >= 30 then 5 when event_type <> 'click' and value < 25 then 3 else 1 end as action,
   value as v, case when event_type = 'click' then cast(floor(value) as bigint) end as i, event_type = 'click' as counter, date_trunc('day', ts) as ep from events)"""


def sql_live(until: str | None = None, name: str = "live") -> str:
    """CTE of visible operations, with increments, among operations before a day."""
    cut = f"o.ep < timestamp '{until}'" if until else "true"
    cut_n = cut.replace("o.ep", "n.ep")
    return f"""
{name} as (select o.*, case when o.counter then o.i + coalesce((select sum(n.i) from ops n where n.action = 5 and n.doc = o.doc and n.k = o.k and {cut_n} and n.ctr > o.ctr and (n.actor = o.actor or n.ep > o.ep)
       and not exists (select 1 from ops m where m.action <> 5 and m.doc = o.doc and m.k = o.k and m.actor = o.actor and m.ctr > o.ctr and n.ctr > m.ctr and (n.actor = m.actor or n.ep > m.ep))), 0) end as total
   from ops o where o.action = 1 and {cut} and not exists (
     select 1 from ops n where n.action <> 5 and n.doc = o.doc and n.k = o.k and {cut_n} and n.ctr > o.ctr and (n.actor = o.actor or n.ep > o.ep)))"""


def sql_win(live: str = "live", name: str = "win") -> str:
    return f"""
{name} as (select * from (select *, row_number() over (partition by doc, k order by ctr desc, actor desc) as rn, count(*) over (partition by doc, k) as n from {live}) where rn = 1)"""


def clock_before(log: DataFrame, day: str) -> DataFrame:
    """The clock of all operations before a day."""
    return log.where(F.col("ep") < F.lit(day).cast("timestamp")).groupBy("doc", "actor").agg(F.max("ctr").alias("max_op"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change for each document, actor and day; it depends on what everyone had done the last day that anyone did."""
    o = ops(spark, sf_dir)
    c = o.groupBy("doc", "actor", "ep").agg(F.min("ctr").alias("start_op"), F.max("ctr").alias("max_op"), F.count("*").alias("num_ops"))
    c = c.withColumn("hash", _hash(F.col("doc"), actor_no("actor"), F.col("ep")))
    days = c.groupBy("doc", "ep").agg(F.sort_array(F.collect_list("hash")).alias("of_day"))
    days = days.withColumn("deps", F.lag("of_day").over(Window.partitionBy("doc").orderBy("ep")))
    none = F.array().cast("array<binary>")
    return c.join(days, ["doc", "ep"]).select(
        "doc", "hash", "actor", F.row_number().over(Window.partitionBy("doc", "actor").orderBy("ep")).cast("long").alias("seq"), "start_op", "max_op", F.unix_millis("ep").alias("time"),
        F.lit(None).cast("string").alias("message"), F.coalesce("deps", none).alias("deps"), F.lit(None).cast("binary").alias("extra"), "ep", "num_ops",
    )


def _hash(doc: Column, who: Column, ep: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("/", doc, who.cast("string"), F.date_format(ep, "yyyy-MM-dd")), 256))


SQL_CHANGES = """
grp as (select doc, actor, ep, min(ctr) as start_op, max(ctr) as max_op, count(*) as num_ops, sha256(doc || '/' || actor || '/' || strftime(ep, '%Y-%m-%d')) as hash from ops group by doc, actor, ep),
days as (select doc, ep, lag(ep) over (partition by doc order by ep) as before from (select distinct doc, ep from grp)),
changes as (select g.*, row_number() over (partition by g.doc, actor order by g.ep) as seq, before from grp g join days d on g.doc = d.doc and g.ep = d.ep),
edges as (select c.doc, c.hash, p.hash as dep from changes c join changes p on p.doc = c.doc and p.ep = c.before)"""


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: every conversation a list object; a turn hangs off the turn before it, or, if its number is a
    multiple of 3, the one before that, so some turns are siblings. Every fifth turn is deleted again."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("n", F.row_number().over(w)).withColumn("doc", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    up = F.when(F.col("n") % 3 == 0, F.col("n") - 2).otherwise(F.col("n") - 1)
    who = F.col("n") % 2
    a = actor(F.lit(0))
    make = c.where("n = 1").select("doc", F.lit(1).cast("long").alias("ctr"), a.alias("actor"), F.lit(0).cast("long").alias("obj_ctr"), _null("binary").alias("obj_actor"), F.lit("turns").alias("key_str"), _null("long").alias("key_ctr"), _null("binary").alias("key_actor"), F.lit(False).alias("insert"), F.lit(MAKE_LIST).alias("action"), _null(VALUE_TYPE).alias("value"), F.array().cast(PRED).alias("pred"))
    items = c.select(
        "doc", (F.col("n") + 1).cast("long").alias("ctr"), actor(who).alias("actor"), F.lit(1).cast("long").alias("obj_ctr"), a.alias("obj_actor"), _null("string").alias("key_str"),
        F.when(up > 0, up + 1).otherwise(0).cast("long").alias("key_ctr"), F.when(up > 0, actor(up % 2)).alias("key_actor"), F.lit(True).alias("insert"), F.lit(SET).alias("action"), value("str", F.col("text")).alias("value"), F.array().cast(PRED).alias("pred"),
    )
    gone = c.where("n % 5 = 0").select(
        "doc", (F.col("n") + 1_000_000).cast("long").alias("ctr"), a.alias("actor"), F.lit(1).cast("long").alias("obj_ctr"), a.alias("obj_actor"), _null("string").alias("key_str"), (F.col("n") + 1).cast("long").alias("key_ctr"),
        actor(who).alias("key_actor"), F.lit(False).alias("insert"), F.lit(DELETE).alias("action"), _null(VALUE_TYPE).alias("value"), F.array(F.struct((F.col("n") + 1).cast("long").alias("ctr"), actor(who).alias("actor"))).cast(PRED).alias("pred"),
    )
    rows = make.unionByName(items).unionByName(gone)
    return rows.withColumn("action", F.col("action").cast("int")).withColumn("expand", _null("boolean")).withColumn("mark_name", _null("string"))


VALUE_TYPE = "struct<type:string,i:bigint,u:decimal(20,0),d:double,s:string,b:binary,bool:boolean,code:int>"
PRED = "array<struct<ctr:bigint,actor:binary>>"

#: Elements with their path of descending ids: sorted by path they are in sequence order.
SQL_LISTS = """
turns as (select 'c' || conv_id as doc, row_number() over (partition by conv_id order by turn) as n, text from conversations where conv_id is not null and turn is not null),
tree as (select *, case when n % 3 = 0 then n - 2 else n - 1 end as up from turns),
path as (with recursive walk as (select doc, n, text, [-n] as p from tree where up <= 0 union all select t.doc, t.n, t.text, list_append(w.p, -t.n) from tree t join walk w on t.doc = w.doc and t.up = w.n) select * from walk),
pos as (select doc, n, text, row_number() over (partition by doc order by p) - 1 as pos from path),
shown as (select *, row_number() over (partition by doc order by pos) - 1 as index, coalesce(sum(length(text)) over (partition by doc order by pos rows between unbounded preceding and 1 preceding), 0) as start from pos where n % 5 <> 0)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: every document a text object of its lines, each with its newline; one mark per labelled document.

    A labelled document of at least 4 lines has lines 2 to 3 bold, and its last 3 lines in the language's colour.
    """
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("doc"), "doc_id", "lang", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    a = actor(F.lit(0))
    obj = [F.lit(1).cast("long").alias("obj_ctr"), a.alias("obj_actor")]
    make = d.select("doc", F.lit(1).cast("long").alias("ctr"), a.alias("actor"), F.lit(0).cast("long").alias("obj_ctr"), _null("binary").alias("obj_actor"), F.lit("body").alias("key_str"), _null("long").alias("key_ctr"), _null("binary").alias("key_actor"), F.lit(False).alias("insert"), F.lit(MAKE_TEXT).alias("action"), _null(VALUE_TYPE).alias("value"), _null("boolean").alias("expand"), _null("string").alias("mark_name"))
    lines = d.select("doc", F.posexplode("lines").alias("i", "line")).select(
        "doc", (F.col("i") + 2).cast("long").alias("ctr"), a.alias("actor"), *obj, _null("string").alias("key_str"), F.when(F.col("i") > 0, F.col("i") + 1).otherwise(0).cast("long").alias("key_ctr"), F.when(F.col("i") > 0, a).alias("key_actor"),
        F.lit(True).alias("insert"), F.lit(SET).alias("action"), value("str", F.concat("line", F.lit("\n"))).alias("value"), _null("boolean").alias("expand"), _null("string").alias("mark_name"),
    )
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    n = F.size("lines")
    big = 1_000_000
    # begin and end rows hang off the line before them; their ids are larger, so they come first among its children
    rows = F.array(
        F.struct(F.lit(big).alias("c"), F.lit(2).alias("at"), F.lit("bold").alias("m"), F.lit("true").alias("v")),
        F.struct(F.lit(big + 1).alias("c"), F.lit(4).alias("at"), _null("string").alias("m"), _null("string").alias("v")),
        F.struct(F.lit(big + 2).alias("c"), (n - 2).alias("at"), F.lit("colour").alias("m"), F.col("lang").alias("v")),
        F.struct(F.lit(big + 3).alias("c"), (n + 1).alias("at"), _null("string").alias("m"), _null("string").alias("v")),
    )
    marks = d.join(labelled, "doc_id").where("size(lines) >= 4").select("doc", F.explode(rows).alias("r")).select(
        "doc", F.col("r.c").cast("long").alias("ctr"), a.alias("actor"), *obj, _null("string").alias("key_str"), F.col("r.at").cast("long").alias("key_ctr"), a.alias("key_actor"), F.lit(True).alias("insert"), F.lit(7).alias("action"),
        F.when(F.col("r.m").isNotNull(), value("str", F.col("r.v"))).otherwise(value("null")).alias("value"), F.lit(False).alias("expand"), F.col("r.m").alias("mark_name"),
    )
    out = make.unionByName(lines).unionByName(marks)
    return out.withColumn("action", F.col("action").cast("int")).withColumn("pred", F.array().cast(PRED))


SQL_TEXTS = """
src as (select 't' || doc_id as doc, doc_id, lang, string_split(coalesce(text, ''), chr(10)) as lines from documents where doc_id is not null),
line as (select doc, unnest(range(0, len(lines))) as i, unnest(lines) || chr(10) as s from src),
lat as (select *, coalesce(sum(length(s)) over (partition by doc order by i rows between unbounded preceding and 1 preceding), 0) as start from line),
marked as (select doc, lang, len(lines) as n from src where len(lines) >= 4 and doc_id in (select doc_id from labels))"""


def orders_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, orders and lineitem as nested objects: a document per customer, a map of orders, each with a list of
    line items."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    a = actor(F.lit(0))
    doc = lambda c: F.concat(F.lit("k"), c.cast("string"))
    null = {"key_ctr": _null("long"), "key_actor": _null("binary"), "value": _null(VALUE_TYPE)}
    # ids: orders object 1; order n is 10n + 2, its status 10n + 3, its list 10n + 4; items are beyond
    n = F.col("o_orderkey")
    make = o.select("o_custkey").distinct().select(doc(F.col("o_custkey")).alias("doc"), F.lit(1).cast("long").alias("ctr"), F.lit(0).cast("long").alias("obj_ctr"), _null("binary").alias("obj_actor"), F.lit("orders").alias("key_str"), F.lit(False).alias("insert"), F.lit(MAKE_MAP).alias("action"), *[v.alias(k) for k, v in null.items()])
    one = o.select(doc(F.col("o_custkey")).alias("doc"), (n * 10 + 2).alias("ctr"), F.lit(1).cast("long").alias("obj_ctr"), a.alias("obj_actor"), n.cast("string").alias("key_str"), F.lit(False).alias("insert"), F.lit(MAKE_MAP).alias("action"), *[v.alias(k) for k, v in null.items()])
    status = o.select(doc(F.col("o_custkey")).alias("doc"), (n * 10 + 3).alias("ctr"), (n * 10 + 2).alias("obj_ctr"), a.alias("obj_actor"), F.lit("status").alias("key_str"), F.lit(False).alias("insert"), F.lit(SET).alias("action"), _null("long").alias("key_ctr"), _null("binary").alias("key_actor"), value("str", F.col("o_orderstatus")).alias("value"))
    items = o.select(doc(F.col("o_custkey")).alias("doc"), (n * 10 + 4).alias("ctr"), (n * 10 + 2).alias("obj_ctr"), a.alias("obj_actor"), F.lit("items").alias("key_str"), F.lit(False).alias("insert"), F.lit(MAKE_LIST).alias("action"), *[v.alias(k) for k, v in null.items()])
    base = 1 << 40
    own = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    w = Window.partitionBy("o_orderkey").orderBy("l_linenumber")
    own = own.withColumn("i", F.row_number().over(w))
    item = own.select(
        doc(F.col("o_custkey")).alias("doc"), (F.lit(base) + n * 100 + F.col("i")).alias("ctr"), (n * 10 + 4).alias("obj_ctr"), a.alias("obj_actor"), _null("string").alias("key_str"), F.lit(True).alias("insert"), F.lit(SET).alias("action"),
        F.when(F.col("i") > 1, F.lit(base) + n * 100 + F.col("i") - 1).otherwise(0).cast("long").alias("key_ctr"), F.when(F.col("i") > 1, a).alias("key_actor"), value("int", F.col("q")).alias("value"),
    )
    out = make
    for x in (one, status, items, item):
        out = out.unionByName(x)
    return out.withColumn("actor", a).withColumn("action", F.col("action").cast("int")).withColumn("expand", _null("boolean")).withColumn("mark_name", _null("string")).withColumn("pred", F.array().cast(PRED))
