"""Anonymised op logs of the same shape: actors, keys, strings and numbers are replaced, structure and order stay.

Actors keep their byte order, so winners and sequence order stay what they were. Everything is a keyed hash of the old
value, so it is the same in every partition and run for one seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import VALUE


def actor_map(ops: DataFrame) -> DataFrame:
    """(doc, actor, new): per document 16 bytes that sort as the actors do."""
    a = ops.select("doc", "actor").distinct()
    rank = F.dense_rank().over(Window.partitionBy("doc").orderBy("actor"))
    return a.withColumn("new", F.unhex(F.lpad(F.hex(rank.cast("long")), 32, "0")))


def letters(text: Column, seed: str) -> Column:
    """Other letters and digits, the same length and the same white space and signs."""
    mask = F.sha2(F.concat(F.lit(seed), F.coalesce(text, F.lit(""))), 256)
    out = F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(mask, i % 64 + 1, F.lit(1))).otherwise(c))
    return F.when(text.isNotNull(), F.when(F.length(text) > 0, F.array_join(F.slice(out, 1, F.length(text)), "")).otherwise(""))


def key_of(key: Column, seed: str) -> Column:
    return F.when(key.isNotNull(), F.concat(F.lit("k"), F.substring(F.sha2(F.concat(F.lit(seed), key), 256), 1, 16)))


def anonymize(ops: DataFrame, seed: str = "0") -> DataFrame:
    """The log with other actors, keys, mark names and values of the same types. Increments keep their sign."""
    actors = actor_map(ops)
    named = ops.join(actors.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct(F.hex("actor"), "new"))).alias("to")), "doc")
    swap = lambda c: F.when(c.isNotNull(), F.element_at("to", F.hex(c)))
    mixed = F.xxhash64(F.lit(seed), "value.i")
    v = F.when(
        F.col("value").isNotNull(),
        F.struct(
            F.col("value.type").alias("type"),
            F.when(F.col("value.i").isNotNull(), F.signum("value.i").cast("long") * (F.pmod(mixed, F.lit(1000)) + 1)).alias("i"),
            F.when(F.col("value.u").isNotNull(), F.pmod(F.xxhash64(F.lit(seed), "value.u"), F.lit(1000))).cast("decimal(20,0)").alias("u"),
            F.when(F.col("value.d").isNotNull(), F.pmod(F.xxhash64(F.lit(seed), "value.d"), F.lit(1_000_000)) / 1000).alias("d"),
            letters(F.col("value.s"), seed).alias("s"),
            F.when(F.col("value.b").isNotNull(), F.unhex(F.substring(F.sha2(F.concat(F.encode(F.lit(seed), "UTF-8"), F.col("value.b")), 256), F.lit(1), F.least(F.lit(64), 2 * F.octet_length("value.b"))))).alias("b"),
            F.when(F.col("value.bool").isNotNull(), F.pmod(F.xxhash64(F.lit(seed), "ctr"), F.lit(2)) == 1).alias("bool"),
            F.col("value.code").alias("code"),
        ).cast(VALUE),
    )
    out = named.withColumn("value", v).withColumn("key_str", key_of(F.col("key_str"), seed)).withColumn("mark_name", key_of(F.col("mark_name"), seed))
    out = out.withColumn("pred", F.transform("pred", lambda p: F.struct(p["ctr"].alias("ctr"), F.element_at("to", F.hex(p["actor"])).alias("actor"))))
    for c in ("actor", "obj_actor", "key_actor"):
        out = out.withColumn(c, swap(F.col(c)))
    return out.select(*ops.columns)
