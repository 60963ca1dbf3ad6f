"""Columnar codecs as relations: runs, deltas, boolean runs and prefix sums over (group, pos, value) columns.

At rest Parquet does this; here are the queries that one asks of such columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """(by.., run, first, value, count): maximal runs of equal values, nulls equal to each other."""
    w = Window.partitionBy(*by).orderBy(pos)
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    rows = df.withColumn("cw_new", new).withColumn("run", F.sum("cw_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "run").agg(F.min(pos).alias("first"), F.first(value).alias(value), F.count("*").alias("count"))


def expand(run_rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by.., pos, value): runs back to rows, positions counted from 0."""
    w = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    at = run_rows.withColumn("cw_at", F.coalesce(F.sum("count").over(w), F.lit(0)))
    return at.select(*by, F.explode(F.sequence(F.col("cw_at"), F.col("cw_at") + F.col("count") - 1)).alias("pos"), value)


def bool_runs(df: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """(by.., counts): run lengths that alternate, beginning with false (0 if the first value is true)."""
    r = runs(df, by, pos, value)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("run", value, "count"))), lambda x: x)
    out = r.groupBy(*by).agg(rows.alias("r"))
    lengths = F.transform("r", lambda x: x["count"])
    return out.select(*by, F.when(F.element_at("r", 1)[value], F.concat(F.array(F.lit(0).cast("long")), lengths)).otherwise(lengths).alias("counts"))


def only_value(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by.., only, is_only): whether a column holds one value alone."""
    return df.groupBy(*by).agg(F.min(value).alias("only"), ((F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))) == 1).alias("is_only"))


def deltas(df: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """The rows with `delta`: the value less the one before it (the first less 0)."""
    w = Window.partitionBy(*by).orderBy(pos)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def undelta(df: DataFrame, by: list[str], pos: str) -> DataFrame:
    """The rows with `value`: running sums of delta."""
    return df.withColumn("value", F.sum("delta").over(Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))


def delta_runs(df: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """Runs of equal deltas: what a delta column stores."""
    return runs(deltas(df, by, pos, value), by, pos, "delta")


def prefix(df: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """The rows with `before` and `total`: sums of the values before and up to each."""
    w = Window.partitionBy(*by).orderBy(pos)
    out = df.withColumn("total", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("before", F.col("total") - F.col(value))


def sum_range(df: DataFrame, by: list[str], pos: str, value: str, low: int, high: int) -> DataFrame:
    """(by.., sum): sum of the values at positions low to high - 1."""
    return df.where((F.col(pos) >= low) & (F.col(pos) < high)).groupBy(*by).agg(F.sum(value).alias("sum"))


def index_for_total(df: DataFrame, by: list[str], pos: str, value: str, total: int) -> DataFrame:
    """(by.., pos): the first position at which the running sum reaches `total`."""
    return prefix(df, by, pos, value).where(F.col("total") >= total).groupBy(*by).agg(F.min(pos).alias(pos))


def find_range(df: DataFrame, by: list[str], pos: str, value: str, low, high) -> DataFrame:
    """Positions whose value lies in [low, high]."""
    return df.where(F.col(value).between(low, high)).select(*by, pos, value)


def find_first(df: DataFrame, by: list[str], pos: str, value: str, wanted) -> DataFrame:
    """(by.., pos): the first position of a value."""
    return df.where(F.col(value).eqNullSafe(F.lit(wanted))).groupBy(*by).agg(F.min(pos).alias(pos))


def splice(df: DataFrame, by: list[str], pos: str, value: str, at: int, delete: int, new: list) -> DataFrame:
    """The column of each group with `delete` values from `at` on replaced by new ones."""
    kept = df.where((F.col(pos) < at) | (F.col(pos) >= at + delete))
    moved = kept.select(*by, F.when(F.col(pos) < at, F.col(pos)).otherwise(F.col(pos) - delete + len(new)).alias(pos), value)
    if not new:
        return moved
    kind = df.schema[value].dataType
    add = F.array(*[F.lit(x).cast(kind) for x in new])
    return moved.unionByName(df.select(*by).distinct().select(*by, F.posexplode(add).alias("cw_i", value)).select(*by, (F.col("cw_i") + at).cast(df.schema[pos].dataType).alias(pos), value))


def remap(df: DataFrame, value: str, table: DataFrame) -> DataFrame:
    """Values replaced by (old, new) where listed."""
    t = table.select(F.col("old").alias("cw_old"), F.col("new").alias("cw_new"))
    return df.join(t, F.col(value) == F.col("cw_old"), "left").withColumn(value, F.coalesce("cw_new", value)).drop("cw_old", "cw_new")
