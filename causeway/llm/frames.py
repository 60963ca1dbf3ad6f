"""What the operators share on the Spark side: the shared folder, cut lineage, sizes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, in local mode alone, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="causeway-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows without lineage, as files in the shared folder.

    Constraints aren't carried over: a union's can name columns that the checkpoint no longer has.
    """
    spark, name = df.sparkSession, "spark.sql.constraintPropagation.enabled"
    shared_dir(spark)
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder; for larger rows than `cut`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


#: Rows of an Arrow batch between Spark and Python: whole texts can be long, and each side holds a batch or two a task.
BATCH_ROWS = 1_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Unless the session has chosen otherwise, batches to Python are small from here on."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same step, after which the worker gives freed memory back: it waits for its next task beside busy ones."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def sampled(df: DataFrame, by: Column, n: int) -> DataFrame:
    """At most n rows of df, those with the smallest hashes of `by`: the same whatever the partitions.

    The bound is found from hashes alone; only rows under it are read in full.
    """
    h = F.xxhash64(by)
    most = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h").alias("h")).first()["h"]
    if most is None:
        return df.limit(0)
    return df.where(h <= most).orderBy(h).limit(n)


def sampled_groups(df: DataFrame, by: Column, group: str, sizes: dict, n: int) -> DataFrame:
    """At most n rows of each group, those with the smallest hashes of `by`, in one pass; the hash is column cw_h.

    sizes: rows of each group, by which a first bound on the hash is set: about 1.5 * n + 50 rows of a group are under it,
    and the smallest n of them are taken. A group whose hashes are unevenly spread can give fewer than n.
    """
    bound = F.lit(-(1 << 63))
    for value, size in sorted(sizes.items()):
        share = min(1.0, (1.5 * n + 50) / max(1, size))
        bound = F.when(F.col(group) == F.lit(value), F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63)))).otherwise(bound)
    rows = df.withColumn("cw_h", F.xxhash64(by)).where(F.col("cw_h") <= bound)
    place = F.row_number().over(Window.partitionBy(group).orderBy("cw_h"))
    return rows.withColumn("cw_place", place).where(F.col("cw_place") <= n).drop("cw_place")
