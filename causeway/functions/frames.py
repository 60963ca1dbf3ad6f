"""Cut lineage and iterate: what the graph operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, in local mode alone, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="causeway-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows without lineage, checkpointed in the folder that executors share.

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
    """The same rows as a Parquet table in that folder: for wide rows, and where a checkpoint's plan can't be used."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_size(df: DataFrame, by: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the groups that have at most `most`, and those of the larger ones if there are any."""
    large = cut(df.groupBy(by).count().where(f"count > {most}").select(by))
    if large.isEmpty():
        return df, None
    return df.join(large, by, "left_anti"), df.join(large, by, "left_semi")


def grouped(df: DataFrame, by: list[str], one: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """What `one` makes of each group's rows, as groupBy().applyInArrow() does, for many small groups: they pass through a
    task as one stream, sorted by their key, so a group costs no exchange of its own with Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*[batch[c].to_pylist() for c in by]))
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
            done = []
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if held and keys[a] != key:
                    done.append(one(pa.Table.from_batches(held).combine_chunks()))
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held:
            yield from one(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)
