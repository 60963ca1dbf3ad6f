"""Command line: JSON in and out of a store, merge, inspection, anonymising.

    python -m causeway.cli import FILE STORE | export STORE | examine STORE | merge STORE STORE OUT | anonymize STORE OUT
    python -m causeway.cli load-chunks FILE STORE | save-chunks STORE FOLDER | examine-sync MESSAGE
"""

from __future__ import annotations

import json
import secrets
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.schema import CHANGES
from .operators import anonymize, hydrate, merge
from .sources import chunks, messages, store


def import_json(spark: SparkSession, file: str, out: str, actor: bytes = b"\x01") -> None:
    """One JSON object a line, or a file of one; each becomes a document with one change."""
    rows = spark.read.text(file, wholetext=not file.endswith("l")).select(F.sha2("value", 256).alias("doc"), F.col("value").alias("json"))
    ops = hydrate.from_json(rows, actor)
    own = ops.groupBy("doc").agg(F.max("ctr").alias("max_op"))
    none = F.array().cast("array<binary>")
    changes = own.select("doc", F.unhex(F.sha2(F.concat("doc", F.lit("/1")), 256)).alias("hash"), F.lit(actor).alias("actor"), F.lit(1).cast("long").alias("seq"), F.lit(1).cast("long").alias("start_op"), "max_op", F.lit(0).cast("long").alias("time"), F.lit(None).cast("string").alias("message"), none.alias("deps"), F.lit(b"").alias("extra"))
    new = chunks.rehashed(changes, ops).select(*CHANGES.names)
    store.save(new, ops, out)


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("causeway").getOrCreate()
    what, rest = args[0], args[1:]
    if what == "import":
        import_json(spark, *rest)
    elif what == "export":
        for r in hydrate.to_json(store.load(spark, rest[0])[1]).toLocalIterator():
            print(r["json"])
    elif what == "examine":
        c, o = store.load(spark, rest[0], store.Options(verify=False, partial="ignore"))
        for r in store.expanded(c, o).toLocalIterator():
            print(r["json"])
    elif what == "examine-sync":
        with open(rest[0], "rb") as f:
            m = messages.decode(f.read())
        show = {k: [x.hex() for x in v] if k in ("heads", "need", "last_sync", "parts") else v for k, v in m.items()}
        print(json.dumps(show))
    elif what == "merge":
        (c1, o1), (c2, o2) = (store.load(spark, p) for p in rest[:2])
        store.save(merge.apply_changes(c1, c2)[0], merge.merge_ops(o1, o2), rest[2])
    elif what == "anonymize":
        c, o = store.load(spark, rest[0])
        seed = secrets.token_hex(32)  # kept nowhere: hashes under a known key fall to a dictionary
        actors = anonymize.actor_map(o)
        new = anonymize.anonymize(o, seed)
        own = c.join(actors, ["doc", "actor"]).drop("actor").withColumnRenamed("new", "actor").withColumn("message", F.lit(None).cast("string")).withColumn("time", F.lit(0).cast("long"))
        store.save(chunks.rehashed(own.select(*CHANGES.names), new).select(*CHANGES.names), new, rest[1])
    elif what == "load-chunks":
        files = spark.read.format("binaryFile").load(rest[0]).select(F.col("path").alias("doc"), F.col("content").alias("bytes"))
        store.save(*chunks.read(files), rest[1])
    elif what == "save-chunks":
        chunks.write(*store.load(spark, rest[0])).write.parquet(rest[1])
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) if sys.argv[1:] else 2)
