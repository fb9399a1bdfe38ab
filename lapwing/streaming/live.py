"""A live feed as a stream of keyed upserts. Each micro-batch is reduced to one row a key and merged with the state so far, which is
a table of its own for every batch: a batch that runs again writes the same table again, so a retry changes nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators.upsert import latest_of


def _shared(spark: SparkSession) -> str:
    """A folder in the one that the cluster names; a temporary one only where none is named and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    found = found or "file://" + tempfile.mkdtemp(prefix="lapwing-")
    return f"{found.rstrip('/')}/live-{uuid.uuid4().hex}"


def upserts(feed: DataFrame, folder: str, keys: Sequence[str], final: Column, at: str, tie: str):
    """Starts the stream and returns its query; the state after batch n is the table state-n in the folder. It stops when the input there now is used up."""
    spark = feed.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        now = batch.withColumn("__final", final)
        if n:
            now = now.unionByName(spark.read.parquet(f"{folder}/state-{n - 1}"))
        latest_of(now, keys, "__final", at, tie).write.mode("overwrite").parquet(f"{folder}/state-{n}")

    return feed.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def replay(spark: SparkSession, path: str, keys: Sequence[str], final: Column, at: str, tie: str) -> DataFrame:
    """The state after everything at path has come in."""
    folder = _shared(spark)
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only by a pattern
    feed = spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)
    query = upserts(feed, folder, keys, final, at, tie)
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(f"{folder}/state-{last}").drop("__final")
