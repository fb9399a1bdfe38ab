"""Reading the tables of a data set."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table as it lies in Parquet: columns and filters reach the scan from what is done with it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; in a temporary one only where none is named and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='lapwing-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
