"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a new one only on a single machine where none is named."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="sieveline-")
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Row groups of intermediate tables: each writer holds one, and several write at a time.
GROUP_BYTES = 16 << 20


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts lineage and outlives lost executors. Writers hold a bounded row group."""
    at = shared_path(df.sparkSession, what)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
