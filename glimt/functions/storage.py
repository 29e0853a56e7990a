"""The folder that the driver and all executors share, and rows kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a session on one machine may go without that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='glimt-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: the lineage is cut, and lost executors lose nothing."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "snappy").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
