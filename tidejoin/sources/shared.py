"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not (spark.sparkContext.master or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or f"file://{tempfile.mkdtemp(prefix='tidejoin-')}"


def own_folder(spark: SparkSession, name: str) -> str:
    """A folder of one's own in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: computed once, and still there when an executor is lost."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
