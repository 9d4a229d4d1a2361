"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scopes: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where none is set and all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidejoin-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read again: computed once, its lineage cut,
    and still there when an executor is lost. keep: also when a scratch() around it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes and not keep:
        _scopes[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes, at its end, the folders that staged() wrote inside, without those to keep."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def few(df: DataFrame, most: int) -> DataFrame:
    """df with a hint to broadcast, if its rows, counted, are no more than `most`; Spark shuffles it otherwise.

    For tables whose rows are of bounded size.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
