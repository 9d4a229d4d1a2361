"""Settings of the state stores that a query starts with; Spark keeps them in the query's checkpoint."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: A join keeps both sides in one store of each partition instead of four, and a micro-batch writes its changes alone.
JOIN_STORES = ROCKSDB | {
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",  # the checkpoint of a replay is its own
}
#: Rows of a micro-batch for which a replay gets a partition of state, and its least number of partitions.
ROWS_A_PARTITION, LEAST_PARTITIONS = 1_000, 4


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Queries started inside have these settings; those of the session are as before at the end."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_partitions(rows: int, most: int) -> int:
    """Partitions of state for micro-batches of so many rows, no more than `most`.

    Each takes a task and files of its own in every micro-batch, however few rows it has.
    """
    return min(most, max(LEAST_PARTITIONS, -(-rows // ROWS_A_PARTITION)))


def paced_stores(spark: SparkSession, rows: int) -> dict[str, str]:
    """Settings for the joins of a replay with micro-batches of so many rows."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return JOIN_STORES | {"spark.sql.shuffle.partitions": str(state_partitions(rows, most))}
