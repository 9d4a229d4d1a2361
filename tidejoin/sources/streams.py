"""Streams R and S: from event tables, and generated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidejoin.functions.murmur import murmur3

NANOS = 1_000_000_000


def as_r(df: DataFrame, row: Column, ts: Column, x: Column, y: Column) -> DataFrame:
    """R(r, r_t, r_ts, x, y): row number, nanoseconds, event time and two payloads."""
    ts = ts.cast("timestamp")
    return df.select(row.cast("long").alias("r"), (F.unix_micros(ts) * 1000).alias("r_t"), ts.alias("r_ts"), x.alias("x"), y.alias("y"))


def as_s(df: DataFrame, row: Column, ts: Column, a: Column, b: Column) -> DataFrame:
    """S(s, s_t, s_ts, a, b), as R."""
    ts = ts.cast("timestamp")
    return df.select(row.cast("long").alias("s"), (F.unix_micros(ts) * 1000).alias("s_t"), ts.alias("s_ts"), a.alias("a"), b.alias("b"))


def events_as_streams(events: DataFrame, r_type: str = "view", s_type: str = "click") -> tuple[DataFrame, DataFrame]:
    """R and S from two types of events; works on batch and streaming tables."""
    parts = [F.col(c) for c in ("event_id", "ts", "user_id", "value")]
    return as_r(events.where(F.col("event_type") == r_type), *parts), as_s(events.where(F.col("event_type") == s_type), *parts)


def _timed(spark: SparkSession, n: int, rate: int) -> DataFrame:
    """Ids with one row each 1/rate seconds, the first one after a step."""
    if rate <= 0 or n < 0:
        raise ValueError("the rate has to be above 0, the number of rows 0 or more")
    return spark.range(n).withColumn("t_ns", (F.col("id") + 1) * F.lit(NANOS // rate))


def linear_stream(spark: SparkSession, n: int, rate: int) -> DataFrame:
    """(id, t_ns, x, y): x and y rise in turn, so that x + y = id + 1; the data of hand-checked counts."""
    return _timed(spark, n, rate).select("id", "t_ns", (F.floor(F.col("id") / 2) + 1).cast("int").alias("x"), F.floor((F.col("id") + 1) / 2).cast("float").alias("y"))


def hashed_stream(spark: SparkSession, n: int, rate: int, int_range: int, float_range: int, seed: int = 0) -> DataFrame:
    """(id, t_ns, x, y): keys in [0, range) by Murmur hashes of the id with two seeds, the same on every run."""
    pick = lambda own, size: murmur3(F.col("id"), own) % size
    return _timed(spark, n, rate).select("id", "t_ns", pick(2 * seed + 1, int_range).cast("int").alias("x"), pick(2 * seed + 2, float_range).cast("float").alias("y"))


def random_stream(spark: SparkSession, n: int, rate: int, int_range: int, float_range: int, seed: int = 0) -> DataFrame:
    """(id, t_ns, x, y): seeded random keys; the same on every run with the same partitions."""
    return _timed(spark, n, rate).select("id", "t_ns", F.floor(F.rand(seed) * int_range).cast("int").alias("x"), F.floor(F.rand(seed + 1) * float_range).cast("float").alias("y"))


def generated_pair(r: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R and S from two generated streams."""
    at = lambda df: F.timestamp_micros(F.floor(df["t_ns"] / 1000).cast("long"))
    left = r.select(F.col("id").alias("r"), F.col("t_ns").alias("r_t"), at(r).alias("r_ts"), "x", "y")
    return left, s.select(F.col("id").alias("s"), F.col("t_ns").alias("s_t"), at(s).alias("s_ts"), F.col("x").alias("a"), F.col("y").alias("b"))


def replayed(stream: DataFrame, cap: int, rate: int, n: int) -> DataFrame:
    """n rows by playing the first `cap` rows of a generated stream again and again, later each time by the time they took."""
    rows = stream.where(F.col("id") < cap).withColumn("iteration", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, -(-n // cap) - 1)).cast("long"))))
    out = rows.select((F.col("iteration") * cap + F.col("id")).alias("id"), "iteration", F.col("id").alias("source_id"), (F.col("t_ns") + F.col("iteration") * cap * (NANOS // rate)).alias("t_ns"), "x", "y")
    return out.where(F.col("id") < n)


def rate_stream(spark: SparkSession, rate: int, int_range: int) -> DataFrame:
    """An unbounded stream (id, ts, x, y) at a steady rate."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    return rows.select(F.col("value").alias("id"), F.col("timestamp").alias("ts"), F.pmod(F.xxhash64("value"), F.lit(int_range)).cast("int").alias("x"), F.col("value").cast("float").alias("y"))
