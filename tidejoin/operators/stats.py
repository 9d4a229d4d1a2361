"""Statistics of a join run, and the shape of its hash table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidejoin.functions.murmur import bucket

TUPLE_BYTES = 16
#: Rows of a bucket's chunk, and the share of buckets in use that a table is sized for.
CHUNK, FILL = 64, 0.2


def run_stats(r: DataFrame, s: DataFrame, pairs: DataFrame, rate_r: int) -> DataFrame:
    """One row: rows out and in, pairs a second of stream, MB/s at 16 bytes a row, mean event-time lag of a pair in ms (NULL without pairs)."""
    sides = r.select(F.lit("r").alias("side"), F.lit(None).cast("long").alias("lag")).union(s.select(F.lit("s"), F.lit(None).cast("long")))
    rows = sides.union(pairs.select(F.lit("out"), F.abs(F.col("r_t") - F.col("s_t"))))
    of = lambda side: F.sum((F.col("side") == side).cast("long"))
    out, n_r, n_s = F.coalesce(of("out"), F.lit(0)), F.coalesce(of("r"), F.lit(0)), F.coalesce(of("s"), F.lit(0))
    seconds = n_r / F.lit(float(rate_r))
    return rows.agg(
        out.alias("out_count"), (n_r + n_s).alias("in_count"), F.try_divide(out.cast("double"), seconds).alias("throughput"),
        F.try_divide((n_r + n_s) * F.lit(TUPLE_BYTES / 1e6), seconds).alias("mb_per_s"), F.round(F.try_divide(F.sum("lag").cast("double"), out) / 1e6, 3).alias("latency_ms"),
    )


def output_histogram(pairs: DataFrame, seconds: int) -> DataFrame:
    """(slot, n): pairs by the slot of time in which the later row came, with zeros between the first and last."""
    slots = pairs.select(F.floor(F.greatest("r_t", "s_t") / F.lit(seconds * 1_000_000_000)).cast("long").alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    every = slots.agg(F.min("slot").alias("low"), F.max("slot").alias("high")).where("low IS NOT NULL").select(F.explode(F.sequence("low", "high")).alias("slot"))
    return every.join(slots, "slot", "left").select("slot", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def expired(rows: DataFrame, time: str, seconds: int, progress: Column | int) -> DataFrame:
    """Rows that a window of that length no longer holds when the other stream has got to `progress` nanoseconds."""
    return rows.where(F.col(time) + F.lit(seconds * 1_000_000_000) <= progress)


def expired_counts(r: DataFrame, s: DataFrame, w_r: int, w_s: int) -> DataFrame:
    """One row: how many rows of each stream have expired at the other one's last row."""
    ends = r.agg(F.max("r_t").alias("r_end")).crossJoin(s.agg(F.max("s_t").alias("s_end")))  # one row
    count = lambda rows, side: rows.select(F.lit(int(side == "r")).alias("l"), F.lit(int(side == "s")).alias("r"))
    left = count(expired(r.join(F.broadcast(ends)), "r_t", w_r, F.col("s_end")), "r")
    right = count(expired(s.join(F.broadcast(ends)), "s_t", w_s, F.col("r_end")), "s")
    return left.union(right).agg(F.coalesce(F.sum("l"), F.lit(0)).cast("long").alias("r_expired"), F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("s_expired"))


#: Columns of the statistics report, in its order.
REPORT = ["out", "throughput", "latency_ms", "in", "runtime_ns", "idle_ns", "proc_ns", "switches"]


def report(stats: DataFrame, runtime_ns: Column, idle_ns: Column, switches: Column) -> DataFrame:
    """The eight columns of a run's report, from run_stats and what was measured besides; processing is what was not idle."""
    values = [F.col("out_count"), F.col("throughput"), F.col("latency_ms"), F.col("in_count"), runtime_ns, idle_ns, runtime_ns - idle_ns, switches]
    return stats.select(*(v.alias(name) for v, name in zip(values, REPORT, strict=True)))


def processing_rates(report: DataFrame) -> DataFrame:
    """Adds rows in a second of processing, and MB/s of them at 16 bytes a row: rates without idle time."""
    rate = F.try_divide(F.col("in").cast("double"), F.col("proc_ns") / 1e9)
    return report.withColumns({"in_per_s": rate, "proc_mb_per_s": rate * F.lit(TUPLE_BYTES / 1e6)})


def write_report(report: DataFrame, path: str) -> None:
    """Adds the rows to a folder of CSV files with a header."""
    report.select(*REPORT).write.mode("append").csv(path, header=True)


def bucket_occupancy(keys: DataFrame, key: str, buckets: int, seed: int = 1) -> DataFrame:
    """(bucket, n): rows in each bucket in use."""
    return keys.where(F.col(key).isNotNull()).groupBy(bucket(F.col(key), buckets, seed).alias("bucket")).agg(F.count("*").alias("n"))


def table_buckets(window_s: int, rate: int) -> int:
    """Buckets of the hash table for a window: chunks in a power of two, doubled once if too full."""
    chunks = window_s * rate / CHUNK
    size = 1 << max(0, math.ceil(math.log2(max(1.0, chunks))))
    return size * 2 if size < chunks / FILL else size


def radix_partitions(rows: DataFrame, key: str, fanout: int) -> DataFrame:
    """(part, n, first): size of each partition by key modulo fanout, and where it begins when they lie end to end."""
    from pyspark.sql import Window

    sizes = rows.where(F.col(key).isNotNull()).groupBy(F.pmod(F.col(key), F.lit(fanout)).cast("long").alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # fanout rows
    return sizes.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"))
