"""Analytics over power samples (channel, t, v) and measurement logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidejoin.operators.places import placed


def log_mean(log: DataFrame, field: int = 4) -> DataFrame:
    """Mean of one field of a power log; a field that is no number counts as 0."""
    return log.agg(F.avg(F.coalesce(F.get("values", F.lit(field)).try_cast("double"), F.lit(0.0))).alias("mean"))


def log_means(log: DataFrame, by: str, field: int) -> DataFrame:
    """(by, n, n_bad, mean, high) of one field of power logs, for each value of the column `by`: n_bad lines have no number there and count as 0.

    Lines without a number in their first field, as headers are, are left out.
    """
    number = lambda i: F.get("values", F.lit(i)).try_cast("double")
    body = log.where(number(0).isNotNull()).select(F.col(by), number(field).alias("x"))
    return body.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("n_bad"), F.avg(F.coalesce("x", F.lit(0.0))).alias("mean"), F.max("x").alias("high"))


def log_column_means(log: DataFrame, columns: int) -> DataFrame:
    """Means of the columns in which every field is a number (else NULL); columns beyond the shortest line are left out."""
    fields = [F.get("values", F.lit(i)).try_cast("double") for i in range(columns)]
    shortest = F.min(F.size("values"))
    return log.agg(*(F.when((shortest > i) & (F.count(f) == F.count("*")), F.avg(f)).alias(f"c{i}") for i, f in enumerate(fields)))


def without_last(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """All but the last row of each group: the last line of a log may be cut short."""
    last = rows.groupBy(group).agg(F.max(F.struct(*order)).alias("__last"))
    return rows.join(last, group).where(F.struct(*order) < F.col("__last")).drop("__last")


def channel_ranges(samples: DataFrame, channel: str, value: Column) -> DataFrame:
    """(channel, low, mean, high)."""
    return samples.groupBy(channel).agg(F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"))


#: Samples of a channel that one task goes through together.
BLOCK = 100_000


def numbered(samples: DataFrame, channel: str, order: list[str]) -> DataFrame:
    """Adds number: of the sample in its channel, from 1, by a range sort that deals a channel over as many tasks as it needs."""
    return placed(samples, [channel], [F.col(c) for c in order], "number").withColumn("number", F.col("number") + 1)


def moving_average(samples: DataFrame, channel: str, order: list[str], value: str, width: int) -> DataFrame:
    """Adds mean: of the last `width` samples of the channel, or of as many as there are."""
    if width < 1:
        raise ValueError("a width of 1 or more")
    size = max(BLOCK, width)
    block, place = F.floor((F.col("number") - 1) / size), (F.col("number") - 1) % size
    # the samples at a block's end are needed in the next one, too
    rows = numbered(samples, channel, order).withColumn("__own", block)
    rows = rows.withColumn("__block", F.explode(F.when(place > size - width, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    last = Window.partitionBy(channel, "__block").orderBy("number").rowsBetween(1 - width, 0)
    return rows.withColumn("mean", F.avg(value).over(last)).where("__own = __block").drop("number", "__own", "__block")


def decimate(samples: DataFrame, channel: str, order: list[str], every: int) -> DataFrame:
    """Each `every`-th sample of a channel, the first kept being number `every`."""
    return numbered(samples, channel, order).where(F.col("number") % every == 0).drop("number")


def triggered(samples: DataFrame, channel: str, order: list[str], value: str, on: float, off: float, least: int = 1, before: int = 0) -> DataFrame:
    """Runs of samples that a trigger with hysteresis passes: (channel, run, n, first, last) by sample number.

    A run begins at a value of `on` or more and lasts until one below `off`; shorter ones than `least`
    samples are noise. `before` samples ahead of a run come along, as far as there are any. Blocks of
    samples are gone through apart: each begins in the last state, and with the number of runs, before it.
    """
    state = F.when(F.col(value) >= on, 1).when(F.col(value) < off, 0)
    rows = numbered(samples, channel, order).select(F.col(channel).alias("c"), "number", F.floor((F.col("number") - 1) / BLOCK).alias("block"), state.alias("state"))
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    inside = Window.partitionBy("c", "block").orderBy("number")

    def with_block(rows: DataFrame, blocks: DataFrame, name: str, sofar: Column) -> DataFrame:
        blocks = blocks.select(F.col("c").alias("__c"), F.col("block").alias("__b"), F.coalesce(sofar, F.lit(0)).alias(name))
        return rows.join(blocks, F.col("c").eqNullSafe(F.col("__c")) & (F.col("block") == F.col("__b"))).drop("__c", "__b")

    ends = rows.groupBy("c", "block").agg(F.max_by("state", F.when(F.col("state").isNotNull(), F.col("number"))).alias("end"))
    rows = with_block(rows, ends, "entry", F.last("end", ignorenulls=True).over(earlier))
    rows = rows.withColumn("state", F.coalesce(F.last("state", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "entry"))
    rows = rows.withColumn("turn", (F.col("state") != F.coalesce(F.lag("state").over(inside), "entry")).cast("long"))
    rows = with_block(rows, rows.groupBy("c", "block").agg(F.sum("turn").alias("turns")), "turns", F.sum("turns").over(earlier))
    rows = rows.withColumn("run", F.col("turns") + F.sum("turn").over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("state = 1")
    runs = rows.groupBy("c", "run").agg(F.count("*").alias("n"), F.min("number").alias("first"), F.max("number").alias("last")).where(F.col("n") >= least)
    return runs.select(F.col("c").alias(channel), F.row_number().over(Window.partitionBy("c").orderBy("first")).alias("run"), "n", F.greatest(F.lit(1), F.col("first") - before).cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def corrected(samples: DataFrame, value: str, points: list[tuple[float, float]], scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Adds corrected: (value - offset) * scale through a piecewise-linear curve of (measured, true) points, its end pieces going on."""
    points = sorted(points)
    if len(points) < 2:
        raise ValueError("a curve needs two points or more")
    x = (F.col(value) - F.lit(offset)) * F.lit(scale)
    pieces = [F.lit(b0) + (x - F.lit(a0)) * F.lit((b1 - b0) / (a1 - a0)) for (a0, b0), (a1, b1) in zip(points, points[1:], strict=False)]
    out = pieces[-1]
    for (a1, _), piece in reversed(list(zip(points[1:-1], pieces, strict=False))):
        out = F.when(x < a1, piece).otherwise(out)
    return samples.withColumn("corrected", out)


def aligned(samples: DataFrame, channel: str, number: str, value: str, channels: list[str]) -> DataFrame:
    """(number, a column for each channel): the sample numbers that every channel has."""
    wide = samples.groupBy(number).pivot(channel, channels).agg(F.first(value))
    return wide.where(" AND ".join(f"`{c}` IS NOT NULL" for c in channels))


def energy_report(runs: DataFrame, power: DataFrame) -> DataFrame:
    """(config, latency, idle, proc, energy, in_count, out_count): run statistics with the mean power of each configuration."""
    means = power.groupBy("config").agg(F.avg("watts").alias("energy"))
    return runs.join(means, "config").select("config", "latency", "idle", "proc", "energy", "in_count", "out_count")
