"""Running least, mean and greatest values of channels, sample by sample.

A channel is gone through in blocks: what stands before a block comes from a row of partial results for
each block, so that no task holds more than a block, however many samples one channel has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a channel that one task goes through together.
BLOCK = 100_000


def running_ranges(samples: DataFrame, channel: str, number: str, values: dict[str, Column]) -> DataFrame:
    """samples with low_x, mean_x and high_x for each value x: over the channel's samples up to this one.

    number: of the sample in its channel, without gaps. Nulls do not count; results are NULL until there is a value.
    """
    names = {n: f"__v_{n}" for n in values}
    rows = samples.withColumns({names[n]: v.cast("double") for n, v in values.items()}).withColumn("__block", F.floor(F.col(number) / BLOCK))
    kinds = {"low": F.min, "high": F.max, "sum": F.sum, "n": F.count}
    partial = rows.groupBy(F.col(channel).alias("__c"), F.col("__block").alias("__b")).agg(*(f(c).alias(f"__{k}_{n}") for n, c in names.items() for k, f in kinds.items()))
    before = Window.partitionBy("__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    total = {"low": F.min, "high": F.max, "sum": F.sum, "n": F.sum}
    entry = partial.select("__c", "__b", *(f(f"__{k}_{n}").over(before).alias(f"__{k}_{n}") for n in names for k, f in total.items()))
    met = rows.join(entry, F.col(channel).eqNullSafe(F.col("__c")) & (F.col("__block") == F.col("__b")))
    inside = Window.partitionBy(channel, "__block").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for n, c in names.items():
        own = {k: f(c).over(inside) for k, f in kinds.items()}
        count = F.coalesce(f"__n_{n}", F.lit(0)) + own["n"]
        out[f"low_{n}"] = F.least(f"__low_{n}", own["low"])  # both skip nulls
        out[f"high_{n}"] = F.greatest(f"__high_{n}", own["high"])
        out[f"mean_{n}"] = F.try_divide(F.coalesce(f"__sum_{n}", F.lit(0.0)) + F.coalesce(own["sum"], F.lit(0.0)), count.cast("double"))
    return met.withColumns(out).select(*samples.columns, *(f"{k}_{n}" for n in names for k in ("low", "mean", "high")))


def running_power(samples: DataFrame, channel: str, number: str, volts: str, amperes: str) -> DataFrame:
    """Running ranges of volts, amperes and their product, watts, as v, a and w."""
    v, a = F.col(volts).cast("double"), F.col(amperes).cast("double")
    return running_ranges(samples, channel, number, {"v": v, "a": a, "w": v * a})
