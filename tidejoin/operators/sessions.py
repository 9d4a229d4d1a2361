"""Capture sessions of a trigger over power samples: filter time, pre-trigger, hold-off and end filter.

A trigger fires at a sample when more than `filter` samples in a row, it included, are at `on` or above. The
session ends at a sample with which `end_filter` samples in a row are below `off`; the sample itself is
no part of it, the ones below before it are. Silence ends a session, too: a sample more than `silence`
seconds after the one before begins anew, with no count of samples above or below. Captured are up to `before` samples ahead of
the trigger, back to the sample that ended the last session or the silence before, and what follows the
first `hold` samples from the trigger on.

Both forms take (channel, ts, number, value), numbers without gaps in the order of time, and give a row for
each session that has ended: (channel, trigger, first, last, n, total), by sample number; n and total
(the sum of values) are of captured samples, first is the trigger less what comes ahead, last the last
sample before the end. A session that is still open at the end has no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a channel that one task goes through together.
BLOCK = 100_000
SCHEMA = "channel string, trigger long, first long, last long, n long, total double"


@dataclass(frozen=True)
class Trigger:
    """Thresholds, and lengths in samples; silence in seconds."""

    on: float
    off: float
    filter: int = 0
    hold: int = 0
    end_filter: int = 1
    before: int = 0
    silence: int = 3600

    def __post_init__(self) -> None:
        if not self.off <= self.on:
            raise ValueError("a trigger has to end at or below where it begins")
        if min(self.filter, self.hold, self.before) < 0 or self.end_filter < 1 or self.silence < 1:
            raise ValueError("lengths cannot be negative; an end filter of 1 sample or more, a silence of 1 second or more")


def _blocks(rows: DataFrame, values: dict[str, Column], exact: bool = False) -> DataFrame:
    """rows with, for each name, the last value that is not null of the channel up to this row (exact: of the row before alone).

    Blocks are gone through apart: what stands before a block comes from a table of a row a block.
    """
    inside = Window.partitionBy("channel", "block").orderBy("number")
    rows = rows.withColumns({f"__{n}": v for n, v in values.items()})
    ends = rows.groupBy("channel", "block").agg(*(F.max_by(f"__{n}", F.when(F.lit(exact) | F.col(f"__{n}").isNotNull(), F.col("number"))).alias(f"__end_{n}") for n in values))
    earlier = Window.partitionBy("channel").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    come = {n: F.lag(f"__end_{n}").over(Window.partitionBy("channel").orderBy("block")) if exact else F.last(f"__end_{n}", ignorenulls=True).over(earlier) for n in values}
    ends = ends.select(F.col("channel").alias("__c"), F.col("block").alias("__b"), *(c.alias(f"__entry_{n}") for n, c in come.items()))
    rows = rows.join(ends, F.col("channel").eqNullSafe(F.col("__c")) & (F.col("block") == F.col("__b")))
    if exact:
        own = {n: F.when(F.row_number().over(inside) == 1, F.col(f"__entry_{n}")).otherwise(F.lag(f"__{n}").over(inside)) for n in values}
    else:
        own = {n: F.coalesce(F.last(f"__{n}", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"__entry_{n}")) for n in values}
    return rows.withColumns(own).drop("__c", "__b", *(f"{p}{n}" for n in values for p in ("__", "__entry_")))


def sessions(samples: DataFrame, trigger: Trigger, until: Column | None = None) -> DataFrame:
    """Sessions of a table, in blocks of samples.

    until: a timestamp up to which silence is known of (a stream's watermark); without it the last session of a
    channel counts as ended by silence.
    """
    rows = samples.select("channel", "number", "ts", "value", F.floor(F.col("number") / BLOCK).alias("block"))
    value, number = F.col("value"), F.col("number")
    rows = _blocks(rows, {"previous": F.col("ts")}, exact=True)
    fresh = F.col("previous").isNull() | (F.unix_micros("ts") - F.unix_micros("previous") > trigger.silence * 1_000_000)
    rows = rows.withColumn("fresh", fresh)
    # where counts of samples in a row begin: after the last sample that is not above (below), or at the last silence
    floor = lambda broken: F.when(broken, number).when(F.col("fresh"), number - 1)
    rows = _blocks(rows, {"not_on": floor(value.isNull() | (value < trigger.on)), "not_off": floor(value.isNull() | (value >= trigger.off))})
    fires, ends = number - F.col("not_on") > trigger.filter, number - F.col("not_off") >= trigger.end_filter
    # a silence ends what runs, before its own sample may fire
    rows = rows.withColumns({"fires": fires & (value >= trigger.on), "ends": ends & (value < trigger.off)})
    rows = _blocks(rows, {"state": F.when(F.col("fires"), 1).when(F.col("ends") | F.col("fresh"), 0)})
    rows = _blocks(rows.withColumn("on", F.coalesce("state", F.lit(0))), {"was": F.col("on")}, exact=True)
    was = F.when(F.col("fresh"), 0).otherwise(F.coalesce("was", F.lit(0)))
    rows = _blocks(rows, {"trigger": F.when((F.col("on") == 1) & (was == 0), number), "closed": F.when((F.col("on") == 0) & ((was == 1) | F.col("fresh")), number), "begun": F.when(F.col("fresh"), number)})
    inner = rows.where("on = 1")
    place = number - F.col("trigger")
    captured = place >= trigger.hold
    parts = inner.groupBy("channel", "trigger").agg(
        F.max("number").alias("last"), F.max("ts").alias("last_ts"), F.count_if(captured).alias("n"), F.sum(F.when(captured, value)).alias("total"),
        F.first("closed").alias("closed"), F.first("begun").alias("begun"),
    )
    # ahead of the trigger: not before the sample that ended the last session, nor the last silence
    start = F.greatest(F.col("trigger") - trigger.before, F.coalesce("closed", F.lit(0)), F.coalesce("begun", F.lit(0)))
    parts = parts.withColumn("first", F.least(start, F.col("trigger")))
    ahead = parts.where("first < trigger").select("channel", "trigger", F.explode(F.sequence("first", F.col("trigger") - 1)).alias("number"))  # `before` rows a session
    ahead = ahead.join(samples.select(F.col("channel").alias("__c"), F.col("number").alias("__n"), "value"), F.col("channel").eqNullSafe(F.col("__c")) & (F.col("number") == F.col("__n")))
    ahead = ahead.groupBy(F.col("channel").alias("__c"), F.col("trigger").alias("__t")).agg(F.count("*").alias("__n"), F.sum("value").alias("__sum"))
    out = parts.join(ahead, F.col("channel").eqNullSafe(F.col("__c")) & (F.col("trigger") == F.col("__t")), "left")
    ended = samples.groupBy(F.col("channel").alias("__of")).agg(F.max("number").alias("__last"))
    out = out.join(ended, F.col("channel").eqNullSafe(F.col("__of")))
    if until is not None:
        out = out.where((F.col("last") < F.col("__last")) | (F.col("last_ts") + F.expr(f"INTERVAL {trigger.silence} SECONDS") < until))
    total = F.coalesce("total", F.lit(0.0)) + F.coalesce("__sum", F.lit(0.0))
    return out.select("channel", "trigger", "first", "last", (F.col("n") + F.coalesce("__n", F.lit(0))).alias("n"), total.alias("total"))
