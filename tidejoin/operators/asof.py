"""As-of joins: for each row the nearest row of a table at or below it, and the nearest above, group by group.

Both tables are sorted together by range, so rows of one group lie in as many partitions as they need, and
neither side has to fit anywhere; what a partition does not hold comes from a table of each partition's
first and last entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidejoin.sources.shared import staged


def around(rows: DataFrame, table: DataFrame, by: list[str], at: str, of: str, below: str = "below", above: str | None = None, parts: int | None = None) -> DataFrame:
    """rows with `below`, a struct of the table's row with the greatest `of` that is not above `at`; and, if named, `above`, of the least that is above.

    Columns `by` have to be equal (nulls are equal, too). Where the table has several rows with one `of`, the greatest in the order
    of its columns counts; its rows without an `of` do not. NULL where there is none, or no `at`.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = [c for c in table.columns if c not in by]
    group = {f"__by{i}": c for i, c in enumerate(by)}
    known = table.where(F.col(of).isNotNull()).groupBy(*(F.col(c).alias(g) for g, c in group.items()), F.col(of).alias("__x")).agg(F.max(F.struct(*entries)).alias("__entry"))
    rest = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("__row")
    asked = rows.select(*(F.col(c).alias(g) for g, c in group.items()), F.col(at).alias("__x"), rest)
    both = known.withColumn("__row", F.lit(None).cast(asked.schema["__row"].dataType)).unionByName(asked.withColumn("__entry", F.lit(None).cast(known.schema["__entry"].dataType)))
    both = both.withColumn("__last", F.col("__row").isNotNull())  # an entry comes before the rows that it is equal to
    keys = [*(F.col(g).asc_nulls_first() for g in group), F.col("__x").asc_nulls_first(), F.col("__last").asc()]
    dealt = staged(both.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), "asof")

    ends = dealt.where("__entry IS NOT NULL").groupBy(*group, "__part").agg(F.max_by("__entry", "__x").alias("__to"), F.min_by("__entry", "__x").alias("__from"))
    ends = dealt.select(*group, "__part").distinct().join(ends.withColumnsRenamed({**{g: f"{g}_" for g in group}, "__part": "__part_"}), _same([*group, "__part"]), "left")
    by_part = lambda order: Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  a row a partition
    come = {"__come": F.last("__to", ignorenulls=True).over(by_part(F.col("__part").asc()))}
    if above:
        come["__next"] = F.last("__from", ignorenulls=True).over(by_part(F.col("__part").desc()))
    ends = ends.select(*(F.col(c).alias(f"{c}_") for c in [*group, "__part"]), *(c.alias(n) for n, c in come.items()))

    met = dealt.join(ends, _same([*group, "__part"]), "left")
    inside = lambda *order: Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("__x")
    found = {below: F.coalesce(F.last("__entry", ignorenulls=True).over(inside(x.asc_nulls_first(), F.col("__last").asc())), F.col("__come"))}
    if above:
        found[above] = F.coalesce(F.last("__entry", ignorenulls=True).over(inside(x.desc_nulls_last(), F.col("__last").desc())), F.col("__next"))
    found = {n: F.when(x.isNotNull(), c) for n, c in found.items()}
    return met.withColumns(found).where("__row IS NOT NULL").select("__row.*", *found)


def _same(columns: list[str]):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return out


def corrected_by_curve(samples: DataFrame, points: DataFrame, channel: str, value: str) -> DataFrame:
    """samples with corrected: value through its channel's curve, a table (channel, measured, true) of any length.

    Between two points the curve is a line, and its end pieces go on. A single point shifts the value; a channel without
    points leaves it as it is. Of points with the same measured value, that with the greatest true one counts.
    """
    points = points.where("measured IS NOT NULL AND true IS NOT NULL").groupBy(channel, "measured").agg(F.max("true").alias("true"))
    along = Window.partitionBy(channel).orderBy("measured")  # a channel's calibration
    rise = lambda step: (step("true").over(along) - F.col("true")) / (step("measured").over(along) - F.col("measured"))
    pieces = points.select(channel, "measured", "true", F.coalesce(rise(F.lead), rise(F.lag), F.lit(1.0)).alias("slope"))
    met = around(samples, pieces, [channel], value, "measured", "__below", "__above")
    point = F.coalesce("__below", "__above")
    line = point["true"] + (F.col(value) - point["measured"]) * point["slope"]
    return met.withColumn("corrected", F.when(point.isNull(), F.col(value)).otherwise(line)).drop("__below", "__above")


def zeroed(samples: DataFrame, zeros: DataFrame, channel: str, ts: str, value: str) -> DataFrame:
    """samples with zeroed: value less the latest zero of its channel, a table (channel, ts, zero) of measurements without a load; none counts as 0."""
    met = around(samples, zeros.select(channel, F.col(ts).alias("__at"), "zero"), [channel], ts, "__at", "__zero")
    return met.withColumn("zeroed", F.col(value) - F.coalesce(F.col("__zero")["zero"], F.lit(0.0))).drop("__zero")
