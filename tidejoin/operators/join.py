"""Windowed joins of two tables.

Every predicate becomes an equality, so Spark hashes or merges and never compares all pairs: the band
gets buckets as wide as itself, and one side looks into the neighbouring buckets too. A symmetric window
adds a bucket of time to the key: rows of one key are then dealt over as many tasks as they span
windows, so a key with a third of all rows is no hot spot unless they fall into one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidejoin.functions.predicates import BAND, join_key, nano_window, residual, time_window
from tidejoin.operators.places import placed
from tidejoin.plans.spec import JoinSpec, Predicate, Window
from tidejoin.sources.shared import staged

#: Rows of a key that make a block of a one-sided join.
BLOCK = 4_096


def _neighbours(bucket: Column) -> Column:
    return F.explode(F.array(bucket - 1, bucket, bucket + 1))


def keyed(r: DataFrame, s: DataFrame, spec: JoinSpec) -> tuple[DataFrame, DataFrame]:
    """R and S with a column key each; S has a row for each neighbouring bucket of a band. NULL keys are dropped."""
    left = r.withColumn("r_key", join_key(spec.predicate, "x", "y")).where("r_key IS NOT NULL")
    right = s.withColumn("s_key", join_key(spec.predicate, "a", "b")).where("s_key IS NOT NULL")
    if spec.predicate is Predicate.BAND:
        right = right.withColumn("s_key", _neighbours(F.col("s_key")))
    return left, right


def _all(*conditions: Column | None) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out if c is None else out & c
    return out


def _near_cells(cell: Column) -> Column:
    """The cells beside a cell; none beyond the ends of long."""
    return F.explode(F.array_compact(F.array(F.try_subtract(cell, F.lit(1).cast("long")), cell, F.try_add(cell, F.lit(1).cast("long")))))


def _blocked(left: DataFrame, right: DataFrame, spec: JoinSpec) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with a row for each pair of blocks that may match, and the condition that they are in the same pair."""
    sides = {}
    for side, rows in (("r", left), ("s", right)):
        rows = rows.where(f"{side}_t IS NOT NULL")
        rows = placed(rows, [f"{side}_key"], [F.col(f"{side}_t").asc()], f"{side}_place").withColumn(f"{side}_block", F.floor(F.col(f"{side}_place") / BLOCK)).drop(f"{side}_place")
        sides[side] = rows, rows.groupBy(f"{side}_key", f"{side}_block").agg(F.min(f"{side}_t").alias(f"{side}_from"), F.max(f"{side}_t").alias(f"{side}_to"))
    (left, r_blocks), (right, s_blocks) = sides["r"], sides["s"]
    reach = F.col("r_to") + F.lit(spec.w_r * 1_000_000_000)
    early = F.col("s_from") < reach if spec.strict else F.col("s_from") <= reach
    pairs = staged(r_blocks.join(s_blocks, (F.col("r_key") == F.col("s_key")) & early).select("r_key", "r_block", "s_block"), "block-pairs")
    left = left.join(pairs.select(F.col("r_key").alias("k"), F.col("r_block").alias("i"), F.col("s_block").alias("r_meets")), (F.col("r_key") == F.col("k")) & (F.col("r_block") == F.col("i"))).drop("k", "i")
    right = right.join(pairs.select(F.col("r_key").alias("k"), F.col("s_block").alias("j"), F.col("r_block").alias("s_meets")), (F.col("s_key") == F.col("k")) & (F.col("s_block") == F.col("j"))).drop("k", "j")
    return left, right, (F.col("r_block") == F.col("s_meets")) & (F.col("s_block") == F.col("r_meets"))


def join_pairs(r: DataFrame, s: DataFrame, spec: JoinSpec) -> DataFrame:
    """All columns of the pairs that match, each pair once; batch."""
    left, right = keyed(r, s, spec)
    same = F.col("r_key") == F.col("s_key")
    if spec.predicate is Predicate.BAND and spec.window is not Window.SYMMETRIC:
        left = left.withColumn("r_cell", F.floor(F.col("y") / BAND).cast("long"))
        right = right.withColumn("s_cell", _near_cells(F.floor(F.col("b") / BAND).cast("long")))
        same = same & (F.col("r_cell") == F.col("s_cell"))
    if spec.window is Window.SYMMETRIC:
        width = max(spec.w_r, spec.w_s) * 1_000_000_000
        left = left.withColumn("r_slot", F.floor(F.col("r_t") / width))
        right = right.withColumn("s_slot", _neighbours(F.floor(F.col("s_t") / width)))
        same = same & (F.col("r_slot") == F.col("s_slot"))
    elif spec.window is Window.ONE_SIDED:
        left, right, meets = _blocked(left, right, spec)
        same = same & meets
    out = left.join(right, _all(same, nano_window(spec), residual(spec.predicate)))
    return out.drop(*(f"{side}_{c}" for side in "rs" for c in ("key", "slot", "cell", "block", "meets")))


def window_join(r: DataFrame, s: DataFrame, spec: JoinSpec) -> DataFrame:
    """(r, s): row numbers of the pairs that match."""
    return join_pairs(r, s, spec).select("r", "s")


def stream_condition(spec: JoinSpec) -> Column:
    """The condition of a streaming join over keyed streams."""
    return _all(F.col("r_key") == F.col("s_key"), time_window(spec), residual(spec.predicate))
