"""The join predicates and windows as columns over R(r_t, r_ts, x, y) and S(s_t, s_ts, a, b)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidejoin.plans.spec import JoinSpec, Predicate, Window

#: Half width of the band, on both columns; exactly so far apart is outside.
BAND = 10


def join_key(predicate: Predicate, first: str, second: str) -> Column:
    """What has to be equal on both sides; NULL where a row cannot match. For the band, its bucket of the first column."""
    i, f = F.col(first), F.col(second)
    single = i.cast("float") + f.cast("float")  # both sides in single precision: distinct sums may round to equal ones
    if predicate is Predicate.KEY:
        return i
    if predicate is Predicate.SUM_F32:
        return single
    if predicate is Predicate.SUM_TRUNC:
        return single.try_cast("int")
    if predicate is Predicate.SUM_INT:
        total = F.pmod(i.try_cast("bigint") + f.try_cast("bigint"), F.lit(2**32))
        return F.when(total != 0, total)
    return F.floor(i / BAND).cast("long")


def residual(predicate: Predicate) -> Column | None:
    """What else has to hold of a pair with equal keys."""
    if predicate is Predicate.BAND:
        return (F.abs(F.col("a") - F.col("x")) < BAND) & (F.abs(F.col("b") - F.col("y")) < BAND)
    return None


def nano_window(spec: JoinSpec) -> Column | None:
    """The window on nanoseconds, for batch joins."""
    return _window(spec, F.col("r_t"), F.col("s_t"), lambda s: F.lit(s * 1_000_000_000))


def time_window(spec: JoinSpec) -> Column | None:
    """The window on event times: only this form lets a streaming join forget rows."""
    return _window(spec, F.col("r_ts"), F.col("s_ts"), lambda s: F.expr(f"INTERVAL {s} SECONDS"))


def _window(spec: JoinSpec, r: Column, s: Column, length) -> Column | None:
    if spec.window is Window.NONE:
        return None
    before = (lambda a, b: a < b) if spec.strict else (lambda a, b: a <= b)
    forward = before(s, r + length(spec.w_r))
    return forward if spec.window is Window.ONE_SIDED else forward & before(r, s + length(spec.w_s))
