"""Experiments: one run for each setting, and the highest rate that a join keeps up with."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def sweep(settings: Iterable[dict], run: Callable[..., DataFrame]) -> list[dict]:
    """Each setting with the seconds that its result took and its number of rows."""
    out = []
    for setting in settings:
        began = time.perf_counter()
        rows = run(**setting).count()
        out.append(setting | {"rows": rows, "seconds": time.perf_counter() - began})
    return out


def highest_rate(keeps_up: Callable[[int], bool], low: int, high: int, tolerance: float = 0.005) -> int:
    """The highest rate that keeps up, by halving the range until its half width is within tolerance of its middle.

    0 if even `low` is too much.
    """
    if not keeps_up(low):
        return 0
    if keeps_up(high):
        return high
    while high - low > 1 and (high - low) / (high + low) >= tolerance:
        middle = (low + high) // 2
        low, high = (middle, high) if keeps_up(middle) else (low, middle)
    return low


def next_range(rate: float, cores_before: int, cores: int) -> tuple[int, int]:
    """Where to look for the highest rate with other cores: pairs grow as the square of the rate."""
    middle = rate * math.sqrt(cores / cores_before)
    return max(1, int(middle / math.sqrt(2))), max(2, math.ceil(middle * math.sqrt(2)))


def processed_prefix(n: int, batch: int) -> tuple[int, int]:
    """Rows of R and S that a loop with equal rates, releasing batch - 1 rows a turn, gets through before its input ends.

    Our joins process every row; this only explains smaller counts of such a loop.
    """
    if batch < 2:
        raise ValueError("such a loop never ends with batches below 2 rows")
    turns = max(0, -(-(n - batch) // (batch - 1)))
    of = lambda k: batch * (max(0, k) * (batch - 1) // batch)
    return of(turns - 1), of(turns)
