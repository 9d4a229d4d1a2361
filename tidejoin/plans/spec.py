"""What a windowed join computes."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Predicate(Enum):
    """KEY: x = a. SUM_F32: x + y = a + b in single precision. SUM_TRUNC: the same sums, truncated.
    SUM_INT: each part truncated, then added modulo 2**32; a sum of 0 never matches.
    BAND: x and a, and y and b, less than 10 apart."""

    KEY = "key"
    SUM_F32 = "sum_f32"
    SUM_TRUNC = "sum_trunc"
    SUM_INT = "sum_int"
    BAND = "band"


class Window(Enum):
    """SYMMETRIC: each row joins later rows of the other stream for its stream's window. ONE_SIDED: only
    R's window bounds S, as when all of R comes before all of S. NONE: time plays no part."""

    SYMMETRIC = "symmetric"
    ONE_SIDED = "one_sided"
    NONE = "none"


@dataclass(frozen=True)
class JoinSpec:
    """w_r, w_s: seconds for which a row of R or S stays joinable; strict: whether exactly that long is too long."""

    predicate: Predicate = Predicate.KEY
    w_r: int = 600
    w_s: int = 600
    strict: bool = True
    window: Window = Window.SYMMETRIC

    def __post_init__(self) -> None:
        if self.w_r <= 0 or self.w_s <= 0:
            raise ValueError("windows have to be longer than 0 seconds")
