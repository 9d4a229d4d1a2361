"""Small tables of vectors, with the awkward rows that both searches have to take."""

import math
import random

SCHEMA = "vec_id long, embedding array<float>, label int, id string, list int, score string, mark int"


def table(spark, rows):
    """Rows (vec_id, embedding, label) beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, label, "x", 1, None, 2) for i, v, label in rows], SCHEMA)


def noisy(seed, n, dim=6, values=5):
    """Vectors of few values, so that scores tie, with a group of equal ones and repeated ids."""
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-values, values + 1) / 64 for _ in range(dim)], rng.randrange(3)) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same, i % 2) for i in range(n // 3)]
    rows += [rows[0], rows[0], (0, same, 1), (None, rows[3][1], 1), (None, rows[3][1], 1), (4, None, 0), (10, [1.0, None], 0), (20, [math.nan] * dim, 1), (30, [math.inf] * dim, 1)]
    return [*rows, (5, rows[2][1][:2], None), (15, rows[2][1][:2], 2), (25, [], 0), (40, [3e30] * dim, 0)]


def whole(vector):
    """The integer vector, or None if it takes no part."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    import struct

    return [max(-(2**63), min(2**63 - 1, math.floor(256 * struct.unpack("f", struct.pack("f", x))[0]))) for x in vector]


def score(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))


def order(row):
    """Best first, ties by id, rows without one last: of (score, id)."""
    return (-row[0], row[1] is None, row[1] or 0)
