"""Integer vectors, their classes and lists, and exact scores between them: what both vector searches share.

A row's vector is floor(256 * x) of each component, x as double; scores are integer inner products. Rows
of equal id, label and vector are one class with a number of copies, so that no group of copies is
compared with itself. Lists of rows are dealt out in blocks, queries in chunks, and each block meets the
chunks that want its list: a group holds a bounded number of rows, however many rows one list has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidejoin.llm.staging import few

SCALE = 256
#: Rows of a block of a list, and queries of a chunk.
BLOCK, CHUNK = 8_192, 2_048
#: Scores up to this are exact as doubles.
EXACT = 2**53
LONG = 2**63


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor with a component that is null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector.cast("array<double>"), bad), F.lit(False))


def integers(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(float(SCALE)) * x))


def classes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vec, copies, mark) of rows (keys, vec): mark tells classes of one id apart."""
    out = rows.groupBy(*keys, "vec").agg(F.count("*").alias("copies"))
    return out.withColumn("mark", F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys), "vec"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None, kind: type = np.int64) -> np.ndarray:
    """A row for each list; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(np.asarray(column.offsets))
    width = max(width or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(column), width), kind)
    out[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten())
    return out


def products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with one vector or the columns of a matrix; beyond the range of long, its end."""
    most = max(1, rows.shape[-1]) * float(np.abs(rows.astype(float)).max(initial=0)) * float(np.abs(vector.astype(float)).max(initial=0))
    if most < EXACT:
        return (rows.astype(float) @ vector.astype(float)).astype(np.int64)
    return np.clip(rows.astype(object) @ vector.astype(object), -LONG, LONG - 1).astype(np.int64)


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """The vectors of `most` rows, those with the least marks: bounded, and the same for every partitioning."""
    found = rows.select("mark", "vec").orderBy("mark", "vec").limit(most).toArrow()
    return matrix(found["vec"])


def nearest(rows: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distances of rows to all points, and the number of the nearest one."""
    squares = np.maximum(0, (rows * rows).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * (rows @ points.T))
    out = np.sqrt(squares)
    return out, out.argmin(1) if len(points) else np.zeros(len(rows), np.int64)


def meet(visits: DataFrame, rows: DataFrame, blocks: dict[int, int], chunks: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(queries, rows) for each chunk of queries that wants a list, and each block of it.

    visits: a row for each query and list, with list and mark; rows: with list and mark; blocks: the
    number of blocks that a list is dealt over (BLOCK rows each, about).
    """
    spread = F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair)) if blocks else F.create_map(F.lit(-1), F.lit(1))
    parts = F.coalesce(F.try_element_at(spread, F.col("list")), F.lit(1))
    asked = visits.withColumn("chunk", F.pmod(F.xxhash64("mark", F.lit(1)), F.lit(chunks)).cast("int"))
    wanted = few(asked.select(F.col("list").alias("of"), F.col("chunk").alias("for")).distinct(), 100_000)
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("mark", F.lit(2)), parts).cast("int")).join(wanted, F.col("list") == F.col("of"))
    groups = asked.groupBy("list", "block", "chunk").cogroup(dealt.withColumnRenamed("block", "part").groupBy("of", "part", "for"))
    return groups.applyInArrow(lambda a, b: run(a, b), schema)


def best(found: DataFrame, query: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each query, copies counted one by one; found: a row for each class, with copies."""
    place = Window.partitionBy(*query).orderBy(*order)
    top = found.withColumn(out, F.row_number().over(place)).where(F.col(out) <= k)  # k classes have k rows
    top = top.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies"), F.lit(k)))))
    return top.withColumn(out, F.row_number().over(place)).where(F.col(out) <= k).drop("__copy", "copies")
