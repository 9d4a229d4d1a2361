"""Exact top-k search by inner product, with a table of distances to pivots.

For each row the table has its distances to PIVOTS pivots, vectors far from one another. The triangle
inequality makes |d(q, p) - d(x, p)| a lower bound of d(q, x) for every pivot p, and the greatest of them,
with both lengths, an upper bound of the inner product: <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2. A list
holds the rows nearest to one pivot, and a range of distances to every pivot bounds all of its rows at
once. A query goes to the lists with the highest bounds first; the kth score there decides which others
it still has to visit. In a block, candidates are evaluated in order of their bounds until a bound is
strictly below the kth score found, so that ties are evaluated, too. Bounds carry a margin above the
rounding errors of doubles; scores are exact integers.

Plan: one shuffle makes classes of repeated rows; the table is written once; what comes to the driver are
the pivots' sample (SAMPLE rows) and a row of ranges for each list (as many as pivots). Every row is in
the index, and every query meets all lists that its bounds do not rule out, block by block.

Defined results: vectors that are null or hold a component that is null or not finite take no part; each
of several equal rows is a query and a candidate of its own, and meets the others; rows without an id are
no queries, but candidates, behind those with ids in a tie; shorter vectors count as filled up with
zeros; components and scores end at the range of long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidejoin.llm import vectors as V
from tidejoin.llm.staging import staged

#: Pivots, and rows of the sample that they are chosen from.
PIVOTS, SAMPLE = 32, 4_096
#: Lists that a query visits before the others are judged by its kth score.
FIRST = 2
#: Candidates evaluated together, and the margin of a bound, as a share of the squared lengths in it.
BATCH, MARGIN = 512, 1e-9


def choose_pivots(rows: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Rows far from one another: each next one has the greatest distance to those chosen before."""
    rows = rows.astype(float)
    if not len(rows):
        return rows
    least = np.full(len(rows), np.inf)
    chosen: list[int] = [int((rows * rows).sum(1).argmax())]
    while len(chosen) < most:
        least = np.minimum(least, ((rows - rows[chosen[-1]]) ** 2).sum(1))
        if least.max() == 0:
            break
        chosen.append(int(least.argmax()))
    return rows[chosen]


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with list (the nearest pivot), square (the squared length) and distances (to every pivot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = V.matrix(batch["vec"], pivots.shape[1]).astype(float)
            points = np.pad(pivots, ((0, 0), (0, vec.shape[1] - pivots.shape[1])))
            far, near = V.nearest(vec, points)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * len(points)), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array((vec * vec).sum(1)), flat], names)

    names = [*rows.columns, "list", "square", "distances"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", list int, square double, distances array<double>"
    return rows.mapInArrow(run, schema)


def ranges(table: DataFrame, n: int) -> dict[str, np.ndarray]:
    """For each list: its rows, its longest squared length, and its least and greatest distance to every pivot."""
    ends = [f(F.col("distances")[j]).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(n)]
    found = sorted(table.groupBy("list").agg(F.count("*").alias("n"), F.max("square").alias("square"), *ends).collect())
    pick = lambda *names: np.array([[r[c] for c in names] for r in found])
    return {
        "list": np.array([r["list"] for r in found], np.int32), "n": np.array([r["n"] for r in found], np.int64), "square": np.array([r["square"] for r in found], float),
        "low": pick(*(f"min{j}" for j in range(n))), "high": pick(*(f"max{j}" for j in range(n))),
    }


def upper(far: np.ndarray, square: float, other: np.ndarray | float) -> np.ndarray:
    """Upper bounds of inner products, from lower bounds of distances and both squared lengths."""
    return np.maximum((square + other - far * far) / 2 + MARGIN * (square + other) + 1e-6, -V.LONG)  # scores end there


def to_visit(queries: DataFrame, lists: dict[str, np.ndarray], first: bool, most: int) -> DataFrame:
    """A row for each query and list that it visits: the first lists, by their bounds; or, of all others, those that kth does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, square = V.matrix(batch["distances"], kind=float), np.asarray(batch["square"])
            kth = np.array([-np.inf if x is None else x for x in batch["kth"].to_pylist()], float)
            rows, chosen = [], []
            for i in range(len(far)):
                outside = np.maximum(lists["low"] - far[i], far[i] - lists["high"]).max(1, initial=0)
                bounds = upper(outside, square[i], lists["square"])
                order = np.lexsort((lists["list"], -bounds))
                begin = max(FIRST, int(np.searchsorted(np.cumsum(lists["n"][order]), most + 1)) + 1)
                order = order[:begin] if first else order[begin:][bounds[order[begin:]] >= kth[i]]
                rows.append(np.full(len(order), i))
                chosen.append(lists["list"][order])
            out = batch.take(pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(chosen) if chosen else np.zeros(0, np.int32))], [*batch.schema.names, "list"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema) + ", list int"
    return queries.mapInArrow(run, schema)


def search_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of a block for each query, by bounds: (query_id, query_mark, vec_id, score, copies)."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "query_mark": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "copies": pa.array([], pa.int64())})
    if not len(queries) or not len(rows):
        return empty
    asked, vec = V.matrix(queries["vec"]), V.matrix(rows["vec"])
    width = max(asked.shape[1], vec.shape[1])
    asked, vec = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (asked, vec))
    ids, none = np.asarray(rows["id"].fill_null(0)), np.asarray(rows["id"].is_null())
    copies, square = np.asarray(rows["copies"]), np.asarray(rows["square"])
    far = np.ascontiguousarray(V.matrix(rows["distances"], kind=float).T)
    query_ids, marks, lengths = (np.asarray(queries[c]) for c in ("query_id", "mark", "square"))
    query_far, kth = V.matrix(queries["distances"], kind=float), queries["kth"].to_pylist()
    out: list[tuple] = []
    for i in range(len(asked)):
        bound = np.zeros(len(vec))
        for j in range(len(far)):
            np.maximum(bound, np.abs(far[j] - query_far[i, j]), out=bound)
        bound = upper(bound, lengths[i], square)
        floor = -np.inf if kth[i] is None else kth[i]
        order = np.flatnonzero(bound >= floor)
        order = order[np.argsort(-bound[order], kind="stable")]
        at, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for begin in range(0, len(order), BATCH):
            if bound[order[begin]] < floor:
                break  # nothing that follows can reach the kth score
            some = order[begin : begin + BATCH]
            at, score = np.concatenate([at, some]), np.concatenate([score, V.products(vec[some], asked[i])])
            own = (ids[at] == query_ids[i]) & ~none[at] & (copies[at] == 1)
            own[own] = (vec[at[own]] == asked[i]).all(1)
            at, score = at[~own], score[~own]
            first = np.lexsort((ids[at], none[at], -score))[:k]
            at, score = at[first], score[first]
            if len(at) == k:
                floor = max(floor, score[-1])
        same = (ids[at] == query_ids[i]) & ~none[at]
        same[same] = (vec[at[same]] == asked[i]).all(1)
        out.append((np.full(len(at), query_ids[i]), np.full(len(at), marks[i]), at, score, copies[at] - same))
    at = np.concatenate([o[2] for o in out])
    columns = {"query_id": np.concatenate([o[0] for o in out]), "query_mark": np.concatenate([o[1] for o in out])}
    columns |= {"vec_id": pa.array(ids[at], mask=none[at]), "score": np.concatenate([o[3] for o in out]), "copies": np.concatenate([o[4] for o in out])}
    return pa.table(columns).cast(empty.schema)


def top_k(rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row with an id for which `queries` (over the column id) holds."""
    if k < 1:
        raise ValueError("k of 1 or more")
    some = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(V.usable(F.col("vec")))
    known = staged(V.classes(some.select("id", V.integers(F.col("vec")).alias("vec")), ["id"]), "vector-classes")
    pivots = choose_pivots(V.sample(known, SAMPLE))
    table = staged(pivot_table(known, pivots), "pivot-table") if len(pivots) else pivot_table(known, np.zeros((1, 0)))
    lists = ranges(table, max(1, len(pivots)))
    blocks = {int(c): int(-(-n // V.BLOCK)) for c, n in zip(lists["list"], lists["n"], strict=True)}
    asked = table.where(F.col("id").isNotNull() & queries).select(F.col("id").alias("query_id"), "mark", "vec", F.col("copies").alias("asked"), "square", "distances", F.lit(None).cast("long").alias("kth"))
    chunks = 1 + asked.count() // V.CHUNK
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    query = ["query_id", "query_mark"]

    def found(asked: DataFrame, first: bool) -> DataFrame:
        schema = "query_id long, query_mark long, vec_id long, score long, copies long"
        visits = to_visit(asked, lists, first, k)
        return V.meet(visits, table, blocks, chunks, lambda a, b: search_block(a, b, k), schema)

    near = staged(found(asked, True), "pivot-first")
    kth = V.best(near, query, order, k).where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("query_mark").alias("m"), F.col("score").alias("kth"))
    again = asked.drop("kth").join(kth, (F.col("query_id") == F.col("q")) & (F.col("mark") == F.col("m")), "left").drop("q", "m")
    every = V.best(near.union(found(again, False)), query, order, k)
    times = asked.select(F.col("query_id").alias("q"), F.col("mark").alias("m"), F.explode(F.sequence(F.lit(1).cast("long"), "asked")).alias("nth"))
    return every.join(times, (F.col("query_id") == F.col("q")) & (F.col("query_mark") == F.col("m"))).select("query_id", "rank", "vec_id", "score")


#: DuckDB's form of the query over embeddings.
SQL = r"""
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT a.i, a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.i <> b.i),
 r AS (SELECT query_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
