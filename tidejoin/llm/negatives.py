"""Hard-negative mining over inverted lists of k-means, with the radius of each list.

An anchor's positives are its best rows of the same label; the negatives for a positive are the best rows
of other labels whose scores lie in a window, a share of the positive's score. Rows lie in the list of
their nearest centroid, stored with its radius, the greatest distance of a row in it. By Cauchy and
Schwarz, a row of the list scores between <a, c> - |a| r and <a, c> + |a| r with an anchor a: lists are
visited by the upper bound, those whose bounds lie outside every window are left out, and a search stops
when the bound falls strictly below the kth score found, so that ties are seen. Centroids are fitted on
a bounded sample; every row is in a list, and results are exact whatever the centroids are.

Plan: classes of repeated rows, one table of rows with lists, one row of bounds for each list on the driver
(LISTS at most). Both searches visit the first lists of each anchor, then, knowing its kth scores, what is
not ruled out of the others, as groups of a block of a list and a chunk of anchors.

Defined results: rows take no part without a label, or with a vector that is null or holds a component that
is null or not finite; each of several equal rows is an anchor, positive or negative of its own; rows
without an id are no anchors and come last in ties; shorter vectors count as filled up with zeros;
components and scores end at the range of long; a positive with a score below 0 has an empty window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidejoin.llm import vectors as V
from tidejoin.llm.staging import staged

#: Lists at most, rows of the sample for each of them, and rounds of fitting.
LISTS, SAMPLE, ROUNDS = 128, 64, 8
#: Lists that an anchor visits before its kth scores are known, and the margin of a bound, as a share of it.
FIRST, MARGIN = 4, 1e-9


def fit_centroids(rows: np.ndarray, most: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of k-means, beginning with rows far from one another."""
    from tidejoin.llm.pivots import choose_pivots

    rows = rows.astype(float)
    points = choose_pivots(rows, most)
    for _ in range(rounds if len(points) else 0):
        _, near = V.nearest(rows, points)
        sums = np.zeros_like(points)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=len(points))
        points = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], points)
    return points


def in_lists(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with list (of the nearest centroid), away (the distance to it) and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = V.matrix(batch["vec"], centroids.shape[1]).astype(float)
            points = np.pad(centroids, ((0, 0), (0, vec.shape[1] - centroids.shape[1])))
            _, near = V.nearest(vec, points)
            away = np.sqrt(((vec - points[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away), pa.array(np.sqrt((vec * vec).sum(1)))], names)

    names = [*rows.columns, "list", "away", "length"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", list int, away double, length double"
    return rows.mapInArrow(run, schema)


class Lists:
    """Centroids, radii and sizes of the lists in use."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray):
        found = sorted(rows.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect())
        self.number = np.array([r["list"] for r in found], np.int32)
        self.n, self.radius = np.array([r["n"] for r in found], np.int64), np.array([r["r"] for r in found], float)
        self.centroids = centroids[self.number] if len(found) else centroids

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score that a row of each list can have with the anchor."""
        width = max(len(anchor), self.centroids.shape[1])
        anchor, points = np.pad(anchor, (0, width - len(anchor))), np.pad(self.centroids, ((0, 0), (0, width - self.centroids.shape[1])))
        length = np.sqrt(anchor @ anchor)
        middle, reach = points @ anchor, length * self.radius
        slack = MARGIN * (length * np.sqrt((points * points).sum(1)) + reach) + 1e-6
        return np.minimum(middle - reach - slack, V.LONG), np.maximum(middle + reach + slack, -V.LONG)  # scores end there


def to_visit(anchors: DataFrame, lists: Lists, first: bool, k: int) -> DataFrame:
    """A row for each anchor and list to visit. anchors: with lows, highs (the windows) and floors (the kth score in each, or null).

    In bound order, the first lists are those of the first round; the others are visited for some window
    unless their bounds are outside it, or fall strictly below its kth score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chosen = [], []
            windows = zip(*(batch[c].to_pylist() for c in ("lows", "highs", "floors")), strict=True)
            for i, (vec, (low, high, floor)) in enumerate(zip(V.matrix(batch["vec"]).astype(float), windows, strict=True)):
                least, most = lists.bounds(vec)
                met = (most[:, None] >= np.array(low, float)) & (least[:, None] <= np.array(high, float))
                order = np.lexsort((lists.number, -most))
                order = order[met.any(1)[order]]
                begin = max(FIRST, int(np.searchsorted(np.cumsum(lists.n[order]), k + 1)) + 1)
                if first:
                    order = order[:begin]
                else:
                    met &= most[:, None] >= np.array([-np.inf if x is None else x for x in floor], float)
                    order = order[begin:]
                    order = order[met.any(1)[order]]
                rows.append(np.full(len(order), i))
                chosen.append(lists.number[order])
            out = batch.take(pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(chosen) if chosen else np.zeros(0, np.int32))], [*batch.schema.names, "list"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema) + ", list int"
    return anchors.mapInArrow(run, schema)


FOUND = pa.schema([("anchor_id", pa.int64()), ("anchor_mark", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("copies", pa.int64())])
FOUND_SCHEMA = ", ".join(f"{n} long" for n in FOUND.names)


def search_block(anchors: pa.Table, rows: pa.Table, k: int, same_label: bool) -> pa.Table:
    """The k best rows of a block in each window of each anchor, of its label or of the others."""
    if not len(anchors) or not len(rows):
        return FOUND.empty_table()
    asked, vec = V.matrix(anchors["vec"]), V.matrix(rows["vec"])
    width = max(asked.shape[1], vec.shape[1])
    asked, vec = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (asked, vec))
    ids, none, labels, copies = np.asarray(rows["id"].fill_null(0)), np.asarray(rows["id"].is_null()), np.asarray(rows["label"]), np.asarray(rows["copies"])
    anchor_ids, marks, anchor_labels = (np.asarray(anchors[c]) for c in ("anchor_id", "mark", "label"))
    windows = zip(*(anchors[c].to_pylist() for c in ("lows", "highs", "floors")), strict=True)
    parts: list[list[np.ndarray]] = []
    for i, (lows, highs, floors) in enumerate(windows):
        open_to = np.flatnonzero((labels == anchor_labels[i]) == same_label)
        score = V.products(vec[open_to], asked[i])
        n = copies[open_to].copy()
        if same_label:  # an anchor is not its own positive
            own = np.flatnonzero((ids[open_to] == anchor_ids[i]) & ~none[open_to])
            n[own[(vec[open_to[own]] == asked[i]).all(1)]] -= 1
        for low, high, floor in zip(lows, highs, floors, strict=True):
            at = np.flatnonzero((score >= (low if floor is None else max(low, floor))) & (score <= high) & (n > 0))
            if len(at) > k:  # without what is below the kth score
                at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
            at = at[np.lexsort((ids[open_to[at]], none[open_to[at]], -score[at]))[:k]]
            fixed = [np.full(len(at), x, np.int64) for x in (anchor_ids[i], marks[i], low, high)]
            parts.append([*fixed, open_to[at], score[at], n[at]])
    if not parts:
        return FOUND.empty_table()
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    columns[4] = pa.array(ids[columns[4]], mask=none[columns[4]])
    return pa.table(dict(zip(FOUND.names, columns, strict=True)), schema=FOUND)


def search(anchors: DataFrame, rows: DataFrame, lists: Lists, k: int, same_label: bool) -> DataFrame:
    """(anchor_id, anchor_mark, low, high, id, score, rank): the first k rows in each window of each anchor."""
    blocks = {int(c): int(-(-n // V.BLOCK)) for c, n in zip(lists.number, lists.n, strict=True)}
    chunks = 1 + anchors.count() // V.CHUNK
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    window = ["anchor_id", "anchor_mark", "low", "high"]

    def found(asked: DataFrame, first: bool) -> DataFrame:
        return V.meet(to_visit(asked, lists, first, k), rows, blocks, chunks, lambda a, b: search_block(a, b, k, same_label), FOUND_SCHEMA)

    near = staged(found(anchors.withColumn("floors", F.transform("lows", lambda _: F.lit(None).cast("long"))), True), "negatives-first")
    kth = V.best(near, window, order, k).where(F.col("rank") == k)
    kth = kth.groupBy(F.col("anchor_id").alias("q"), F.col("anchor_mark").alias("m")).agg(F.collect_list(F.struct("low", "high", "score")).alias("known"))
    met = anchors.join(kth, (F.col("anchor_id") == F.col("q")) & (F.col("mark") == F.col("m")), "left")
    of = lambda low, high: F.try_element_at(F.filter("known", lambda x: (x["low"] == low) & (x["high"] == high)), F.lit(1))["score"]
    again = met.withColumn("floors", F.zip_with("lows", "highs", of)).select(*anchors.columns, "floors")
    return V.best(near.union(found(again, False)), window, order, k)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row with an id for which `anchors` (over the column id) holds.

    low, high: percent of the positive's score between which a negative's score has to lie.
    """
    some = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec")).where(V.usable(F.col("vec")) & F.col("label").isNotNull())
    known = staged(V.classes(some.select("id", "label", V.integers(F.col("vec")).alias("vec")), ["id", "label"]), "labelled-vectors")
    n = known.count()
    most = max(1, min(LISTS, n // V.BLOCK + int(n**0.5) // 8))
    centroids = fit_centroids(V.sample(known, SAMPLE * most), most)
    table = staged(in_lists(known, centroids), "inverted-lists") if len(centroids) else in_lists(known, np.zeros((1, 0)))
    lists = Lists(table, centroids)
    ends = [F.array(F.lit(x).cast("long")) for x in (-V.LONG, V.LONG - 1)]
    asked = table.where(F.col("id").isNotNull() & anchors).select(F.col("id").alias("anchor_id"), "mark", "label", "vec", F.col("copies").alias("asked"))
    key = ["anchor_id", "anchor_mark"]
    near = search(asked.withColumns({"lows": ends[0], "highs": ends[1]}), table, lists, positives, True)
    near = staged(near.select(*key, F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # integers n with low * p <= 100 * n <= high * p; no n where p is below 0
    p = F.col("positive_score").cast("decimal(20,0)")
    edges = {"low": F.ceil(p * F.lit(low) / F.lit(100)).cast("long"), "high": F.floor(p * F.lit(high) / F.lit(100)).cast("long")}
    near = near.withColumns(edges)
    windows = near.where("low <= high").groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("w"))
    windows = windows.select(F.col("anchor_id").alias("q"), F.col("anchor_mark").alias("m"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    own = asked.join(windows, (F.col("anchor_id") == F.col("q")) & (F.col("mark") == F.col("m"))).drop("q", "m")
    found = search(own, table, lists, negatives, False)
    met = near.join(found.select(*key, "low", "high", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), [*key, "low", "high"])
    times = asked.select("anchor_id", F.col("mark").alias("anchor_mark"), F.explode(F.sequence(F.lit(1).cast("long"), "asked")).alias("nth"))
    return met.join(times, key).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB's form of the query over embeddings.
SQL = r"""
WITH v AS (SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.i, a.vec_id AS anchor_id, b.i AS j, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.i <> b.i),
 p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST) AS place FROM s WHERE same) WHERE place <= 5),
 n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
   row_number() OVER (PARTITION BY p.i, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST)::INTEGER AS rank
   FROM p JOIN s ON p.i = s.i AND NOT s.same AND 30 * p.score::HUGEINT <= 100 * s.score::HUGEINT AND 100 * s.score::HUGEINT <= 90 * p.score::HUGEINT)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
