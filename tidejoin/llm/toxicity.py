"""Toxicity by maximum-scoring segments.

Each token scores the log-odds of standing in a toxic rather than a clean text. A Dirichlet prior
shares its mass out by the token's beginning, so a form never seen leans on forms that begin alike.
With a drift that makes clean text score below zero, one linear scan finds all maximal-scoring segments
of a text. The best segments of clean texts follow an extreme-value law, P(best <= x) = exp(-K n
exp(-lambda x)) for n tokens; its two parameters are fitted by maximum likelihood, and turn scores into
expected numbers of such segments by chance. A logistic curve over the best segment's and the joint
evidence gives the score.

Plan: at most FIT_ROWS labelled rows, picked by a hash of their id, are the sample that counts and
calibration are fitted on (documented bound, so their ids are broadcast); counts are of fixed size
(hashed tokens and beginnings), added up on executors. All rows are then scored in one Arrow pass.

Defined results: null and empty texts have no segments and get the score of no evidence; repeated rows
get the same score; ids may be null; with labels of one kind alone all scores are that kind's share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidejoin.llm.text import Words, map_texts, slices

#: Bound of the labelled sample.
FIT_ROWS = 40_000
TOKEN_BITS, STEM_BITS = 20, 16
#: Bytes of a token's beginning; mass of the prior on a token, and on a beginning.
STEM, TOKEN_MASS, STEM_MASS = 5, 2.0, 4.0
#: Taken off each token's log-odds; a segment counts if as many by chance are expected in a text.
DRIFT, EXPECTED = 1.0, 0.1

_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[[b for b in range(128) if not chr(b).isalnum()]] = True


def tokens_of(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Runs of ASCII letters and digits and of other characters, lower case, with hashed token and beginning."""
    w = Words(texts, lower=True, outside=_OUTSIDE)
    token = (w.hashes() >> np.uint64(64 - TOKEN_BITS)).astype(np.int64)
    stem = (w.span_hash(w.starts, np.minimum(w.ends, w.starts + STEM)) >> np.uint64(64 - STEM_BITS)).astype(np.int64)
    return w, token, stem


@dataclass
class Model:
    token: np.ndarray  # [2, tokens]: counts in clean and toxic texts
    stem: np.ndarray
    shape: tuple[float, float] = (1.0, 1.0)  # lambda, K
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)

    def token_scores(self, token: np.ndarray, stem: np.ndarray) -> np.ndarray:
        clean, toxic = (float(max(1.0, x.sum())) for x in self.token)
        share = toxic / (clean + toxic)
        a, b = self.stem[0][stem], self.stem[1][stem]
        prior = (b + STEM_MASS * share) / (a + b + STEM_MASS)
        odds = (self.token[1][token] + TOKEN_MASS * prior) / (self.token[0][token] + TOKEN_MASS * (1 - prior))
        return np.log(odds) - np.log(toxic / clean) - DRIFT

    def evidence(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-log of the expected number of segments as good in n tokens of clean text."""
        rate, k = self.shape
        return rate * best - np.log(k * np.maximum(n, 1))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time: none can be made better by growing or shrinking."""
    positive = scores > 0
    if not positive.any():
        return []
    turn = np.flatnonzero(np.diff(np.concatenate(([False], positive, [False])).astype(np.int8)))
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []  # start, end, sum before, sum after, and the nearest earlier one whose sum before is less
    for start, end in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
        low, high = float(sums[start]), float(sums[end])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([start, end, low, high, j])
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, b - a) for s, e, a, b, _ in found]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    token = np.zeros((2, 1 << TOKEN_BITS), np.int64)
    stem = np.zeros((2, 1 << STEM_BITS), np.int64)
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for low, high in slices(batch.column(0)):
            w, t, s = tokens_of(batch.column(0).slice(low, high - low))
            of = toxic[low:high][w.text_of]
            for label in (0, 1):
                token[label] += np.bincount(t[of == label], minlength=token.shape[1])
                stem[label] += np.bincount(s[of == label], minlength=stem.shape[1])
    for kind, x in enumerate((token, stem)):
        at = np.flatnonzero(x.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(x[0][at]), pa.array(x[1][at])], ["kind", "at", "clean", "toxic"])


def _scan(model: Model):
    """For each text: n, best segment, joint evidence of those that count, and these segments."""

    def of_slice(texts: pa.Array) -> dict:
        w, token, stem = tokens_of(texts)
        scores = model.token_scores(token, stem)
        out: dict[str, list] = {"n": w.count.tolist(), "best": [], "joint": [], "starts": [], "ends": [], "evidence": []}
        for low, high in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            segments = maximal_segments(scores[low:high])
            out["best"].append(max((s[2] for s in segments), default=0.0))
            found = np.array([s[2] for s in segments])
            weight = model.evidence(found, np.full(len(found), high - low))
            ok = weight > -np.log(EXPECTED)
            out["joint"].append(float(weight[ok].sum()))
            out["starts"].append([segments[i][0] for i in np.flatnonzero(ok)])
            out["ends"].append([segments[i][1] for i in np.flatnonzero(ok)])
            out["evidence"].append(weight[ok].tolist())
        types = {"n": pa.int64(), "best": pa.float64(), "joint": pa.float64(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "evidence": pa.list_(pa.float64())}
        return {k: pa.array(v, types[k]) for k, v in out.items()}

    return of_slice


_SCANNED = "n long, best double, joint double, starts array<int>, ends array<int>, evidence array<double>"


def fit_extremes(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of the likeliest extreme-value law for the best segments of clean texts of n tokens."""
    if not len(best):
        return 1.0, 1.0
    n = np.maximum(n, 1).astype(float)

    def likelihood(rate: float) -> tuple[float, float]:
        k = len(best) / np.sum(n * np.exp(-rate * best))
        return float(np.sum(np.log(k * rate * n) - rate * best) - len(best)), float(k)

    rate = max(np.linspace(0.05, 3, 119), key=lambda r: likelihood(r)[0])
    return float(rate), likelihood(rate)[1]


def _inputs(evidence: np.ndarray, joint: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(evidence)), np.clip(evidence, -5, 30), np.log1p(joint)))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a weak ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Model from labelled rows: seven tenths of the sample give the counts, the rest the calibration."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col)).agg(F.max(label_col).cast("int").alias("label"))
    place = F.xxhash64(F.lit("toxicity"), F.col(id_col))
    sample = known.orderBy(place, id_col).limit(FIT_ROWS).select(id_col, "label", (F.pmod(place, F.lit(10)) >= 7).alias("calibrate"))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), id_col)
    counted = rows.where("NOT calibrate").select("text", "label").mapInArrow(_counts, "kind int, at long, clean long, toxic long")
    counted = counted.groupBy("kind", "at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    tables = []
    for kind, bits in ((0, TOKEN_BITS), (1, STEM_BITS)):
        part = counted[counted["kind"] == kind]
        x = np.zeros((2, 1 << bits), np.float32)
        x[0, part["at"]], x[1, part["at"]] = part["clean"], part["toxic"]
        tables.append(x)
    model = Model(*tables)

    held = rows.where("calibrate").withColumn("row", F.struct(id_col, "label"))
    counts = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, about 10 MB

    def scan(shape: tuple[float, float]):
        return lambda texts: _scan(replace(counts.value, shape=shape))(texts)

    scanned = map_texts(held, _SCANNED, scan(model.shape), "row", "text").select("row.label", "n", "best").toPandas()
    if scanned["label"].nunique() < 2:
        share = float(scanned["label"].mean()) if len(scanned) else 0.0
        model.curve = (float(np.log((share + 1e-6) / (1 - share + 1e-6))), 0.0, 0.0)
        return model
    clean = scanned[(scanned["label"] == 0) & (scanned["n"] > 0)]
    model.shape = fit_extremes(clean["best"].to_numpy(), clean["n"].to_numpy())
    again = map_texts(held, _SCANNED, scan(model.shape), "row", "text").select("row.label", "n", "best", "joint").toPandas()
    x = _inputs(model.evidence(again["best"].to_numpy(), again["n"].to_numpy()), again["joint"].to_numpy())
    model.curve = fit_curve(x, again["label"].to_numpy().astype(float))
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, starts, ends, evidence) of every row; starts and ends count tokens from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, about 10 MB

    def of_slice(texts: pa.Array) -> dict:
        m = shared.value
        out = _scan(m)(texts)
        best, n = out["best"].to_numpy(), out["n"].to_numpy()
        x = _inputs(m.evidence(best, n), out["joint"].to_numpy())
        score = 1 / (1 + np.exp(-np.clip(x @ np.array(m.curve), -30, 30)))
        return {"score": score, "predicted": (score >= 0.5).astype(np.int32), **{k: out[k] for k in ("starts", "ends", "evidence")}}

    return map_texts(docs, "score double, predicted int, starts array<int>, ends array<int>, evidence array<double>", of_slice, id_col, text_col)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the row is kept from learning: crc32 of the id's text, modulo parts."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
