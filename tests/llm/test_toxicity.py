import random

import numpy as np

from tests.llm.cases import docs, empty_docs, odd_docs
from tidejoin.llm.toxicity import fit, fit_extremes, maximal_segments, toxicity


def brute_segments(x):
    """The best segment, then the same left and right of it."""

    def part(low, high):
        best = max(((sum(x[a:b]), a - b, a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        _, _, a, b = max((s, n, a, b) for s, n, a, b in ((sum(x[i:j]), j - i, i, j) for i in range(low, high) for j in range(i + 1, high + 1)) if abs(s - best[0]) < 1e-9)
        return part(low, a) + [(a, b)] + part(b, high)

    return part(0, len(x))


def test_segments_match_brute_force():
    rng = np.random.default_rng(4)
    for n in list(range(0, 14)) * 6:
        x = rng.normal(-0.2, 1, n)
        assert [s[:2] for s in maximal_segments(x)] == brute_segments(x.tolist())


def test_extremes_are_recovered():
    rng = np.random.default_rng(1)
    n = rng.integers(50, 500, 4000)
    best = (np.log(0.2 * n) - np.log(-np.log(rng.random(4000)))) / 0.7
    rate, k = fit_extremes(best, n)
    assert abs(rate - 0.7) < 0.05 and abs(np.log(k / 0.2)) < 0.3


def made(n, seed):
    rng = random.Random(seed)
    bad = ["vileA", "vileB", "vileC", "grimX", "grimY"]
    texts, marks = [], []
    for _ in range(n):
        words = rng.choices([f"w{i}" for i in range(400)], k=rng.randrange(20, 200))
        marks.append(int(rng.random() < 0.2))
        if marks[-1]:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(bad, k=rng.randrange(3, 9))
        texts.append(" ".join(words))
    return texts, marks


def test_held_out_accuracy_and_passages(spark):
    texts, marks = made(900, 3)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks[:700])] + [(800, None)], "doc_id long, toxic int")
    frame = docs(spark, texts)
    model = fit(frame, labels)
    found = toxicity(frame, model).orderBy("doc_id").collect()
    right = [r.predicted == m for r, m in zip(found[700:], marks[700:], strict=True)]
    assert sum(right) / len(right) > 0.95 and all(0 <= r.score <= 1 for r in found)
    for r in found[700:]:
        assert all(any("vile" in w or "grim" in w for w in texts[r.doc_id].split()[a:b]) for a, b in zip(r.starts, r.ends, strict=True)) or not marks[r.doc_id]


def test_odd_and_empty_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit(odd_docs(spark), nothing)
    assert toxicity(odd_docs(spark), model).count() == odd_docs(spark).count() and toxicity(empty_docs(spark), model).count() == 0
    one_kind = fit(odd_docs(spark), spark.createDataFrame([(i, 1) for i in range(11)], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity(odd_docs(spark), one_kind).collect()} <= {0, 1}
