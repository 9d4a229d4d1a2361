import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import docs, empty_docs, lowered, odd_docs, words
from tidejoin.llm import attention as A


def base(rows, learned):
    counts = Counter()
    for (_, t), ok in zip(rows, learned, strict=True):
        if ok:
            counts.update(words(lowered(t)))
            counts[None] += 1
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        toks = words(lowered(t)) + [None]
        out[i] = len(toks), sum(counts[x] > 0 for x in toks), total, sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in toks)
    return out


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in A.first_weights().items()}
    ids = rng.integers(0, A.TAILS, (2, 3, A.CONTEXT))
    target = rng.integers(0, A.CLASSES, (3, A.CONTEXT))
    target[0, 20:] = -1
    _, g = A.gradients(w, ids[0], ids[1], target)
    for k in w:
        at = tuple(int(rng.integers(n)) for n in w[k].shape) if k not in ("start", "tail") else (int(ids[0 if k == "start" else 1][0, 3]), 2)
        step = np.zeros_like(w[k])
        step[at] = 1e-5
        up, down = (A.gradients(w | {k: w[k] + s * step}, ids[0], ids[1], target)[0] for s in (1, -1))
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-4, k


def test_classes_share_all_probability():
    rng = np.random.default_rng(2)
    every = np.arange(A.CLASSES + 1)
    seen = rng.integers(0, 900, A.CLASSES + 1)
    w = A.first_weights() | A.class_frequencies(seen)
    flat = np.exp(A.class_log_probs(w | {"u": w["u"] * 0, "ug": w["ug"] * 0}, rng.normal(0, 1, (len(every), A.WIDTH)).astype(np.float32), every))
    assert np.allclose(flat, (seen + 0.5) / (seen + 0.5).sum(), rtol=1e-4)
    for size in (1, 300):  # with large logits, too
        z = np.repeat(rng.normal(0, size, (3, A.WIDTH)).astype(np.float32), len(every), 0)
        w = {k: v * (size if k in ("u", "ug") else 1) for k, v in w.items()}
        found = A.class_log_probs(w, z, np.tile(every, 3))
        assert np.isfinite(found).all() and np.allclose(np.exp(found.reshape(3, -1)).sum(1), 1, atol=1e-4)
        mixed = rng.permutation(len(z))
        assert np.allclose(A.class_log_probs(w, z[mixed], np.tile(every, 3)[mixed]), found[mixed], rtol=1e-5, atol=1e-5)


def test_large_attention_scores():
    rng = np.random.default_rng(4)
    w = A.first_weights()
    w |= {"q": w["q"] * 300, "k": w["k"] * 300}
    ids = rng.integers(0, A.TAILS, (2, 5, A.CONTEXT))
    s = A.hidden(w, ids[0], ids[1])["s"]
    assert np.isfinite(s).all() and np.allclose(s.sum(-1), 1, atol=1e-4) and not np.triu(s, 1).any()


def test_a_target_costs_a_fraction_of_the_classes(monkeypatch):
    rng = np.random.default_rng(3)
    w, n, made, exp = A.first_weights(), 64, [], np.exp
    ids, target = rng.integers(0, A.TAILS, (2, n, A.CONTEXT)), rng.integers(0, A.CLASSES + 1, (n, A.CONTEXT))
    monkeypatch.setattr(np, "exp", lambda x, **k: made.append(np.size(x)) or exp(x, **k))
    A.class_log_probs(w, np.zeros((n, A.WIDTH), np.float32), target[:, 0])
    assert 0 < sum(made) < n * A.CLASSES / 4
    made.clear()
    A.gradients(w, ids[0], ids[1], target)
    assert 0 < sum(made) < target.size * (A.CONTEXT + A.CLASSES / 4)


def test_windows_score_each_token_once_and_causally():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (0, 1, 11, 31, 32, 55, 56, 200)]
    counts = A.Counts(np.ones(A.CLASSES + 1, np.int64), np.ones(A.CLASSES + 1, np.int64))
    w = A.first_weights()
    found = A.score_block(pa.array(texts), np.zeros(0, np.uint64), np.zeros(0, np.int64), w, counts)
    t = A.Tokens.of(pa.array(texts))
    start, tail, target, first = t.sequences()
    for i, text in enumerate(texts):
        total = 0.0
        for place in range(len(words(text)) + 1):
            low = 0 if place < A.CONTEXT else A.STRIDE * -(-(place - A.CONTEXT + 1) // A.STRIDE)
            at = first[i] + np.arange(low, place + 1)
            z = A.hidden(w, start[None, at], tail[None, at])["z"][0, -1:]
            total += float(A.class_log_probs(w, z, target[at[-1:]])[0])
        new = math.log(1 / 2) * len(words(text))
        assert abs(found["score"][i] - (total + new) / math.log(10)) < 1e-3


def test_counts_and_learning(spark):
    rng = random.Random(6)
    texts = []
    for i in range(1200):  # two languages that do not mix
        stem = "abcdefghij" if i % 2 else "klmnopqrst"
        texts.append(" ".join(rng.choice(stem) + rng.choice(stem) + str(rng.randrange(4)) for _ in range(rng.randrange(20, 120))))
    texts += ["", None, "Never SEEN before", texts[0]]
    found = A.language_scores(docs(spark, texts), "doc_id % 4 <> 1").collect()
    expected = base(list(enumerate(texts)), [i % 4 != 1 for i in range(len(texts))])
    for r in found:
        n, known, total, score = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - score) < 1e-6 * max(1, -score)
        assert r.score < 0 and r.learned == (r.doc_id % 4 != 1)
    out = [r for r in found if not r.learned]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_every_learning_token_is_trained_on(spark, monkeypatch):
    import pyarrow as pa

    texts = [" ".join(f"{(i * 37 + k) % 9000 + 1000}" for k in range(n)) for i, n in enumerate((0, 1, 31, 32, 33, 500, 700))]
    t = A.Tokens.of(pa.array(texts))
    monkeypatch.setattr(A, "TASK_WINDOWS", 7)
    shards = list(A._shards(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])] * 2)))
    assert {len(s) for s in shards[:-1]} == {7}
    found = np.concatenate(shards)
    real = found[:, 2] >= 0
    assert Counter(found[:, 2][real].tolist()) == Counter(t.sequences()[2].tolist() * 2)
    assert Counter(found[:, 0][real].tolist()) == Counter(t.sequences()[0].tolist() * 2)
    w = A.fit_attention(docs(spark, texts).selectExpr("text", "doc_id AS id"), np.ones(A.CLASSES + 1, np.int64))
    assert (w["start"] != A.first_weights()["start"])[t.start].any(1).all()


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_BYTES", 500)
    texts = [f"some words of a text numbered {i}" for i in range(300)]
    df = docs(spark, texts[:200]).union(spark.createDataFrame([(None, t, *[None] * 7) for t in texts[200:]], docs(spark, []).schema))
    rows = df.selectExpr("doc_id AS id", "text", "true AS learned")
    found, learning = A.in_blocks(rows)
    sizes = [r.n for r in found.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n")).collect()]
    assert learning == 300 and sum(sizes) == sum(map(len, texts)) and max(sizes) < 1500
    scores = {r.doc_id: r for r in A.language_scores(df, "true").collect()}
    expected = base([(i, t) for i, t in enumerate(texts)], [True] * 300)
    assert all(abs(scores[i].base_score - expected[i][3]) < 1e-6 for i in range(200))


def test_odd_and_empty_tables(spark):
    assert A.language_scores(empty_docs(spark), "true").count() == 0
    found = A.language_scores(odd_docs(spark), "doc_id <> 6").collect()
    assert len(found) == odd_docs(spark).count() and {r.n_tokens for r in found if r.doc_id in (3, 4, 5)} == {1}
    assert all(r.score < 0 for r in A.language_scores(odd_docs(spark), "false").collect())
