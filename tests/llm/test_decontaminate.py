import hashlib
import random
import re

from tests.llm.cases import docs, empty_docs, lowered, odd_docs
from tidejoin.llm import decontaminate as D
from tidejoin.llm.decontaminate import contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text, items):
    ws = WORD.findall(lowered(text))
    hit, ids = set(), set()
    for item, t in items:
        w = WORD.findall(lowered(t))
        m = min(10, len(w))
        wins = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(ws) - m + 1) if m else ():
            if tuple(ws[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                ids.add(str(item))
    return len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "漢字"]
    items = [(i, " ".join(rng.choices(vocab, k=k))) for i, k in enumerate([3, 9, 10, 11, 14, 25, 40, 1, 0, 14])] + [(3, "extra words of an item with an id used twice in here")]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choices(vocab, k=rng.randrange(30)))]
        for _, t in rng.sample(items, 2):
            w = t.split()
            low = rng.randrange(len(w) + 1)
            parts += [" ".join(w[low : low + rng.randrange(8, 16)]), " ".join(rng.choices(vocab, k=rng.randrange(6)))]
        texts.append(", ".join(parts).upper())
    found = contamination(docs(spark, texts), bench(spark, items)).orderBy("doc_id").collect()
    for r, t in zip(found, texts, strict=True):
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(t, items), t


def test_words_that_repeat_and_shared_windows(spark):
    items = [(i, " ".join(["a b c"] * 30)) for i in range(20)] + [(30, " ".join(f"q{i}" for i in range(200))), (31, "z " * 40)]
    texts = ["x y " + "a b c " * 50 + "tail", "a " * 60, "z " * 100, " ".join(f"q{i}" for i in range(50, 170)), " ".join(f"q{i} -" for i in range(9))]
    found = contamination(docs(spark, texts), bench(spark, items)).orderBy("doc_id").collect()
    for r, t in zip(found, texts, strict=True):
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(t, items), t


def test_long_texts_and_tables_beyond_the_broadcast(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 1)
    items = [(i, " ".join(f"k{rng.randrange(3000)}" for _ in range(30))) for i in range(20)]
    texts = [" ".join(f"k{rng.randrange(3000)}" for _ in range(40_000)) + " " + items[3][1] + " " + items[4][1][:60], "short", None]
    found = contamination(docs(spark, texts), bench(spark, items)).orderBy("doc_id").collect()
    for r, t in zip(found, texts, strict=True):
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(t, items)


def test_odd_and_empty_tables(spark):
    items = [(1, "the same short text of a few words"), (2, None), (None, "no id here"), (4, "")]
    rows = odd_docs(spark)
    found = contamination(rows, bench(spark, items)).collect()
    expected = sorted((str(r.doc_id), brute(r.text, [i for i in items if i[0] is not None])[1]) for r in rows.collect() if r.text != "no id here")
    assert sorted((str(r.doc_id), r.n_hit) for r in found if r.n_hit != 3) == expected
    assert [r.n_items for r in found if r.n_hit == 3] == [0]
    assert contamination(empty_docs(spark), bench(spark, items)).count() == 0
    assert not any(r.contaminated for r in contamination(rows, bench(spark, [])).collect())
