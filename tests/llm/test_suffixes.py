import random

from tests.llm.cases import docs, empty_docs, odd_docs, words
from tidejoin.llm.suffixes import MIN_WORDS, repeated_passages


def brute(rows):
    """{(doc, word)}: words inside a stretch of MIN_WORDS words that another document has too."""
    at = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - MIN_WORDS + 1):
            at.setdefault(tuple(w[k : k + MIN_WORDS]), []).append((i, k))
    return {(i, k + j) for found in at.values() if len({i for i, _ in found}) > 1 for i, k in found for j in range(MIN_WORDS)}


def covered(found):
    return {(r.doc_id, k) for r in found for k in range(r.start_word, r.end_word)}


def test_planted_passages_match_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    fresh = lambda n: rng.choices(vocab, k=n)
    passages = [fresh(n) for n in (50, 51, 57, 64, 80, 120, 300, 49, 30)]
    texts = []
    for i in range(120):
        parts = fresh(rng.randrange(40))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            low = rng.choice([0, 0, rng.randrange(5)])
            parts += p[low:] + fresh(rng.randrange(30))
        texts.append(rng.choice([" ", "\n"]).join(parts))
    texts += [" ".join(passages[6])] * 3 + [" ".join(["again"] * 200), " ".join(["again"] * 90)]
    found = repeated_passages(docs(spark, texts)).collect()
    assert covered(found) == brute(list(enumerate(texts)))
    assert all(r.n_words >= MIN_WORDS and r.other_id != r.doc_id for r in found)


def passages(rows):
    """{(doc, start, end, least other document)} of united stretches of MIN_WORDS words that another document has too."""
    at = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - MIN_WORDS + 1):
            at.setdefault(tuple(w[k : k + MIN_WORDS]), set()).add((i, k))
    hits = {}
    for found in at.values():
        for i, k in found:
            if others := {j for j, _ in found} - {i}:
                hits.setdefault(i, []).append((k, min(others)))
    out = set()
    for i, found in hits.items():
        united = []
        for k, other in sorted(found):
            if united and k <= united[-1][1]:
                united[-1] = (united[-1][0], k + MIN_WORDS, min(united[-1][2], other))
            else:
                united.append((k, k + MIN_WORDS, other))
        out |= {(i, *u) for u in united}
    return out


def test_every_partitioning_gives_the_same(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    common, pair, chain = fresh(60), fresh(70), fresh(300)
    texts = [common] * 9 + [["y", *common]] + [fresh(20) + common + fresh(20) for _ in range(12)] + [pair + fresh(5), fresh(9) + pair + common]
    texts += [chain[k : k + 120] for k in range(0, 180, 30)] + [common[:49], common[5:58]]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    expected = passages(list(enumerate(texts)))
    settings = {"spark.sql.shuffle.partitions": None, "spark.sql.adaptive.coalescePartitions.enabled": None}
    settings = {k: spark.conf.get(k) for k in settings}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in ("1", "8", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found = repeated_passages(docs(spark, texts)).collect()
            assert {(r.doc_id, r.start_word, r.end_word, r.other_id) for r in found} == expected and len(found) == len(expected)
    finally:
        for k, v in settings.items():
            spark.conf.set(k, v)


def test_popular_seeds_hide_no_passage(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(20):
        passage = fresh(rng.choice((50, 50, 53, 58)))
        pair = [fresh(20) + passage + fresh(20) for _ in range(2)]
        texts += pair
        for _ in range(60):  # 49 words of one of the two: too few for a passage, but often the whole seed
            low = rng.randrange(5, 40)
            texts.append(fresh(16) + rng.choice(pair)[low : low + 49] + fresh(16))
    texts = [" ".join(t) for t in texts]
    expected = brute(list(enumerate(texts)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert covered(repeated_passages(docs(spark, texts)).collect()) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_and_empty_tables(spark):
    assert repeated_passages(empty_docs(spark)).count() == 0
    assert repeated_passages(odd_docs(spark)).count() == 0
    assert repeated_passages(odd_docs(spark).union(odd_docs(spark).selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars", "ids", "kept", "score", "key"))).count() == 2
