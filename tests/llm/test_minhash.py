import random

from tests.llm.cases import docs, empty_docs, lowered, odd_docs, words
from tidejoin.llm.components import components
from tidejoin.llm.minhash import near_duplicates


def shingles(text, width):
    w = words(lowered(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def brute(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = list(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                low[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def check(spark, texts, width):
    found = near_duplicates(docs(spark, texts), width).collect()
    expected = brute(list(enumerate(texts)), width)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == expected
    return expected


def test_groups_of_copies_match_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"W{i}" for i in range(500)]
    texts = []
    for size in (40, 20, 5, 2, 1, 1):
        base = rng.choices(vocab, k=rng.randrange(60, 120))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].lower(), "", None, "one", "ONE", "two words", "two  words"]
    expected = check(spark, texts, 2)
    assert len({c for _, c, _ in expected.values()}) < len(texts) - 40
    check(spark, texts, 5)


def test_an_id_with_several_texts(spark):
    """It is linked with what any of its texts is like, in whatever order rows come."""
    rng = random.Random(6)
    text = lambda: " ".join(rng.choices([f"t{i}" for i in range(4000)], k=60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (8, c), (9, d), (9, c), (4, d), (10, text()), (10, text()), (11, None), (11, a), (3, b)]
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, 2))
    like = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    low = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if any(like(x, y) for x in sets[i] for y in sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    expected = sorted((i, len(shingles(t, 2)), low[i] if t else i) for i, t in rows)
    for order in (rows, rows[::-1], rng.sample(rows, len(rows))):
        found = near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3), 2).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected


def test_chain_is_one_component(spark):
    assert {tuple(r) for r in components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")).collect()} == {(i, 0) for i in range(61)}


def test_odd_and_empty_tables(spark):
    assert near_duplicates(empty_docs(spark)).count() == 0
    found = near_duplicates(odd_docs(spark), 2).collect()
    assert len(found) == odd_docs(spark).count()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by[2].component_id == 1 and by[10].component_id == 9 and by[3].component_id == 3 and by[4].kept
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)
