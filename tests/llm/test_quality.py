from collections import Counter

import numpy as np

from tests.llm.cases import DOCS, docs, empty_docs, odd_docs, words
from tidejoin.llm import quality
from tidejoin.llm.quality import COUNTS, IsolationForest, calibrated, quality_verdicts


def brute(text):
    text = text or ""
    ws = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times = Counter(tri)
    hit = {i + k for i, t in enumerate(tri) if times[t] >= 2 for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts_match_brute_force(spark):
    found = quality_verdicts(odd_docs(spark), labels(spark, [(1, 1, 0), (None, None, None)])).select("doc_id", *COUNTS, "base_failed", "kept").toPandas()
    expected = [brute(r.text) for r in odd_docs(spark).collect()]
    assert sorted(map(tuple, found[COUNTS].to_numpy().tolist())) == sorted(expected)
    failed = (found.n_words < 50) | (100 * found.n_repeat_words > 50 * found.n_words)
    assert (found.base_failed == failed).all() and not found.kept[failed].any()


def test_lines_and_repeats(spark):
    texts = ["a b c\nd\na b c\n \na b c", "x y z x y z", "x y z", "a\r\na\r\na", "\n\n\na", "é漢 | <b> é漢 | <b>", "p q\np q", "q\n"]
    found = quality_verdicts(docs(spark, texts), labels(spark, [(0, 1, 0)])).orderBy("doc_id").select(*COUNTS).collect()
    assert [tuple(r) for r in found] == [brute(t) for t in texts]


def test_forest_tells_junk_from_prose(spark):
    good = [" ".join(f"w{(i * 37 + j * 11) % 911}x{'y' * (j % 5)}" for j in range(80 + i)) + "." for i in range(120)]
    bad = [" ".join(f"{'#$%' * 3}{j}|" for j in range(90 + i)) for i in range(30)]
    rows = [(i, 1, 0) for i in range(120)] + [(120 + i, 0, 0) for i in range(0, 30, 2)]
    found = quality_verdicts(docs(spark, good + bad), labels(spark, rows)).toPandas().set_index("doc_id").sort_index()
    assert found.kept[:120].mean() > 0.95 and not found.kept[120:].any()


def test_path_lengths_match_a_plain_walk():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 4))
    rows[:5] += 8
    forest = IsolationForest.fit(rows)

    def rest(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def path(tree, row):
        at = 0
        while forest.feature[tree, at] >= 0:
            at = int(forest.left[tree, at] + (row[forest.feature[tree, at]] >= forest.value[tree, at]))
        return forest.depth[tree, at]

    expected = [2 ** (-np.mean([path(t, r) for t in range(len(forest.feature))]) / rest(256)) for r in rows[:40]]
    assert np.allclose(forest.score(rows[:40]), expected)
    assert forest.score(rows[:5]).min() > np.quantile(forest.score(rows[5:]), 0.95)


def test_leaves_hold_their_depth_and_the_expected_rest():
    rows = np.arange(8.0)[:, None]
    feature, value, left, depth = IsolationForest._tree(rows, 20, np.random.default_rng(1))
    levels = {0: 0}
    for at in range(len(feature)):
        if feature[at] >= 0:
            levels[left[at]] = levels[left[at] + 1] = levels[at] + 1
    leaves = [at for at in range(len(feature)) if feature[at] < 0]
    assert len(leaves) == 8 and all(depth[at] == levels[at] for at in leaves)


def test_threshold_against_every_other():
    rng = np.random.default_rng(5)
    for shift in (0.05, 0.3, 1.0):
        good, bad = rng.random(400), rng.random(60) + shift
        gain = lambda t: (bad > t).mean() - quality.GOOD_WEIGHT * (good > t).mean()
        best = max(gain(t) for t in np.concatenate((good, bad)))
        threshold = calibrated(good, bad)
        assert np.isinf(threshold) if best <= 0 else abs(gain(threshold) - best) < 1e-12
    assert np.isinf(calibrated(good, bad[:0])) and np.isinf(calibrated(good[:0], bad))


def test_held_out_rows(spark):
    rng = np.random.default_rng(8)
    prose = lambda: " ".join(("word", "and", "other", "thing", "longer")[k % 5] + str(k % 83) * int(k % 3 == 0) for k in rng.integers(0, 900, 120)) + "."
    junk = lambda: " ".join("|" * int(rng.integers(1, 4)) + str(k) for k in rng.integers(0, 900, 120))
    texts = [prose() for _ in range(400)] + [junk() for _ in range(60)]
    rows = [(i, int(i < 400), 0) for i in range(460) if i % 2]
    found = quality_verdicts(docs(spark, texts), labels(spark, rows)).toPandas().set_index("doc_id").kept.sort_index()
    held = found[found.index % 2 == 0]
    assert held[held.index < 400].mean() >= 0.98 and held[held.index >= 400].mean() <= 0.1


def test_empty_table_and_no_labels(spark):
    assert quality_verdicts(empty_docs(spark), labels(spark, [])).count() == 0
    found = quality_verdicts(docs(spark, [" ".join(map(str, range(60)))]), labels(spark, []))
    assert found.collect()[0].kept


def test_schema_keeps_the_id_type(spark):
    frame = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    assert quality_verdicts(frame, spark.createDataFrame([], "doc_id string, quality int")).schema["doc_id"].dataType.simpleString() == "string"
    assert DOCS["doc_id"].dataType.simpleString() == "bigint"


def test_all_labelled_rows_count(spark, monkeypatch):
    """No bound on the labelled rows that set ranges, leaves and threshold."""
    monkeypatch.setattr(quality, "FIT_ROWS", 4, raising=False)  # the bound of an earlier form
    good = [" ".join(f"w{(i * 37 + j * 11) % 911}x{'y' * (j % 5)}" for j in range(80 + i)) + "." for i in range(60)]
    bad = [" ".join(f"{'#$%' * 3}{j}|" for j in range(90 + i)) for i in range(30)]
    rows = [(i, int(i < 60), 0) for i in range(90)]
    found = quality_verdicts(docs(spark, good + bad), labels(spark, rows)).toPandas().set_index("doc_id").sort_index()
    assert found.kept[:60].mean() > 0.9 and found.kept[60:].mean() < 0.2


def test_ranges_of_all_good_rows(spark):
    rows = np.random.default_rng(4).normal(size=(3001, len(quality.FEATURES))).round(2)
    found = quality.usual_range(spark.createDataFrame([(r.tolist(),) for r in rows], "features array<double>"))
    expected = quality.UsualRange.of(rows)
    for k in ("low", "high", "scale"):
        assert np.allclose(getattr(found, k), getattr(expected, k), rtol=0, atol=1e-12)


def test_leaves_stand_for_all_rows():
    rows = np.random.default_rng(5).normal(size=(1000, 3))
    forest = IsolationForest.fit(rows[:256])
    count = lambda x: np.array([np.bincount(at, minlength=forest.feature.shape[1]) for at in forest.leaves(x)])
    assert np.allclose(forest.weighed(count(rows[:256]), 256).score(rows), forest.score(rows))  # each tree drew just these
    twice = forest.weighed(count(np.concatenate((rows, rows))), 256)
    assert np.allclose(twice.score(rows), forest.weighed(count(rows), 256).score(rows)) and not np.allclose(twice.score(rows), forest.score(rows))
