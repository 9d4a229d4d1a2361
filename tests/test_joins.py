import random
import struct

import pytest
from pyspark.sql import types as T

from tidejoin.functions.murmur import bucket, murmur3
from tidejoin.operators import join
from tidejoin.operators.join import window_join
from tidejoin.plans.experiments import highest_rate, next_range, processed_prefix, sweep
from tidejoin.plans.spec import JoinSpec, Predicate, Window
from tidejoin.sources import streams
from tidejoin.streaming.join import file_stream, in_time_slices, progress_table, run_available, stream_join

SECOND = 1_000_000_000
LEFT = T.StructType([T.StructField("id", T.LongType()), T.StructField("t_ns", T.LongType()), T.StructField("x", T.IntegerType()), T.StructField("y", T.FloatType())])


def pair(spark, r, s):
    return streams.generated_pair(spark.createDataFrame(r, LEFT), spark.createDataFrame(s, LEFT))


def f32(v):
    return struct.unpack("f", struct.pack("f", v))[0]


def brute(r, s, spec):
    def match(x, y, a, b):
        if spec.predicate is Predicate.KEY:
            return x == a
        if spec.predicate is Predicate.BAND:
            return abs(a - x) < 10 and abs(b - y) < 10
        p, q = f32(f32(x) + f32(y)), f32(f32(a) + f32(b))
        if spec.predicate is Predicate.SUM_F32:
            return p == q
        if spec.predicate is Predicate.SUM_TRUNC:
            return int(p) == int(q)
        p, q = (x + int(y)) % 2**32, (a + int(b)) % 2**32
        return p == q != 0

    def near(t, u):
        less = (lambda m, n: m < n) if spec.strict else (lambda m, n: m <= n)
        forward = less(u, t + spec.w_r * SECOND)
        return spec.window is Window.NONE or forward and (spec.window is Window.ONE_SIDED or less(t, u + spec.w_s * SECOND))

    return sorted((i, j) for i, t, x, y in r for j, u, a, b in s if match(x, y, a, b) and near(t, u))


def rows(rng, n):
    return [(i, rng.randrange(0, 40) * SECOND, rng.randrange(-25, 25), f32(rng.choice([rng.randrange(-25, 25), rng.randrange(-99, 99) / 4]))) for i in range(n)]


@pytest.mark.parametrize("predicate", list(Predicate))
@pytest.mark.parametrize("window", list(Window))
def test_batch_join_matches_brute_force(spark, predicate, window):
    rng = random.Random(f"{predicate}{window}")
    r, s = rows(rng, 60), rows(rng, 50)
    for w_r, w_s, strict in ((5, 5, True), (5, 5, False), (3, 11, True), (11, 3, False)):
        spec = JoinSpec(predicate, w_r, w_s, strict, window)
        assert sorted(tuple(p) for p in window_join(*pair(spark, r, s), spec).collect()) == brute(r, s, spec)


def test_edges(spark):
    one = [(0, 0, 1, 0.0)]
    at = lambda n: [(0, n, 1, 0.0)]
    count = lambda r, s, **k: window_join(*pair(spark, r, s), JoinSpec(w_r=10, w_s=10, **k)).count()
    assert count(one, at(10 * SECOND)) == 0 and count(one, at(10 * SECOND), strict=False) == 1 and count(one, at(0)) == 1
    assert count([], one) == 0 and count(one, []) == 0
    big = [(0, 0, 16777216, 1.0)]
    assert count(big, [(0, 0, 16777216, 0.0)], predicate=Predicate.SUM_F32) == 1
    assert count([(0, 0, 0, -0.5)], [(0, 0, 0, 0.5)], predicate=Predicate.SUM_TRUNC) == 1
    assert count([(0, 0, 0, 0.0)], [(0, 0, 0, 0.0)], predicate=Predicate.SUM_INT) == 0
    assert count([(0, 0, 0, 0.0)], [(0, 0, 10, 0.0), (1, 0, 9, -9.0), (2, 0, -9, 9.0), (3, 0, -10, 0.0)], predicate=Predicate.BAND) == 2
    assert count([(0, 0, None, None)], [(0, 0, None, None)]) == 0
    with pytest.raises(ValueError):
        JoinSpec(w_r=0)


@pytest.mark.parametrize(("predicate", "strict"), [(Predicate.KEY, True), (Predicate.BAND, False), (Predicate.SUM_INT, True)])
def test_one_sided_blocks_of_a_hot_key(spark, monkeypatch, predicate, strict):
    """A key with half of all rows is dealt over pairs of blocks, none of which holds more than two blocks."""
    monkeypatch.setattr(join, "BLOCK", 8)
    rng = random.Random(8)
    r, s = ([(i, t, 3 if rng.random() < 0.5 else x, 2.0 if rng.random() < 0.5 else y) for i, t, x, y in rows(rng, 90)] for _ in range(2))
    spec = JoinSpec(predicate, 5, 5, strict, Window.ONE_SIDED)
    left, right = pair(spark, r, s)
    assert sorted(tuple(p) for p in window_join(left, right, spec).collect()) == brute(r, s, spec)
    a, b, _ = join._blocked(*join.keyed(left, right, spec), spec)
    for side in (a.groupBy("r_key", "r_block", "r_meets"), b.groupBy("s_key", "s_meets", "s_block")):
        counts = [x["count"] for x in side.count().collect()]
        assert max(counts) <= 8 and len(counts) > 20


def test_grid_meets_few_that_do_not_match(spark):
    """With one value of x alone, the other column keeps rows apart."""
    rng = random.Random(9)
    r, s = ([(i, 0, 5, f32(rng.randrange(-(10**6), 10**6) / 100)) for i in range(1500)] + [(1500, 0, 5, float("inf")), (1501, 0, 5, 3e38), (1502, 0, 5, None)] for _ in range(2))
    spec = JoinSpec(Predicate.BAND, window=Window.NONE)
    found = window_join(*pair(spark, r, s), spec)
    assert sorted(tuple(p) for p in found.collect()) == sorted((i, j) for i, _, _, y in r for j, _, _, b in s if y is not None and b is not None and abs(f32(b) - f32(y)) < 10)
    cells = lambda rows: [int(y // 10) for *_, y in rows[:1500]]
    met = sum(abs(p - q) <= 1 for p in cells(r) for q in cells(s))
    assert met < 2 * found.count()


@pytest.mark.parametrize(("predicate", "n"), [(Predicate.KEY, 7680), (Predicate.SUM_F32, 3840), (Predicate.BAND, 141738)])
def test_linear_counts(spark, predicate, n):
    one = streams.linear_stream(spark, 3840, 32)
    assert window_join(*streams.generated_pair(one, one), JoinSpec(predicate, 10, 10)).count() == n


@pytest.mark.parametrize(("predicate", "files", "w_s"), [(Predicate.KEY, 1, 5), (Predicate.KEY, 4, 9), (Predicate.BAND, 2, 5), (Predicate.SUM_INT, 8, 3)])
def test_streaming_is_batch(spark, tmp_path, predicate, files, w_s):
    rng = random.Random(3)
    r, s = rows(rng, 80), rows(rng, 80)
    spec = JoinSpec(predicate, 5, w_s, strict=False)
    left, right = pair(spark, r, s)
    for name, df, ts in (("r", left, "r_ts"), ("s", right, "s_ts")):
        in_time_slices(df, ts, f"file://{tmp_path}/{name}", files)
    joined = stream_join(file_stream(spark, left, f"file://{tmp_path}/r"), file_stream(spark, right, f"file://{tmp_path}/s"), spec, "1 second")
    found, query = run_available(joined, f"file://{tmp_path}/run")
    assert sorted(tuple(p) for p in found.collect()) == brute(r, s, spec)
    if files == 8:
        assert sum(p["evicted"] for p in progress_table(query)) > 0
    with pytest.raises(ValueError):
        stream_join(left, right, JoinSpec(window=Window.NONE))


def test_hash_and_generators(spark):
    from pyspark.sql import functions as F

    keys = spark.createDataFrame([(0,), (1,), (42,), (-1,), (2**31 - 1,)], "k int")
    assert [r[0] for r in keys.where("k in (0, 1, 42)").select(murmur3(F.col("k"), 1)).collect()] == [2028806445, 1578231156, 104498563]
    assert keys.where(murmur3(F.col("k"), 42) != F.expr("hash(k) & 4294967295L")).count() == 0
    assert keys.where(bucket(F.col("k"), 16) > 15).count() == 0
    with pytest.raises(ValueError):
        bucket(F.col("k"), 12)
    made = streams.hashed_stream(spark, 500, 10, 7, 9)
    assert made.where("x < 0 OR x >= 7 OR y < 0 OR y >= 9").count() == 0 and made.exceptAll(streams.hashed_stream(spark, 500, 10, 7, 9)).count() == 0
    again = streams.replayed(streams.linear_stream(spark, 10, 5), 4, 5, 10).orderBy("id").collect()
    assert [r.source_id for r in again] == [0, 1, 2, 3, 0, 1, 2, 3, 0, 1] and [r.t_ns for r in again] == [(i + 1) * SECOND // 5 for i in range(10)]
    assert streams.rate_stream(spark, 5, 10).isStreaming and streams.random_stream(spark, 20, 5, 3, 3).where("x > 2").count() == 0


def test_experiments(spark):
    assert abs(highest_rate(lambda r: r <= 7300, 10, 100_000) - 7300) < 80 and highest_rate(lambda r: False, 10, 100) == 0
    assert next_range(1000, 1, 4)[0] < 2000 < next_range(1000, 1, 4)[1]
    assert processed_prefix(3840, 32) == (3776, 3808) and processed_prefix(1000, 7) == (987, 994)
    out = sweep([{"n": 5}, {"n": 7}], lambda n: spark.range(n))
    assert [o["rows"] for o in out] == [5, 7]
