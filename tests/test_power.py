import pytest
from pyspark.sql import functions as F

from tidejoin.operators import power, stats
from tidejoin.operators.join import join_pairs
from tidejoin.plans.spec import JoinSpec
from tidejoin.sources.measurements import frequency_table, long_frequencies, power_log, wide_frequencies
from tidejoin.sources.streams import generated_pair, linear_stream


def samples(spark, values):
    return spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(values)], "channel string, t long, v double")


def test_power_log(spark, tmp_path):
    (tmp_path / "a.log").write_text("# comment\ntime  ch(V) ch(A) ch(W)\n1 2  3.0 4 0.5\n2 2 3.5  4 1.5\n3 2 x 4 2.5\n4 2 3")
    log = power_log(spark, f"file://{tmp_path}/a.log")
    assert log.count() == 5
    assert power.log_mean(log, 4).first()[0] == pytest.approx(4.5 / 5)
    body = power.without_last(log, "file", ["line"]).where("values[0] <> 'time'")
    assert tuple(power.log_column_means(body, 6).first()) == (2.0, 2.0, None, 4.0, 1.5, None)


def test_frequencies(spark, tmp_path):
    (tmp_path / "f.csv").write_text("freq, 1cpu, 2cpu\n100, 1.5, 2.5\n200, 1.75, 3.5\n")
    wide = frequency_table(spark, f"file://{tmp_path}/f.csv", "freq int, `1cpu` double, `2cpu` double")
    long = long_frequencies(wide)
    assert sorted(map(tuple, long.collect())) == [(100, "1cpu", 1.5), (100, "2cpu", 2.5), (200, "1cpu", 1.75), (200, "2cpu", 3.5)]
    assert sorted(map(tuple, wide_frequencies(long, ["1cpu", "2cpu"]).collect())) == sorted(map(tuple, wide.collect()))


def test_samples(spark):
    s = samples(spark, [0, 9, 9, 5, 1, 0, 9, 1, 9, 9])
    runs = power.triggered(s, "channel", ["t"], "v", on=8, off=2, least=2, before=1).orderBy("run").collect()
    assert [(r.run, r.n, r["first"], r["last"]) for r in runs] == [(1, 3, 1, 4), (2, 2, 8, 10)]
    assert [r.t for r in power.decimate(s, "channel", ["t"], 4).orderBy("t").collect()] == [3, 7]
    assert [r["mean"] for r in power.moving_average(s, "channel", ["t"], "v", 2).orderBy("t").limit(3).collect()] == [0, 4.5, 9]
    assert tuple(power.channel_ranges(s, "channel", F.col("v")).first()) == ("c", 0, 5.2, 9)
    curve = power.corrected(s, "v", [(0, 0), (5, 10), (9, 12)]).orderBy("t")
    assert [r.corrected for r in curve.limit(4).collect()] == [0, 12, 12, 10]
    two = s.union(samples(spark, [1, 2]).withColumn("channel", F.lit("d")))
    assert power.aligned(two, "channel", "t", "v", ["c", "d"]).count() == 2


def test_blocks_and_partitions_change_nothing(spark, monkeypatch):
    import random

    rng = random.Random(1)
    values = [rng.choice([0, 1, 5, 9]) for _ in range(200)]
    s = samples(spark, values).repartition(5)
    monkeypatch.setattr(power, "BLOCK", 17)
    found = {r.t: r["mean"] for r in power.moving_average(s, "channel", ["t"], "v", 6).collect()}
    assert found == {i: pytest.approx(sum(values[max(0, i - 5) : i + 1]) / min(i + 1, 6)) for i in range(200)}
    assert sorted(r.t for r in power.decimate(s, "channel", ["t"], 7).collect()) == list(range(6, 200, 7))
    state, runs = 0, []
    for i, v in enumerate(values, 1):
        was, state = state, 1 if v >= 8 else 0 if v < 2 else state
        if state and not was:
            runs.append([i, i])
        elif state:
            runs[-1][1] = i
    expected = [(b - a + 1, max(1, a - 2), b) for a, b in runs if b - a + 1 >= 2]
    got = power.triggered(s, "channel", ["t"], "v", on=8, off=2, least=2, before=2).orderBy("run").collect()
    assert [(r.n, r["first"], r["last"]) for r in got] == expected


def test_report(spark, tmp_path):
    one = linear_stream(spark, 640, 32)
    r, s = generated_pair(one, one)
    found = stats.run_stats(r, s, join_pairs(r, s, JoinSpec(w_r=10, w_s=10)), 32)
    rows = stats.report(found, F.lit(20 * 10**9), F.lit(10 * 10**9), F.lit(3))
    for _ in range(2):
        stats.write_report(rows, f"file://{tmp_path}/report")
    back = spark.read.csv(f"file://{tmp_path}/report", header=True, inferSchema=True)
    assert back.columns == ["out", "throughput", "latency_ms", "in", "runtime_ns", "idle_ns", "proc_ns", "switches"] and back.count() == 2
    assert tuple(stats.processing_rates(rows).select("proc_ns", "switches", "in_per_s").first()) == (10 * 10**9, 3, 128.0)


def test_run_statistics(spark):
    one = linear_stream(spark, 640, 32)
    r, s = generated_pair(one, one)
    pairs = join_pairs(r, s, JoinSpec(w_r=10, w_s=10))
    row = stats.run_stats(r, s, pairs, 32).first()
    assert (row.out_count, row.in_count, row.throughput) == (1280, 1280, 64.0) and row.latency_ms == pytest.approx(15.625)
    none = stats.run_stats(r.limit(0), s.limit(0), pairs.limit(0), 32).first()
    assert none.latency_ms is None and none.out_count == 0
    histogram = stats.output_histogram(pairs, 2).collect()
    assert sum(h.n for h in histogram) == 1280 and len(histogram) == 11
    assert tuple(stats.expired_counts(r, s, 5, 15).first()) == (480, 160)
    assert stats.table_buckets(10, 131072) == 65536 and stats.table_buckets(1, 1) == 1


def test_energy_report(spark):
    runs = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4, 5)], "config string, latency double, idle double, proc double, in_count long, out_count long")
    watts = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 1.0)], "config string, watts double")
    assert tuple(power.energy_report(runs, watts).first()) == ("a", 1.0, 2.0, 3.0, 3.0, 4, 5)
