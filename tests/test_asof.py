import bisect
import random

import pytest
from pyspark.sql import functions as F

from tidejoin.operators import running
from tidejoin.operators.asof import around, corrected_by_curve, zeroed
from tidejoin.operators.running import running_power


def tables(spark, seed, n=150, m=60):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, *range(40)])
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), pick(), i) for i in range(n)]
    table = [(rng.choice(["a", "a", "b", "d", None]), pick(), rng.randrange(99)) for _ in range(m)]
    return rows, table


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_nearest_rows(spark, parts):
    rows, table = tables(spark, parts)
    found = around(spark.createDataFrame(rows, "g string, x int, below int"), spark.createDataFrame(table, "g string, x int, v int"), ["g"], "x", "x", "under", "over", parts)
    assert found.columns == ["g", "x", "below", "under", "over"]
    best = {}
    for g, x, v in table:
        if x is not None:
            best[g, x] = max(v, best.get((g, x), -1))
    expected = []
    for g, x, i in rows:
        mine = sorted((of, v) for (h, of), v in best.items() if h == g) if x is not None else []
        at = bisect.bisect_right(mine, (x, 10**9)) if x is not None else 0
        expected.append((i, mine[at - 1] if at else None, mine[at] if at < len(mine) else None))
    got = [(r.below, r.under and tuple(r.under), r.over and tuple(r.over)) for r in found.collect()]
    assert sorted(got, key=lambda r: r[0]) == expected


def test_empty_sides(spark):
    rows, table = tables(spark, 1)
    r, t = spark.createDataFrame(rows, "g string, x int, i int"), spark.createDataFrame(table, "g string, x int, v int")
    assert around(r.limit(0), t, ["g"], "x", "x").count() == 0
    assert around(r, t.limit(0), ["g"], "x", "x", "u", "o").where("u IS NULL AND o IS NULL").count() == len(rows)


def test_curve_of_many_points(spark):
    rng = random.Random(2)
    curve = {"a": sorted({rng.randrange(10**6) / 100 for _ in range(10_000)}), "b": [5.0], "c": [1.0, 3.0]}
    true = {(c, x): rng.random() * 100 for c, xs in curve.items() for x in xs}
    samples = [(rng.choice("aaabcd"), rng.randrange(-(10**5), 11 * 10**5) / 100, i) for i in range(2000)] + [("a", curve["a"][7], 2000), ("a", None, 2001)]
    points = spark.createDataFrame([(c, x, t) for (c, x), t in true.items()], "channel string, measured double, true double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = corrected_by_curve(spark.createDataFrame(samples, "channel string, v double, i int"), points, "channel", "v").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) == len(samples)
    for r in found:
        xs = curve.get(r.channel, [])
        if r.v is None or not xs:
            assert r.corrected == r.v
        elif len(xs) == 1:
            assert r.corrected == pytest.approx(true[r.channel, xs[0]] + r.v - xs[0])
        else:
            k = min(max(bisect.bisect_right(xs, r.v) - 1, 0), len(xs) - 2)
            (x0, y0), (x1, y1) = ((x, true[r.channel, x]) for x in xs[k : k + 2])
            assert r.corrected == pytest.approx(y0 + (r.v - x0) * (y1 - y0) / (x1 - x0), rel=1e-9, abs=1e-6)


def test_zeros(spark):
    samples = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 9, 5.0), ("b", 2, 5.0)], "channel string, t int, v double")
    zeros = spark.createDataFrame([("a", 2, 0.5), ("a", 4, 1.0), ("c", 0, 9.0)], "channel string, t int, zero double")
    assert sorted((r.channel, r.t, r.zeroed) for r in zeroed(samples, zeros, "channel", "t", "v").collect()) == [("a", 1, 5.0), ("a", 2, 4.5), ("a", 9, 4.0), ("b", 2, 5.0)]


def test_running_power(spark, monkeypatch):
    monkeypatch.setattr(running, "BLOCK", 13)
    rng = random.Random(3)
    rows = [(c, i, rng.choice([None, rng.randrange(-9, 9) / 2]), rng.randrange(-4, 9) / 4) for c, n in (("a", 200), ("b", 5), (None, 30)) for i in range(n)]
    found = running_power(spark.createDataFrame(rows, "c string, i long, v double, a double").repartition(3), "c", "i", "v", "a").collect()
    seen = {(r.c, r.i): r for r in found}
    assert len(seen) == len(rows)
    for c in ("a", "b", None):
        past = {"v": [], "a": [], "w": []}
        for _, i, v, a in (r for r in rows if r[0] == c):
            for name, x in (("v", v), ("a", a), ("w", None if v is None else v * a)):
                past[name] += [] if x is None else [x]
                r = seen[c, i].asDict()
                got = (r[f"low_{name}"], r[f"mean_{name}"], r[f"high_{name}"])
                assert got == ((min(past[name]), pytest.approx(sum(past[name]) / len(past[name])), max(past[name])) if past[name] else (None, None, None))
    assert running_power(spark.createDataFrame([], "c string, i long, v double, a double"), "c", "i", "v", "a").count() == 0 and F
