import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidejoin.operators import sessions as S
from tidejoin.operators.sessions import Trigger, sessions
from tidejoin.streaming.join import file_stream, run_available
from tidejoin.streaming.sessions import Machine, rocksdb, stream_sessions

START = dt.datetime(2024, 1, 1)
SPECS = [
    Trigger(8, 2), Trigger(8, 8, 1, 0, 2, 3), Trigger(8, 2, 2, 3, 2, 4, 50), Trigger(5, 5, 0, 2, 1, 2, 30), Trigger(5, 2, 1, 0, 3, 0, 9),
    Trigger(5, 1, 0, 100, 1, 9), Trigger(9, 1, 3, 1, 4, 6, 20),
]


def brute(values, spec):
    """[(trigger, first, last, n, total, ended)] of [(second, value)], sample by sample."""
    out, above, below, begun, start = [], 0, 0, 0, None
    for i, (at, v) in enumerate(values):
        if i and at - values[i - 1][0] > spec.silence:
            if start is not None:
                out.append((start, i - 1, begun, True))
            above, below, begun, start = 0, 0, i, None
        above = above + 1 if v is not None and v >= spec.on else 0
        below = below + 1 if v is not None and v < spec.off else 0
        if start is None:
            if above > spec.filter:
                start = i
        elif below >= spec.end_filter:
            out.append((start, i - 1, begun, True))
            begun, start = i, None
    if start is not None:
        out.append((start, len(values) - 1, begun, False))
    rows = []
    for trigger, last, begun, ended in out:
        first = max(begun, trigger - spec.before)
        captured = [*range(first, trigger), *range(trigger + spec.hold, last + 1)]
        rows.append((trigger, first, last, len(captured), sum(values[k][1] or 0 for k in captured), ended))
    return rows


def noisy(seed, n=400):
    rng = random.Random(seed)
    at, out, level = 0, [], 0
    for _ in range(n):
        at += rng.choice([1, 1, 1, 2, rng.choice([1, 25, 60])])
        level = rng.choice([level, level, rng.randrange(11)])
        out.append((at, None if rng.random() < 0.02 else float(level)))
    return out


def table(spark, channels):
    rows = [(c, START + dt.timedelta(seconds=at), i, v) for c, values in channels.items() for i, (at, v) in enumerate(values)]
    return spark.createDataFrame(rows, "channel string, ts timestamp, number long, value double")


def expected(channels, spec, ended=None):
    return sorted((c, *row[:5]) for c, values in channels.items() for row in brute(values, spec) if ended is None or row[5] or ended(c))


@pytest.mark.parametrize("spec", SPECS)
def test_table_matches_brute_force(spark, monkeypatch, spec):
    monkeypatch.setattr(S, "BLOCK", 17)
    channels = {"a": noisy(1), "b": noisy(2, 90), "c": [(5, 9.0)], "d": [(1, None), (2, 9.0), (3, 9.0), (4, 9.0), (5, 9.0), (9, 0.0)]}
    found = sessions(table(spark, channels).repartition(3), spec)
    assert found.columns == ["channel", "trigger", "first", "last", "n", "total"]
    assert sorted(map(tuple, found.collect())) == expected(channels, spec)


@pytest.mark.parametrize("spec", SPECS)
def test_machine_matches_brute_force(spec):
    values = noisy(3, 2000)
    machine, found = Machine(spec, None, []), []
    for i, (at, v) in enumerate(values):
        found += machine.add(i, at * 1_000_000, v)
        machine = Machine(spec, machine.state(), machine.ring)  # as after each micro-batch
        assert machine.add(i, at * 1_000_000, v) == []  # a sample that comes again
    found += machine.silence()
    assert found == [row[:5] for row in brute(values, spec)]


@pytest.mark.parametrize(("spec", "files"), [(SPECS[2], 1), (SPECS[6], 6)])
def test_stream_is_the_table(spark, tmp_path, spec, files):
    channels = {"a": noisy(4, 150), "b": noisy(5, 80), "quiet": [(3, 9.0), (4, 9.0), (5, 9.0), (6, 9.0)]}
    t = table(spark, channels)
    end = max(at for v in channels.values() for at, _ in v)
    for k in range(files):  # slices of time, in order
        low, high = (START + dt.timedelta(seconds=end * x / files + (x == files)) for x in (k, k + 1))
        part = t.where(F.col("ts").between(F.lit(low), F.lit(high)) & ((F.col("ts") > F.lit(low)) | F.lit(k == 0)))
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    with rocksdb(spark):
        found, query = run_available(stream_sessions(file_stream(spark, t, f"file://{tmp_path}/in"), spec, "1 second"), f"file://{tmp_path}/run")
    silent = {c: v[-1][0] + spec.silence < end - 1 for c, v in channels.items()}
    rows = sorted(map(tuple, found.collect()))
    assert rows == expected(channels, spec, silent.get)
    until = F.lit(START + dt.timedelta(seconds=end - 1))
    assert sorted(map(tuple, sessions(t, spec, until).collect())) == rows
    assert silent["quiet"] and sum(o["numRowsTotal"] for o in query.recentProgress[-1]["stateOperators"]) <= 3 * (1 + spec.before + 3)


def test_odd_and_empty(spark):
    assert sessions(table(spark, {}), SPECS[0]).count() == 0
    for wrong in ({"on": 1, "off": 2}, {"on": 2, "off": 1, "hold": -1}, {"on": 2, "off": 1, "end_filter": 0}):
        with pytest.raises(ValueError):
            Trigger(**wrong)
