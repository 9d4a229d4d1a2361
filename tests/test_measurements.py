"""Logs and tables written and read again, against what was written."""

import pytest
from pyspark.sql import functions as F

from tidejoin.operators import power
from tidejoin.sources.measurements import frequency_table, long_frequencies, power_log, wide_frequencies, write_frequencies, write_power_log

ROWS = [("a", 1, 0.1, "2.5", None), ("a", 2, None, "bad", "mark"), ("a", 3, 1e-7, "0.5", None), ("b", 4, 2.0, None, None), ("b", 4, 2.0, None, None), (None, 5, 1.0, "1.0", "m n")]


def test_logs_come_back(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "channel string, t long, volts double, watts string, note string").withColumn("line", F.lit("clash"))
    path = f"file://{tmp_path}/log"
    write_power_log(rows, path, "channel", ["t", "volts", "watts"], "time ch(V)  ch(W)", "note")
    log = power_log(spark, path)
    found = sorted(((r.channel, *r["values"]) for r in log.where("values[0] <> 'time'").collect()), key=repr)
    assert found == sorted(((c, str(t), "-" if v is None else {1e-7: "1.0E-7"}.get(v, str(v)), "-" if w is None else w) for c, t, v, w, _ in ROWS), key=repr)
    assert log.where("values[0] = 'time'").count() == 3  # a header for each channel
    means = {r.channel: (r.n, r.n_bad, r["mean"], r.high) for r in power.log_means(log, "channel", 2).collect()}
    assert means == {"a": (3, 1, 1.0, 2.5), "b": (2, 2, 0.0, None), None: (1, 0, 1.0, 1.0)}
    volts = {r.channel: r["mean"] for r in power.log_means(log, "channel", 1).collect()}
    assert volts["a"] == pytest.approx((0.1 + 0 + 1e-7) / 3)


def test_empty_logs_and_short_lines(spark, tmp_path):
    (tmp_path / "x.log").write_text("\n# only a comment\n   \ntime  V\n1\n2  3.5\n")
    log = power_log(spark, f"file://{tmp_path}/x.log").withColumn("k", F.lit(1))
    assert [tuple(r) for r in power.log_means(log, "k", 1).collect()] == [(1, 2, 1, 1.75, 3.5)]
    none = spark.createDataFrame([], "channel string, t long, watts string")
    write_power_log(none, f"file://{tmp_path}/none", "channel", ["t", "watts"], "time W")
    assert power_log(spark, f"file://{tmp_path}/none").count() == 0


def test_frequencies_come_back(spark, tmp_path):
    rows = [(100, "1 cpu", 1.5), (100, "b", None), (200, "b", 3.25), (300, "1 cpu", -1e-9)]
    wide = wide_frequencies(spark.createDataFrame(rows, "freq int, config string, W double"), ["1 cpu", "b", "none"])
    schema = write_frequencies(wide, f"file://{tmp_path}/f")
    back = frequency_table(spark, f"file://{tmp_path}/f", schema)
    assert sorted(map(tuple, back.collect())) == [(100, 1.5, None, None), (200, None, 3.25, None), (300, -1e-9, None, None)]
    assert sorted(map(tuple, long_frequencies(back).where("W IS NOT NULL").collect())) == sorted(r for r in rows if r[2] is not None)
