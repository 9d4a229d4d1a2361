"""Queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidejoin.operators import power, stats
from tidejoin.operators.asof import corrected_by_curve, zeroed
from tidejoin.operators.join import join_pairs, window_join
from tidejoin.operators.places import placed
from tidejoin.operators.running import running_power
from tidejoin.operators.sessions import Trigger, sessions
from tidejoin.plans.spec import JoinSpec, Predicate, Window
from tidejoin.sources import measurements, streams
from tidejoin.sources.shared import own_folder
from tidejoin.streaming.join import paced_join, replay_join
from tidejoin.streaming.progress import paced_latency
from tidejoin.streaming.running import paced_histogram, paced_state
from tidejoin.streaming.sessions import replay_sessions
from tidejoin.streaming.sweep import Setting, paced_sweep, with_energy

HOUR = 3600
JOINS = {
    "window_key_join": JoinSpec(Predicate.KEY, HOUR, HOUR),
    "window_key_join_incl": JoinSpec(Predicate.KEY, HOUR, HOUR, strict=False),
    "window_key_join_asym": JoinSpec(Predicate.KEY, 2 * HOUR, HOUR),
    "batch_one_sided_join": JoinSpec(Predicate.KEY, HOUR, HOUR, window=Window.ONE_SIDED),
    "batch_unwindowed_band": JoinSpec(Predicate.BAND, HOUR, HOUR, window=Window.NONE),
    "band_join": JoinSpec(Predicate.BAND, HOUR, HOUR, strict=False),
    "sum_join_f32": JoinSpec(Predicate.SUM_F32, 24 * HOUR, 24 * HOUR, strict=False),
    "sum_join_trunc": JoinSpec(Predicate.SUM_TRUNC, HOUR, HOUR, strict=False),
    "sum_join_int": JoinSpec(Predicate.SUM_INT, HOUR, HOUR, strict=False),
}
LINEAR = {"linear_key_join": Predicate.KEY, "linear_sum_join": Predicate.SUM_F32, "linear_band_join": Predicate.BAND}
ROWS, RATE, LINEAR_WINDOW, CAP = 3840, 32, 10, 1000
BUCKETS, FANOUT = 1024, 64
#: Rows of R and S in a batch of a paced replay, and ticks in a micro-batch.
R_ROWS, S_ROWS, TICKS = 1_000, 1_500, 4
TRIGGER = Trigger(on=60.0, off=40.0, filter=1, hold=1, end_filter=2, before=3, silence=6 * HOUR)
#: Configurations of a sweep: batches in a micro-batch, and a wider window with smaller batches.
SWEEP = {
    "ticks4": Setting(JOINS["window_key_join"], R_ROWS, S_ROWS, 4),
    "ticks1": Setting(JOINS["window_key_join"], R_ROWS, S_ROWS, 1),
    "wide": Setting(JOINS["window_key_join_asym"], 700, 1_100, 3),
}
CHANNELS = ["view", "click", "purchase", "signup", "error"]
#: How late rows of a stream may come, in minutes.
DELAY = 10

Query = Callable[[SparkSession, str], DataFrame]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return streams.events_as_streams(_events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value"))


def _batch(spec: JoinSpec) -> Query:
    return lambda spark, sf_dir: window_join(*_pair(spark, sf_dir), spec)


def _stream(spec: JoinSpec) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = _events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
        return replay_join(events, streams.events_as_streams, spec)[0]

    return run


def _linear(predicate: Predicate) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = streams.linear_stream(spark, ROWS, RATE)
        return window_join(*streams.generated_pair(one, one), JoinSpec(predicate, LINEAR_WINDOW, LINEAR_WINDOW))

    return run


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "ts", F.col("event_type").alias("channel"), "value")


def _paced(spec: JoinSpec) -> Query:
    return lambda spark, sf_dir: paced_join(*_pair(spark, sf_dir), spec, R_ROWS, S_ROWS, TICKS, f"{DELAY} minutes")[0]


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).select("channel", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    return placed(rows, ["channel"], [F.col("ts"), F.col("event_id")], "number").drop("event_id")


def _cut(c: str) -> Column:
    """Four decimals, cut where neither exact values nor their rounding errors fall."""
    return (F.floor(F.col(c) * 10_000 + 0.12345) / 10_000.0).alias(c)


def _corrected_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the events as points of their channel's curve, a tenth as its zeros, the others as samples."""
    rows = _samples(spark, sf_dir)
    kind = F.col("event_id") % 10
    points = rows.where(kind == 3).select("channel", F.col("value").alias("measured"), (F.col("value") * 1.1 + F.col("event_id") % 7 / 10.0).alias("true"))
    zeros = rows.where(kind == 5).select("channel", "ts", (F.col("event_id") % 13 / 10.0).alias("zero"))
    found = corrected_by_curve(zeroed(rows.where(~kind.isin(3, 5)), zeros, "channel", "ts", "value"), points, "channel", "zeroed")
    return found.select("event_id", _cut("zeroed"), _cut("corrected"))


def _running_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as volts, and currents from the ids."""
    rows = placed(_samples(spark, sf_dir), ["channel"], [F.col("ts"), F.col("event_id")], "number").withColumn("amperes", F.col("event_id") % 50 / 10.0)
    found = running_power(rows, "channel", "number", "value", "amperes")
    return found.select("event_id", *(_cut(c) for c in found.columns if c.split("_")[0] in ("low", "mean", "high")))


def _sessions(found: DataFrame) -> DataFrame:
    return found.select("channel", "trigger", "first", "last", "n", F.round("total", 4).alias("total"))


def _run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = _pair(spark, sf_dir)
    return stats.run_stats(r, s, join_pairs(r, s, JOINS["window_key_join"]), rate_r=RATE)


def _run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run that took as long as its stream and idled where seconds have no row of either stream."""
    r, s = _pair(spark, sf_dir)
    seconds = r.select(F.floor(F.col("r_t") / 1_000_000_000).alias("at")).union(s.select(F.floor(F.col("s_t") / 1_000_000_000)))
    busy = seconds.agg(F.countDistinct("at").alias("busy"), (F.max("at") - F.min("at") + 1).alias("whole"))
    found = stats.run_stats(r, s, join_pairs(r, s, JOINS["window_key_join"]), rate_r=RATE).crossJoin(busy)  # one row each
    nanos = F.lit(1_000_000_000).cast("long")
    return stats.processing_rates(stats.report(found, F.col("whole") * nanos, (F.col("whole") - F.col("busy")) * nanos, F.lit(0).cast("long")))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = power.numbered(_samples(spark, sf_dir), "channel", ["ts", "event_id"])
    return power.aligned(rows, "channel", "number", "value", ["view", "click"])


def _table_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of the join's table for windows of 1 to 600 seconds at rates of 32 to 131,072 rows a second."""
    grid = [(w, rate, stats.table_buckets(w, rate)) for w in (1, 10, 60, 600) for rate in (32, 1024, 131_072)]
    return spark.createDataFrame(grid, "window_s int, rate int, buckets long")


def _power_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return power.without_last(_samples(spark, sf_dir), "channel", ["ts", "event_id"]).select("channel", "event_id")


def _moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = power.moving_average(_samples(spark, sf_dir), "channel", ["ts", "event_id"], "value", 5)
    return rows.select("event_id", F.round("mean", 6).alias("mean"))


def _power_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples as a log of five fields, every seventh power field being no number."""
    rows = _events(spark, sf_dir).select(F.array(F.col("event_id").cast("string"), F.lit("1"), F.lit("2"), F.lit("3"), F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.floor("value").cast("string"))).alias("values"))
    return rows


def _energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    runs = events.groupBy(F.col("event_type").alias("config")).agg(F.count("*").alias("in_count"), F.countDistinct("user_id").alias("out_count"), F.min("event_id").alias("latency"), F.max("event_id").alias("proc"))
    watts = events.select(F.col("event_type").alias("config"), F.floor("value").alias("watts"))
    found = power.energy_report(runs.withColumn("idle", F.lit(0).cast("long")), watts)
    return found.withColumn("energy", F.round("energy", 6))


def _energy_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of a join with their energy, the events' values dealt to the runs by id; the machine's own times are left out."""
    names = list(SWEEP)
    config = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("event_id") % len(names) + 1).cast("int"))
    watts = _events(spark, sf_dir).select(config.alias("config"), F.col("value").alias("watts"))
    found = with_energy(paced_sweep(*_pair(spark, sf_dir), SWEEP, f"{DELAY} minutes", at_once=len(SWEEP)), watts)
    return found.select("config", "latency", _cut("energy"), "in_count", "out_count")


def _power_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as logs of time, volts, amperes and watts, and what these logs hold; every seventh line has no watts."""
    amperes = F.col("event_id") % 50 / 10.0
    watts = F.when(F.col("event_id") % 7 == 0, "bad").otherwise((F.col("value") * amperes).cast("string"))
    rows = _samples(spark, sf_dir).select("channel", "event_id", "value", amperes.alias("amperes"), watts.alias("watts"), F.when(F.col("event_id") % 50 == 0, "mark").alias("note"))
    path = own_folder(spark, "power-log")
    measurements.write_power_log(rows, path, "channel", ["event_id", "value", "amperes", "watts"], "time  ch(V) ch(A) ch(W)", "note")
    return power.log_means(measurements.power_log(spark, path), "channel", 3).select("channel", "n", "n_bad", _cut("mean"), _cut("high"))


def _power_by_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of mean values by frequency (made from user ids), written as CSV, and read as a long one."""
    freq = ((F.col("user_id") % 14 + 1) * 100).cast("int")
    rows = _events(spark, sf_dir).groupBy(freq.alias("freq"), F.col("event_type").alias("config")).agg(F.avg("value").alias("W"))
    path = own_folder(spark, "power-by-freq")
    schema = measurements.write_frequencies(measurements.wide_frequencies(rows, CHANNELS), path)
    return measurements.long_frequencies(measurements.frequency_table(spark, path, schema)).where("W IS NOT NULL").select("freq", "config", _cut("W"))


QUERIES: dict[str, Query] = {
    **{name: _batch(spec) for name, spec in JOINS.items()},
    **{f"{name}_stream": _stream(spec) for name, spec in JOINS.items() if spec.window is not Window.NONE},
    **{name: _linear(p) for name, p in LINEAR.items()},
    "gen_linear": lambda spark, sf_dir: streams.linear_stream(spark, ROWS, RATE),
    "gen_hash_keys": lambda spark, sf_dir: streams.hashed_stream(spark, ROWS, RATE, 1000, 1000),
    "replay_offset": lambda spark, sf_dir: streams.replayed(streams.linear_stream(spark, ROWS, RATE), CAP, RATE, ROWS),
    "run_stats": _run_stats,
    "run_report": _run_report,
    "power_aligned": _aligned,
    "table_sizing": _table_sizing,
    "output_histogram": lambda spark, sf_dir: stats.output_histogram(join_pairs(*_pair(spark, sf_dir), JOINS["window_key_join"]), HOUR),
    "expired_tuples": lambda spark, sf_dir: stats.expired_counts(*_pair(spark, sf_dir), HOUR, 24 * HOUR),
    "bucket_occupancy": lambda spark, sf_dir: stats.bucket_occupancy(_events(spark, sf_dir), "user_id", BUCKETS),
    "radix_partition": lambda spark, sf_dir: stats.radix_partitions(_events(spark, sf_dir), "user_id", FANOUT),
    "power_avg": lambda spark, sf_dir: power.log_mean(_power_log(spark, sf_dir)).select(F.round("mean", 6).alias("mean")),
    "power_col_means": lambda spark, sf_dir: power.log_column_means(_power_log(spark, sf_dir), 5),
    "power_trim": _power_trim,
    "power_minmaxavg": lambda spark, sf_dir: power.channel_ranges(_samples(spark, sf_dir), "channel", F.col("value")).withColumn("mean", F.round("mean", 6)),
    "moving_avg": _moving_avg,
    "decimate": lambda spark, sf_dir: power.decimate(_samples(spark, sf_dir), "channel", ["ts", "event_id"], 5).select("channel", "event_id"),
    "power_trigger": lambda spark, sf_dir: power.triggered(_samples(spark, sf_dir), "channel", ["ts", "event_id"], "value", 60.0, 20.0, least=2, before=3),
    "power_corrected": lambda spark, sf_dir: power.corrected(_samples(spark, sf_dir), "value", [(0.0, 0.0), (50.0, 40.0), (100.0, 120.0)], 0.5, 1.0).select("event_id", F.round("corrected", 6).alias("corrected")),
    "energy_report": _energy,
    "energy_sweep_paced": _energy_sweep,
    "power_log_files": _power_log_files,
    "power_by_freq": _power_by_freq,
    "window_key_join_paced": _paced(JOINS["window_key_join_asym"]),
    "band_join_paced": _paced(JOINS["band_join"]),
    "power_corrected_table": _corrected_by_table,
    "power_running": _running_power,
    "pair_latency_paced": lambda spark, sf_dir: paced_latency(*_pair(spark, sf_dir), JOINS["window_key_join"], R_ROWS, S_ROWS, TICKS, f"{DELAY} minutes"),
    "power_sessions": lambda spark, sf_dir: _sessions(sessions(_numbered(spark, sf_dir), TRIGGER)),
    "power_sessions_stream": lambda spark, sf_dir: _sessions(replay_sessions(_numbered(spark, sf_dir), TRIGGER, delay=f"{DELAY} minutes")),
    "output_histogram_stream": lambda spark, sf_dir: paced_histogram(*_pair(spark, sf_dir), JOINS["window_key_join"], HOUR, R_ROWS, S_ROWS, TICKS)[0],
    "join_state": lambda spark, sf_dir: paced_state(*_pair(spark, sf_dir), JOINS["window_key_join_asym"], R_ROWS, S_ROWS, TICKS, f"{DELAY} minutes"),
}

_R = "r AS (SELECT event_id AS r, epoch_us(ts) * 1000 AS t, user_id AS x, value AS y FROM events WHERE event_type = 'view')"
_S = "s AS (SELECT event_id AS s, epoch_us(ts) * 1000 AS t, user_id AS a, value AS b FROM events WHERE event_type = 'click')"
_MATCH = {
    Predicate.KEY: "x = a",
    Predicate.SUM_F32: "x::FLOAT + y::FLOAT = a::FLOAT + b::FLOAT",
    Predicate.SUM_TRUNC: "trunc(x::FLOAT + y::FLOAT) = trunc(a::FLOAT + b::FLOAT)",
    Predicate.SUM_INT: "(x + trunc(y)::BIGINT) % 4294967296 = (a + trunc(b)::BIGINT) % 4294967296 AND (x + trunc(y)::BIGINT) % 4294967296 <> 0",
    Predicate.BAND: "abs(a - x) < 10 AND abs(b - y) < 10",
}


def _join_sql(spec: JoinSpec, tables: str = f"{_R}, {_S}") -> str:
    less = "<" if spec.strict else "<="
    parts = [_MATCH[spec.predicate]]
    if spec.window is not Window.NONE:
        parts.append(f"s.t {less} r.t + {spec.w_r * 1_000_000_000}::BIGINT")
    if spec.window is Window.SYMMETRIC:
        parts.append(f"r.t {less} s.t + {spec.w_s * 1_000_000_000}::BIGINT")
    return f"WITH {tables} SELECT r, s FROM r JOIN s ON {' AND '.join(parts)}"


_LINEAR_ROWS = f"SELECT i AS id, (i + 1) * {1_000_000_000 // RATE} AS t_ns, (i // 2 + 1)::INTEGER AS x, ((i + 1) // 2)::FLOAT AS y FROM range({ROWS}) q(i)"
_LINEAR_PAIR = f"r AS (SELECT id AS r, t_ns AS t, x, y FROM ({_LINEAR_ROWS})), s AS (SELECT id AS s, t_ns AS t, x AS a, y AS b FROM ({_LINEAR_ROWS}))"
_PAIRS = f"{_R}, {_S}, p AS (SELECT r.t AS rt, s.t AS st FROM r JOIN s ON x = a AND s.t < r.t + 3600000000000::BIGINT AND r.t < s.t + 3600000000000::BIGINT)"
_NUMBERED = "n AS (SELECT event_type AS channel, event_id, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS number FROM events)"
_M = 4294967296


def _sessions_sql(t: Trigger, until: str) -> str:
    """Sessions of the events' values, channel by channel; until: what has to hold of a session's last sample and the channel's last (m)."""
    so_far = "OVER (PARTITION BY channel ORDER BY number ROWS UNBOUNDED PRECEDING)"
    return f"""WITH n AS (SELECT event_type AS channel, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS number FROM events),
 a AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY channel ORDER BY number)) > {t.silence}000000, true) AS fresh FROM n),
 b AS (SELECT *, max(CASE WHEN value IS NULL OR value < {t.on} THEN number WHEN fresh THEN number - 1 END) {so_far} AS not_on,
   max(CASE WHEN value IS NULL OR value >= {t.off} THEN number WHEN fresh THEN number - 1 END) {so_far} AS not_off FROM a),
 c AS (SELECT *, coalesce(last_value(CASE WHEN value >= {t.on} AND number - not_on > {t.filter} THEN 1 WHEN fresh OR (value < {t.off} AND number - not_off >= {t.end_filter}) THEN 0 END IGNORE NULLS) {so_far}, 0) AS state FROM b),
 d AS (SELECT *, CASE WHEN fresh THEN 0 ELSE coalesce(lag(state) OVER (PARTITION BY channel ORDER BY number), 0) END AS was FROM c),
 e AS (SELECT *, max(CASE WHEN state = 1 AND was = 0 THEN number END) {so_far} AS fired, max(CASE WHEN fresh OR (state = 0 AND was = 1) THEN number END) {so_far} AS begun, max(number) OVER (PARTITION BY channel) AS m FROM d),
 f AS (SELECT channel, fired, max(number) AS l, max(ts) AS l_ts, count(*) FILTER (number - fired >= {t.hold}) AS n, coalesce(sum(value) FILTER (number - fired >= {t.hold}), 0) AS total, greatest(fired - {t.before}, max(begun)) AS f, max(m) AS m
   FROM e WHERE state = 1 GROUP BY channel, fired),
 p AS (SELECT f.channel, fired, count(*) AS n, sum(value) AS total FROM f JOIN n ON f.channel = n.channel AND n.number >= f.f AND n.number < fired GROUP BY 1, 2)
SELECT f.channel, f.fired AS trigger, f.f AS first, f.l AS last, f.n + coalesce(p.n, 0) AS n, round(f.total + coalesce(p.total, 0), 4) AS total FROM f LEFT JOIN p ON f.channel = p.channel AND f.fired = p.fired WHERE {until}"""



def _latency_sql(of: Setting) -> str:
    """Pairs of a paced run with their latency on the stream's clock."""
    return f"""WITH {_R}, {_S},
 a AS (SELECT 1 AS is_r, r AS id, t, row_number() OVER (ORDER BY t, r) - 1 AS no, count(*) OVER () AS n, {of.r_rows} AS size FROM r UNION ALL SELECT 0, s, t, row_number() OVER (ORDER BY t, s) - 1, count(*) OVER (), {of.s_rows} FROM s),
 b AS (SELECT is_r, no // size - 1 AS batch, t AS due FROM a WHERE no > 0 AND no % size = 0 UNION ALL SELECT is_r, no // size, t FROM a WHERE no = n - 1),
 k AS (SELECT *, row_number() OVER (ORDER BY due, is_r, batch) - 1 AS tick FROM b), m AS (SELECT tick // {of.ticks} AS batch, max(due) AS end_ns FROM k GROUP BY 1),
 e AS (SELECT a.is_r, a.id, a.t, k.tick // {of.ticks} AS batch FROM a JOIN k ON a.is_r = k.is_r AND a.no // a.size = k.batch)
SELECT p.r, p.s, m.batch, m.end_ns - greatest(er.t, es.t) AS latency_ns FROM ({_join_sql(of.spec, "one AS (SELECT 1)")}) p
 JOIN e er ON er.is_r = 1 AND er.id = p.r JOIN e es ON es.is_r = 0 AND es.id = p.s JOIN m ON m.batch = greatest(er.batch, es.batch)"""


def _sweep_sql(settings: dict[str, Setting]) -> str:
    """The report of each run, and the mean of the events' values dealt to it."""
    runs = " UNION ALL ".join(f"SELECT '{name}' AS config, {k} AS k, round(avg(latency_ns) / 1e6, 3) AS latency, count(*) AS out_count FROM ({_latency_sql(of)})" for k, (name, of) in enumerate(settings.items()))
    return f"""WITH runs AS ({runs}), e AS (SELECT event_id % {len(settings)} AS k, avg(value) AS w FROM events GROUP BY 1)
SELECT config, latency, floor(e.w * 10000 + 0.12345::DOUBLE) / 10000 AS energy, (SELECT count(*) FROM events WHERE event_type IN ('view', 'click')) AS in_count, out_count FROM runs LEFT JOIN e USING (k)"""


def _murmur_sql(source: str, key: str, seed: int, tag: str = "") -> str:
    """Steps whose last one, h6 with the tag, has the hashes h of a key, by row i."""
    t = tag
    return f"""k1{t} AS (SELECT i, (({key} & 4294967295)::HUGEINT * 3432918353 % {_M})::BIGINT AS k FROM {source}),
 k2{t} AS (SELECT i, (((k * 32768::HUGEINT) % {_M} + k // 131072) * 461845907 % {_M})::BIGINT AS k FROM k1{t}),
 h1{t} AS (SELECT i, xor(k, {seed}::BIGINT) AS h FROM k2{t}),
 h2{t} AS (SELECT i, ((((h * 8192::HUGEINT) % {_M} + h // 524288) * 5 + 3864292196) % {_M})::BIGINT AS h FROM h1{t}),
 h3{t} AS (SELECT i, xor(h, 4::BIGINT) AS h FROM h2{t}), h4{t} AS (SELECT i, (xor(h, h // 65536)::HUGEINT * 2246822507 % {_M})::BIGINT AS h FROM h3{t}),
 h5{t} AS (SELECT i, (xor(h, h // 8192)::HUGEINT * 3266489909 % {_M})::BIGINT AS h FROM h4{t}), h6{t} AS (SELECT i, xor(h, h // 65536) AS h FROM h5{t})"""


_MURMUR = _murmur_sql("(SELECT event_id AS i, user_id FROM events WHERE user_id IS NOT NULL)", "user_id", 1)

_HISTOGRAM_SQL = f"WITH {_PAIRS}, h AS (SELECT greatest(rt, st) // 3600000000000 AS slot, count(*) AS n FROM p GROUP BY 1), e AS (SELECT unnest(range(min(slot), max(slot) + 1)) AS slot FROM h) SELECT e.slot, coalesce(h.n, 0) AS n FROM e LEFT JOIN h USING (slot)"

ORACLE_SQL: dict[str, str] = {
    **{name: _join_sql(spec) for name, spec in JOINS.items()},
    **{f"{name}_stream": _join_sql(spec) for name, spec in JOINS.items() if spec.window is not Window.NONE},
    **{name: _join_sql(JoinSpec(p, LINEAR_WINDOW, LINEAR_WINDOW), _LINEAR_PAIR) for name, p in LINEAR.items()},
    "gen_linear": _LINEAR_ROWS,
    "gen_hash_keys": f"""WITH {_murmur_sql(f"range({ROWS}) q(i)", "i", 1, "x")}, {_murmur_sql(f"range({ROWS}) q(i)", "i", 2, "y")}
SELECT h6x.i AS id, (h6x.i + 1) * {1_000_000_000 // RATE} AS t_ns, (h6x.h % 1000)::INTEGER AS x, (h6y.h % 1000)::FLOAT AS y FROM h6x JOIN h6y USING (i)""",
    "replay_offset": f"SELECT i AS id, i // {CAP} AS iteration, i % {CAP} AS source_id, (i % {CAP} + 1 + i // {CAP} * {CAP}) * {1_000_000_000 // RATE} AS t_ns, (i % {CAP} // 2 + 1)::INTEGER AS x, ((i % {CAP} + 1) // 2)::FLOAT AS y FROM range({ROWS}) q(i)",
    "run_stats": f"""WITH {_PAIRS}, o AS (SELECT count(*) AS n, sum(abs(rt - st))::DOUBLE AS lag FROM p), c AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM s) AS ns)
SELECT n AS out_count, nr + ns AS in_count, n::DOUBLE / (nr / {RATE}.0::DOUBLE) AS throughput, (nr + ns) * 0.000016::DOUBLE / (nr / {RATE}.0::DOUBLE) AS mb_per_s, round(lag / n / 1e6, 3) AS latency_ms FROM o, c""",
    "run_report": f"""WITH {_PAIRS}, o AS (SELECT count(*) AS n, sum(abs(rt - st))::DOUBLE AS lag FROM p), c AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM s) AS ns),
 b AS (SELECT count(DISTINCT sec) AS busy, max(sec) - min(sec) + 1 AS whole FROM (SELECT t // 1000000000 AS sec FROM r UNION ALL SELECT t // 1000000000 FROM s))
SELECT n AS out, n::DOUBLE / (nr / {RATE}.0::DOUBLE) AS throughput, round(lag / n / 1e6, 3) AS latency_ms, nr + ns AS "in", whole * 1000000000 AS runtime_ns, (whole - busy) * 1000000000 AS idle_ns, busy * 1000000000 AS proc_ns, 0::BIGINT AS switches,
 (nr + ns)::DOUBLE / busy AS in_per_s, (nr + ns)::DOUBLE / busy * 0.000016::DOUBLE AS proc_mb_per_s FROM o, c, b""",
    "power_aligned": f"WITH {_NUMBERED} SELECT a.number, a.value AS view, b.value AS click FROM n a JOIN n b ON a.number = b.number AND a.channel = 'view' AND b.channel = 'click'",
    "table_sizing": """WITH g AS (SELECT w, r, w * r / 64.0 AS chunks FROM (SELECT unnest([1, 10, 60, 600]) AS w), (SELECT unnest([32, 1024, 131072]) AS r)),
 s AS (SELECT *, (2 ** greatest(0, ceil(log2(greatest(1.0, chunks)))))::BIGINT AS size FROM g)
SELECT w AS window_s, r AS rate, CASE WHEN size < chunks / 0.2 THEN size * 2 ELSE size END AS buckets FROM s""",
    "output_histogram": _HISTOGRAM_SQL,
    "expired_tuples": f"WITH {_R}, {_S} SELECT (SELECT count(*) FROM r WHERE t + 3600000000000::BIGINT <= (SELECT max(t) FROM s)) AS r_expired, (SELECT count(*) FROM s WHERE t + 86400000000000::BIGINT <= (SELECT max(t) FROM r)) AS s_expired",
    "bucket_occupancy": f"WITH {_MURMUR} SELECT h & {BUCKETS - 1} AS bucket, count(*) AS n FROM h6 GROUP BY 1",
    "radix_partition": f"SELECT part, n, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM (SELECT user_id % {FANOUT} AS part, count(*) AS n FROM events GROUP BY 1)",
    "power_avg": "SELECT round(avg(CASE WHEN event_id % 7 = 0 THEN 0 ELSE floor(value) END), 6) AS mean FROM events",
    "power_col_means": "SELECT avg(event_id::DOUBLE) AS c0, 1.0::DOUBLE AS c1, 2.0::DOUBLE AS c2, 3.0::DOUBLE AS c3, CASE WHEN count(*) FILTER (event_id % 7 = 0) = 0 THEN avg(floor(value)) END AS c4 FROM events",
    "power_trim": f"WITH {_NUMBERED} SELECT channel, event_id FROM (SELECT *, max(number) OVER (PARTITION BY channel) AS m FROM n) WHERE number < m",
    "power_minmaxavg": "SELECT event_type AS channel, min(value) AS low, round(avg(value), 6) AS mean, max(value) AS high FROM events GROUP BY 1",
    "moving_avg": "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM events",
    "decimate": f"WITH {_NUMBERED} SELECT channel, event_id FROM n WHERE number % 5 = 0",
    "power_trigger": f"""WITH {_NUMBERED}, a AS (SELECT *, coalesce(last_value(CASE WHEN value >= 60 THEN 1 WHEN value < 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY number ROWS UNBOUNDED PRECEDING), 0) AS state FROM n),
 b AS (SELECT *, CASE WHEN state <> lag(state, 1, 0) OVER (PARTITION BY channel ORDER BY number) THEN 1 ELSE 0 END AS turn FROM a), c AS (SELECT *, sum(turn) OVER (PARTITION BY channel ORDER BY number) AS g FROM b),
 d AS (SELECT channel, count(*) AS n, min(number) AS f, max(number) AS l FROM c WHERE state = 1 GROUP BY channel, g HAVING count(*) >= 2)
SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY f)::INTEGER AS run, n, greatest(1, f - 3) AS first, l AS last FROM d""",
    "power_corrected": "SELECT event_id, round(CASE WHEN v < 50 THEN v * 0.8 ELSE 40 + (v - 50) * 1.6 END, 6) AS corrected FROM (SELECT event_id, (value - 1) * 0.5 AS v FROM events)",
    "window_key_join_paced": _join_sql(JOINS["window_key_join_asym"]),
    "band_join_paced": _join_sql(JOINS["band_join"]),
    "power_corrected_table": """WITH e AS (SELECT event_id, event_type AS channel, ts, value FROM events),
 p AS (SELECT channel, value AS m, max(value * 1.1::DOUBLE + event_id % 7 / 10.0::DOUBLE) AS t FROM e WHERE event_id % 10 = 3 AND value IS NOT NULL GROUP BY 1, 2),
 c AS (SELECT *, coalesce((lead(t) OVER w - t) / (lead(m) OVER w - m), (t - lag(t) OVER w) / (m - lag(m) OVER w), 1) AS slope FROM p WINDOW w AS (PARTITION BY channel ORDER BY m)),
 z AS (SELECT channel, ts, max(event_id % 13 / 10.0::DOUBLE) AS zero FROM e WHERE event_id % 10 = 5 GROUP BY 1, 2),
 v AS (SELECT e.event_id, e.channel, e.value - coalesce(z.zero, 0) AS x FROM e ASOF LEFT JOIN z ON e.channel = z.channel AND e.ts >= z.ts WHERE e.event_id % 10 NOT IN (3, 5)),
 l AS (SELECT channel, min(m) AS m FROM c GROUP BY 1), f AS (SELECT c.* FROM c JOIN l ON c.channel = l.channel AND c.m = l.m),
 b AS (SELECT v.*, c.m, c.t, c.slope FROM v ASOF LEFT JOIN c ON v.channel = c.channel AND v.x >= c.m)
SELECT b.event_id, floor(b.x * 10000 + 0.12345::DOUBLE) / 10000 AS zeroed, floor(CASE WHEN b.m IS NOT NULL THEN b.t + (b.x - b.m) * b.slope WHEN f.m IS NOT NULL THEN f.t + (b.x - f.m) * f.slope ELSE b.x END * 10000 + 0.12345::DOUBLE) / 10000 AS corrected FROM b LEFT JOIN f ON b.channel = f.channel""",
    "power_running": """WITH e AS (SELECT event_id, event_type AS channel, ts, value::DOUBLE AS v, event_id % 50 / 10.0::DOUBLE AS a, value * (event_id % 50 / 10.0::DOUBLE) AS w FROM events)
SELECT event_id, """
    + ", ".join(f"floor({f}({x}) OVER r * 10000 + 0.12345::DOUBLE) / 10000 AS {k}_{x}" for x in "vaw" for k, f in (("low", "min"), ("mean", "avg"), ("high", "max")))
    + " FROM e WINDOW r AS (PARTITION BY channel ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "pair_latency_paced": _latency_sql(Setting(JOINS["window_key_join"], R_ROWS, S_ROWS, TICKS)),
    "power_sessions": _sessions_sql(TRIGGER, "true"),
    "power_sessions_stream": _sessions_sql(TRIGGER, f"f.l < f.m OR epoch_us(f.l_ts) // 1000 + {TRIGGER.silence * 1000} < (SELECT epoch_us(max(ts)) // 1000 FROM events) - {DELAY * 60_000}"),
    "output_histogram_stream": _HISTOGRAM_SQL,
    "join_state": f"""WITH {_R}, {_S}, w AS (SELECT least((SELECT max(t) FROM r), (SELECT max(t) FROM s)) - {DELAY * 60}000000000::BIGINT AS mark)
SELECT 'r' AS side, r AS id FROM r, w WHERE x IS NOT NULL AND t + {JOINS["window_key_join_asym"].w_r}000000000::BIGINT > mark
UNION ALL SELECT 's', s FROM s, w WHERE a IS NOT NULL AND t + {JOINS["window_key_join_asym"].w_s}000000000::BIGINT > mark""",
    "energy_sweep_paced": _sweep_sql(SWEEP),
    "power_log_files": """WITH w AS (SELECT event_type AS channel, CASE WHEN event_id % 7 <> 0 THEN value * (event_id % 50 / 10.0::DOUBLE) END AS w FROM events)
SELECT channel, count(*) AS n, count(*) - count(w) AS n_bad, floor(avg(coalesce(w, 0)) * 10000 + 0.12345::DOUBLE) / 10000 AS mean, floor(max(w) * 10000 + 0.12345::DOUBLE) / 10000 AS high FROM w GROUP BY 1""",
    "power_by_freq": f"""SELECT ((user_id % 14 + 1) * 100)::INTEGER AS freq, event_type AS config, floor(avg(value) * 10000 + 0.12345::DOUBLE) / 10000 AS "W"
FROM events WHERE event_type IN ({", ".join(f"'{c}'" for c in CHANNELS)}) GROUP BY 1, 2 HAVING avg(value) IS NOT NULL""",
    "energy_report": "SELECT event_type AS config, min(event_id) AS latency, 0::BIGINT AS idle, max(event_id) AS proc, round(avg(floor(value)), 6) AS energy, count(*) AS in_count, count(DISTINCT user_id) AS out_count FROM events GROUP BY 1",
}
