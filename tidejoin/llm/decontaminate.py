"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of WINDOW words keeps the least hash of its GRAM-word runs, so equal windows keep equal
fingerprints, whatever stands around them; a fingerprint is recorded where a sliding window first keeps
it, and again while it is kept, so that it stands for WINDOW - GRAM windows after it at most. Fingerprints of documents and benchmark are
joined, and each hit is extended over the windows that its place stands for: these are compared, as text,
with the benchmark's windows, and those that agree are united. Items shorter than a window are one window
each; every run of their length is fingerprinted whole.

Plan: the documents are split once; hashes and minima of longer runs come from those of shorter ones in a
few steps for each word. Places of hits alone go on, and the words of documents that have any. The
benchmark's tables are broadcast while their rows and bytes, counted first, are within BROADCAST_ROWS and
BROADCAST_BYTES (else Spark shuffles and splits skewed keys). Windows with the same items carry the name
of that set of items, so a window that many items hold does not multiply the hits of a document.

Defined results: null and empty texts have no words and no hits; rows with the same id and different
texts are judged apart, repeated rows alike; items without an id count as hits but are not listed; an
empty benchmark hits nothing.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidejoin.llm.staging import staged

WINDOW, GRAM = 10, 4
#: Rows and bytes of text up to which a table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 50_000_000


def benchmark_words(text: Column) -> Column:
    """ASCII letters in lower case and digits, and all beyond ASCII, make words; the rest parts them."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _beside(items: str, by: int) -> Column:
    """The items that stand `by` places on; fewer at the end."""
    return F.slice(items, by + 1, F.greatest(F.size(items) - by, F.lit(0)))


def with_runs(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds r1 and r<n>: for each place in column words, a hash of the n words from there (of fewer at the end).

    A run is hashed from the two runs, half as long or more, that begin and end it.
    """
    df = df.withColumn("r1", F.transform("words", lambda w: F.xxhash64(w)))
    made = 1
    while made * 2 <= max([*lengths, 1]):
        df = df.withColumn(f"r{made * 2}", F.zip_with(f"r{made}", _beside(f"r{made}", made), lambda x, y: F.xxhash64(x, y)))
        made *= 2
    for n in lengths:
        half = 1 << (n.bit_length() - 1)
        if n != half:
            df = df.withColumn(f"r{n}", F.zip_with(f"r{half}", _beside(f"r{half}", n - half), lambda x, y: F.xxhash64(F.lit(1), x, y)))
    return df


def with_fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """Adds prints to column words: for each place the least GRAM-word hash of the window there, NULL if one of the
    WINDOW - GRAM windows before it records the same one; and p<n> for each short length: the hash of the n words there.

    Windows cut off by the end have prints too; hits are compared as text, so these do no harm.
    """
    df = with_runs(df, [GRAM, *short])
    df = df.withColumnRenamed(f"r{GRAM}", "m1") if GRAM not in short else df.withColumn("m1", F.col(f"r{GRAM}"))
    wide, grams = 1, WINDOW - GRAM + 1
    while wide < grams:
        step = min(wide, grams - wide)
        df = df.withColumn(f"m{wide + step}", F.zip_with(f"m{wide}", _beside(f"m{wide}", step), lambda x, y: F.least(x, y)))
        wide += step
    # the one before, but for each place in `grams`: where words repeat, one print may stand for a long stretch
    before = F.concat(F.array(F.lit(None).cast("long")), F.transform(f"m{wide}", lambda x, i: F.when((i + 1) % grams != 0, x)))
    df = df.withColumn("prints", F.zip_with(f"m{wide}", before, lambda x, y: F.when(x.eqNullSafe(y), None).otherwise(x)))
    keep = [c for c in df.columns if not (c[0] in "rm" and c[1:].isdigit())]
    return df.select(*keep, *(F.col(f"r{n}").alias(f"p{n}") for n in short))


def _places(df: DataFrame, key: list[str], short: list[int]) -> DataFrame:
    """(key, at, span, print) of every fingerprint."""
    rows = df.select(*key, F.posexplode("prints").alias("at", "print"), F.lit(WINDOW).alias("span"))
    for n in short:
        rows = rows.union(df.select(*key, F.posexplode(f"p{n}").alias("at", "print"), F.lit(n).alias("span")))
    return rows.where("print IS NOT NULL")


def _small(df: DataFrame, text: str | None = None) -> DataFrame:
    """A hint to broadcast, if rows and bytes of text, counted, are few enough."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(text)) if text else F.lit(0)).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def _windows(places: Column, words: Column) -> Column:
    """(at, span, window) for each of places (at, span) that is inside."""
    inside = F.filter(places, lambda p: p["at"] + p["span"] <= F.size(words))
    return F.transform(inside, lambda p: F.struct(p["at"].alias("at"), p["span"].alias("span"), F.array_join(F.slice(words, p["at"] + 1, p["span"]), " ").alias("window")))


def _same(a: str, b: str) -> Column:
    return F.col("doc").eqNullSafe(F.col(a)) & (F.col("mark") == F.col(b))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, item_ids, items_sha256, contaminated, mark) of every row; mark: xxhash64 of the text."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), benchmark_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = staged(items.withColumn("span", F.least(F.size("words"), F.lit(WINDOW))), "benchmark-words")
    short = sorted(r.span for r in items.where(F.col("span") < WINDOW).select("span").distinct().collect())  # at most nine numbers
    # the items' windows, each with the name of the set of items that hold it
    every = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("span")), lambda i: F.struct(i.alias("at"), F.col("span").alias("span")))
    windows = items.select("item", "words", every.alias("places")).select("item", F.explode(_windows(F.col("places"), F.col("words"))).alias("w")).select("item", "w.span", "w.window")
    windows = windows.groupBy("span", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    windows = staged(windows.select("span", "window", "items", F.xxhash64("items").alias("held_by")), "benchmark-windows")
    sets = windows.select("held_by", "items").dropDuplicates(["held_by"])
    # of short items the whole; of the others all fingerprints, also those that a window before has
    prints = _places(with_fingerprints(items.select("words", "span"), short), ["words"], short)
    prints = prints.where((F.col("span") == WINDOW) | ((F.col("at") == 0) & (F.size("words") == F.col("span")))).select("span", "print").distinct()

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc", F.xxhash64("text").alias("mark"), benchmark_words(F.col("text")).alias("words"))
    seen = staged(with_fingerprints(rows, short).select("doc", "mark", F.size("words").cast("long").alias("n_words"), "prints", *(f"p{n}" for n in short)), "fingerprints")

    met = _places(seen, ["doc", "mark"], short).join(_small(prints), ["span", "print"], "left_semi")
    after = F.when(F.col("span") == WINDOW, F.sequence(F.col("at"), F.col("at") + (WINDOW - GRAM))).otherwise(F.array("at"))
    hits = met.select(F.col("doc").alias("d"), F.col("mark").alias("m"), F.explode(after).alias("at"), "span").groupBy("d", "m").agg(F.collect_set(F.struct("at", "span")).alias("places"))
    hits = staged(hits, "hits")
    texts = rows.join(_small(hits.select("d", "m")), _same("d", "m"), "left_semi").dropDuplicates(["doc", "mark"])
    near = texts.join(hits, _same("d", "m")).select("doc", "mark", F.explode(_windows(F.col("places"), F.col("words"))).alias("w")).select("doc", "mark", "w.*")
    found = near.join(_small(windows.select("span", "window", "held_by"), "window"), ["span", "window"]).select("doc", "mark", "at", "span", "held_by")
    found = staged(found.groupBy("doc", "mark").agg(F.sort_array(F.collect_set(F.struct("at", "span"))).alias("runs"), F.collect_set("held_by").alias("held_by")), "found")
    covered = F.aggregate(
        "runs", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, r: F.struct(F.greatest(acc["end"], r["at"] + r["span"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), r["at"] + r["span"] - F.greatest(acc["end"], r["at"]))).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    listed = found.select("doc", "mark", F.explode("held_by").alias("held_by")).join(sets, "held_by")
    listed = listed.select("doc", "mark", F.explode("items").alias("item")).groupBy("doc", "mark").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    listed = listed.select(F.col("doc").alias("d2"), F.col("mark").alias("m2"), "item_ids")
    per_doc = found.select(F.col("doc").alias("d"), F.col("mark").alias("m"), covered.alias("hit_words"))
    out = seen.select("doc", "mark", "n_words").join(per_doc, _same("d", "m"), "left").join(listed, _same("d2", "m2"), "left")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        F.col("doc").alias(id_col), "n_words", F.coalesce("hit_words", F.lit(0).cast("long")).alias("n_hit"),
        F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"),
        F.sha2(F.array_join(item_ids, ","), 256).alias("items_sha256"), F.col("hit_words").isNotNull().alias("contaminated"), "mark",
    )


#: DuckDB's form of the query over documents and benchmark.
SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 bs AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
 bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bs)),
 ms AS (SELECT DISTINCT m FROM bw),
 dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
 hits AS (SELECT DISTINCT doc_id, item_id, dw.i AS i, dw.m AS m FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
 pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
 its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 coalesce(its.h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
