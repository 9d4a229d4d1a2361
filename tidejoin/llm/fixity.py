"""WARC fixity: Merkle trees over record digests and offset ranges, compared between replicas.

A leaf is a record at its offset in a file; a node is an offset range FANOUT times as wide as those
below it, then a range of files. Each node hashes its children in order, so equal roots mean equal
replicas. An audit starts at the roots and follows mismatching branches alone: on each level, only
children of nodes that differ are compared.

Plan: digests are JVM functions next to the scan; each level is one aggregation of the level below
(its rows fall by the fan-out), with the partial lists of a node bounded by the range's size. Trees
are written once to the shared folder, level by level; a descent joins one level's rows with the few
nodes that differed above.

Defined results: null bodies and addresses are empty; records without a file or offset belong to file
-1 or offset 0; pages without an id lie in files below 0, by their content; records that repeat at one
place are one leaf, whatever their order; two empty replicas agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidejoin.llm.staging import staged

#: Width in bytes of the lowest offset range, and how many ranges make one of the next level.
RANGE, FANOUT = 64 * 1024, 32
#: Levels of offset ranges; the last ones are 64 GB wide, so a file has one of them, or a few.
IN_FILE = 5
#: Records of a file, and files (below 0) over which pages without an id are dealt by their content.
PER_FILE, LOOSE_FILES = 1_000, 65_536


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), text(page_id), F.lit(">\r\nWARC-Target-URI: "), text(url),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text(html)).cast("string"), F.lit("\r\n\r\n"), text(html), F.lit("\r\n\r\n"),
    )


def warc_manifest(pages: DataFrame, body: str = "html", spoilt: Column | None = None) -> DataFrame:
    """(file, offset, length, page_id, digest): where each page's record lies in the archive of pages in order, and the hash of its bytes.

    spoilt: for which pages the record's first character is overwritten, as in a damaged replica.
    """
    rows = pages.select(F.col("page_id"), F.col("url"), F.col(body).alias("body"), (F.lit(False) if spoilt is None else F.coalesce(spoilt, F.lit(False))).alias("spoilt"))
    record = warc_record(F.col("page_id"), F.col("url"), F.col("body"))
    rows = rows.withColumn("record", F.when(F.col("spoilt"), F.overlay(record, F.lit("#"), F.lit(1))).otherwise(record))
    content = F.xxhash64("url", "body")  # as it was meant, so that damage moves no record
    none = F.lit(-1) - F.pmod(content, F.lit(LOOSE_FILES))
    rows = rows.select(content.alias("content"), F.coalesce(F.floor(F.col("page_id") / PER_FILE), none).cast("long").alias("file"), "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    place = Window.partitionBy("file").orderBy("page_id", "content").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(place), F.lit(0)).cast("long")).drop("content")


def _node(children: Column) -> Column:
    """The hash of ordered children."""
    return F.sha2(F.array_join(F.transform(F.sort_array(children), lambda c: F.concat_ws(":", c["at"].cast("string"), c["hash"])), ","), 256)


def file_levels(*records: DataFrame) -> int:
    """How many levels of file ranges bring all files together; numbers below 0 and from 0 on stay apart."""
    bounds = [r.agg(F.min("file"), F.max("file")).first() for r in records]
    low = min((b[0] for b in bounds if b[0] is not None), default=0)
    high = max((b[1] for b in bounds if b[1] is not None), default=0)
    number = 1
    while number < 13 and low // FANOUT**number != high // FANOUT**number:
        number += 1
    return number


def merkle_tree(records: DataFrame, levels: int) -> DataFrame:
    """(level, file, idx, hash) from (file, offset, length, digest), with that many levels of file ranges."""
    leaf = F.concat_ws(":", F.coalesce("length", F.lit(0)).cast("string"), F.coalesce("digest", F.lit("")))
    rows = records.select("file", F.coalesce("offset", F.lit(0)).cast("long").alias("idx"), leaf.alias("leaf"))
    # records that repeat at one place are added up, for there may be any number of them
    mark = F.xxhash64("leaf")
    parts = [F.count("*"), F.min("leaf"), F.max("leaf"), F.bit_xor(mark), F.sum(mark.cast("decimal(20,0)"))]
    level = rows.groupBy("file", "idx").agg(F.sha2(F.concat_ws(",", *(p.cast("string") for p in parts)), 256).alias("hash"))
    level = staged(level.select(F.lit(0).alias("level"), "file", "idx", "hash"), "merkle-leaves")
    trees = [level]
    for number in range(1, IN_FILE + levels + 1):
        if number <= IN_FILE:
            wide = RANGE if number == 1 else FANOUT
            up = level.select("file", F.floor(F.col("idx") / wide).cast("long").alias("up"), F.struct(F.col("idx").alias("at"), "hash").alias("child"))
        else:
            up = level.select(F.floor(F.col("file") / FANOUT).cast("long").alias("file"), F.lit(0).cast("long").alias("up"), F.struct(F.col("file").alias("at"), "hash").alias("child"))
        level = up.groupBy("file", "up").agg(_node(F.collect_list("child")).alias("hash"))
        level = level.select(F.lit(number).alias("level"), "file", F.col("up").alias("idx"), "hash")
        if number == 1:  # hundreds of records a row: what stands above is small
            level = staged(level, "merkle-ranges")
        trees.append(level)
    above = trees[2]
    for t in trees[3:]:
        above = above.union(t)
    return trees[0].union(trees[1]).union(staged(above, "merkle-above"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, offset, kind): places where the replica's records are altered, missing or extra."""
    primary, replica = (t.withColumn("file", F.coalesce("file", F.lit(-1)).cast("long")) for t in (primary, replica))
    levels = file_levels(primary, replica)
    a, b, top = merkle_tree(primary, levels), merkle_tree(replica, levels), IN_FILE + levels
    differ: DataFrame | None = None
    for level in range(top, -1, -1):
        mine, theirs = (t.where(F.col("level") == level).select("file", "idx", "hash") for t in (a, b))
        if differ is not None:
            if level >= IN_FILE:
                up = [F.floor(F.col("file") / FANOUT).cast("long").alias("up_file"), F.lit(0).cast("long").alias("up_idx")]
            else:
                up = [F.col("file").alias("up_file"), F.floor(F.col("idx") / (RANGE if level == 0 else FANOUT)).cast("long").alias("up_idx")]
            above = differ.select(F.col("file").alias("up_file"), F.col("idx").alias("up_idx"))
            mine, theirs = (t.select("*", *up).join(above, ["up_file", "up_idx"], "left_semi").drop("up_file", "up_idx") for t in (mine, theirs))
        both = mine.withColumnRenamed("hash", "was").join(theirs.withColumnRenamed("hash", "now"), ["file", "idx"], "full_outer")
        differ = staged(both.where(~F.col("was").eqNullSafe(F.col("now"))), f"differ-{level}")
        if level == top and differ.isEmpty():  # equal roots: nothing below differs
            break
    kind = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").otherwise("altered")
    return differ.select("file", F.col("idx").alias("offset"), kind.alias("kind"))


def audit_pages(pages: DataFrame) -> DataFrame:
    """The audit of a replica of the pages' archive in which pages with a given digest are spoilt or lost.

    A record is spoilt (its first character overwritten) if the MD5 of its page's id begins with 00,
    and lost if with 01.
    """
    fate = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    manifest = staged(warc_manifest(pages), "manifest")
    replica = staged(warc_manifest(pages, spoilt=fate == "00").where(fate != "01"), "replica")  # hashed from its own bytes
    found = audit(manifest, replica)
    return found.join(manifest.select("file", "offset", "page_id", "length"), ["file", "offset"], "left").select("page_id", "file", "offset", "length", "kind")


#: DuckDB's form of the query over pages: the planted faults, and where their records lie.
SQL = r"""
WITH r AS (SELECT page_id, coalesce(floor(page_id / 1000.0), -1)::BIGINT AS file,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR
  || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
 m AS (SELECT page_id, file, strlen(record)::BIGINT AS length, sha256(record) AS digest, substr(md5(coalesce(page_id::VARCHAR, '')), 1, 2) AS fate FROM r),
 p AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM m)
SELECT page_id, file, "offset", length, CASE fate WHEN '00' THEN 'altered' ELSE 'missing' END AS kind FROM p WHERE fate IN ('00', '01')
"""
