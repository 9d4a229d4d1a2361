import hashlib

from pyspark.sql import functions as F

from tidejoin.llm import fixity
from tidejoin.llm.fixity import audit, audit_pages, file_levels, merkle_tree, warc_manifest

PAGES = "page_id long, url string, html string, digest string, file string"


def pages(spark, n=2500):
    return spark.createDataFrame([(i, f"http://x/{i}", "<p>é" * (i % 90), "d", "f") for i in range(n)], PAGES)


def test_equal_replicas_and_roots(spark):
    manifest = warc_manifest(pages(spark))
    assert audit(manifest, manifest).count() == 0
    tree = merkle_tree(manifest, file_levels(manifest)).toPandas()
    assert (tree[tree.level == tree.level.max()].shape[0]) == 1
    assert tree[tree.level == 0].shape[0] == 2500


def test_faults_are_located(spark):
    manifest = warc_manifest(pages(spark)).cache()
    at = {r.page_id: (r.file, r.offset) for r in manifest.collect()}
    replica = manifest.where("page_id NOT IN (7, 2499)").withColumn("digest", F.when(F.col("page_id").isin(0, 1300), "x").otherwise(F.col("digest")))
    replica = replica.unionByName(manifest.where("page_id = 1").withColumn("offset", F.lit(10**9)))
    found = {(r.file, r.offset): r.kind for r in audit(manifest, replica).collect()}
    assert found == {at[7]: "missing", at[2499]: "missing", at[0]: "altered", at[1300]: "altered", (0, 10**9): "extra"}


def test_only_branches_that_differ_are_descended(spark, monkeypatch):
    seen = {}
    plain = fixity.staged

    def counted(df, name, **kw):
        out = plain(df, name, **kw)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(fixity, "staged", counted)
    manifest = warc_manifest(pages(spark)).cache()
    replica = manifest.withColumn("digest", F.when(F.col("page_id") == 1300, "x").otherwise(F.col("digest")))
    assert audit(manifest, replica).count() == 1
    levels = [n for name, n in seen.items() if name.startswith("differ-")]
    assert len(levels) == fixity.IN_FILE + file_levels(manifest) + 1 and set(levels) == {1}
    seen.clear()
    assert audit(manifest, manifest).count() == 0 and sum(name.startswith("differ-") for name in seen) == 1


def test_damage_is_found_in_the_replicas_bytes(spark):
    rows = pages(spark, 1500)
    good = warc_manifest(rows)
    bad = warc_manifest(rows, spoilt=F.col("page_id").isin(3, 1200))
    key = {r.page_id: (r.file, r.offset, r.length) for r in good.collect()}
    assert key == {r.page_id: (r.file, r.offset, r.length) for r in bad.collect()}
    assert {(r.file, r.offset) for r in audit(good, bad).collect()} == {key[3][:2], key[1200][:2]}
    digest = {r.page_id: r.digest for r in bad.where("page_id IN (3, 4)").collect()}
    record = lambda i, first: (f"{first}ARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: http://x/{i}\r\nContent-Type: text/html\r\nContent-Length: {4 * i + i}" + "\r\n\r\n" + "<p>é" * i + "\r\n\r\n").encode()
    assert digest == {3: hashlib.sha256(record(3, "#")).hexdigest(), 4: hashlib.sha256(record(4, "W")).hexdigest()}


def test_odd_and_empty_tables(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (1, None, "", None, None), (1, None, "", None, None), (2, "u", "x" * 200_000, None, None)], PAGES)
    manifest = warc_manifest(odd)
    assert manifest.count() == 5 and audit(manifest, manifest).count() == 0
    nothing = warc_manifest(spark.createDataFrame([], PAGES))
    assert audit(nothing, nothing).count() == 0
    assert {r.kind for r in audit(manifest, nothing).collect()} == {"missing"}
    assert audit_pages(spark.createDataFrame([], PAGES)).count() == 0
