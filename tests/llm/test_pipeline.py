import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.cases import odd_docs
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_lines import dedup as kept_lines
from tests.llm.test_minhash import brute as groups
from tests.llm.test_quality import brute as rules

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    prose = lambda k, n: " ".join(f"w{(k * 131 + i * 17 + i * i) % 4001}" for i in range(n))
    shared = "a line that stands in several of the documents"
    texts = [prose(k, 60 + 5 * k) for k in range(40)]
    texts += [texts[3], texts[4] + " tail", f"{shared}\n{prose(50, 70)}", f"{shared}\n{prose(51, 70)}", f"{shared}!\n{prose(52, 70)}"]
    texts += ["too short", None, "", "same same " * 60, prose(60, 90) + " " + " ".join(f"bench{i}" for i in range(14)) + " " + prose(61, 30)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(5, " ".join(f"Bench{i}" for i in range(14)))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, folder)
        if name == "encode":
            tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            for r in out.collect():
                ids = tok.encode(before[r.doc_id], add_special_tokens=False).ids
                assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert out.count() == len(before) > 30
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "quality_rules":
            good = {i for i, t in before.items() for n, _, _, _, rep in [rules(t)] if n >= 50 and 100 * rep <= 50 * n}
            assert set(after) <= good and len(good - set(after)) <= 2
        elif name == "line_dedup":
            assert after == kept_lines(list(before.items()), 2)
            assert 40 not in after and "several" in after[42] and "several" not in after[43] and "several" not in after[44]
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c, _) in groups(list(before.items()), 5).items() if c == i}
        else:
            assert set(after) == {i for i, t in before.items() if not hits(t, [(5, " ".join(f"Bench{i}" for i in range(14)))])[4]}
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.run(spark, folder).count() == len(before)


def test_stages_take_odd_rows_and_none(spark, folder):
    odd = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, folder).collect()
        assert stage(spark, odd.limit(0), folder).count() == 0


def test_a_rejected_row_takes_no_other_row_of_its_id_along(spark, folder):
    prose = [" ".join(f"w{(k * 131 + i * 17 + i * i) % 4001}" for i in range(90)) for k in (2, 4, 6)]
    leak = prose[2] + " " + " ".join(f"bench{i}" for i in range(14))
    for key in (None, 7):
        kept = {prose[0], prose[1]}
        short = spark.createDataFrame([(key, t, "en", "s", 9) for t in [*kept, "too short", None, ""]], COLUMNS).coalesce(1)
        assert {r.text for r in corpus_pipeline.quality_rules(spark, short, folder).collect()} == kept
        lined = spark.createDataFrame([(key, t, "en", "s", 9) for t in (prose[0], prose[1] + "\nshared line of words", "shared line of words\n" + prose[2])], COLUMNS).coalesce(1)
        found = [r.text for r in corpus_pipeline.line_dedup(spark, lined, folder).collect()]
        assert len(found) == 3 and sum("shared" in t for t in found) == 1
        leaked = spark.createDataFrame([(key, t, "en", "s", 9) for t in [*kept, leak]], COLUMNS)
        assert {r.text for r in corpus_pipeline.decontaminate(spark, leaked, folder).collect()} == kept


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_few_rejected_rows_shuffle_no_text(spark, folder, monkeypatch, most):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", most, raising=False)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage, left in ((corpus_pipeline.near_dedup, {3: 1, 40: 0}), (corpus_pipeline.decontaminate, {3: 1, 49: 0})):
            out = stage(spark, docs, folder)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("SortMergeJoin" in plan) == (most == 0)
            assert [out.where(f"doc_id = {i}").count() for i in left] == list(left.values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
