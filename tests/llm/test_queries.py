"""Each registered query over a small folder of tables, by its contract."""

import zlib

import pytest

import __spark_entry__
from tests.llm.cases import lowered, words
from tests.llm.test_attention import base as token_counts
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_minhash import brute as groups
from tests.llm.test_pii import brute as personal
from tests.llm.test_quality import brute as rules

LEAK = " ".join(f"bench{i}" for i in range(14))
EXPECTED = {
    "op3_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_toxic_segments": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_bpe_tree": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_quality_forest": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_attention_scores": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op9_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op10_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("query-tables"))
    prose = lambda k, n: " ".join(f"w{(k * 131 + i * 17 + i * i) % 4001}" for i in range(n))
    texts = [prose(k, 60 + 3 * k) for k in range(60)]
    texts += [texts[3], texts[4] + " tail", "", None, "One Two", "a a a " * 30, prose(70, 80) + f", {LEAK.upper()}! " + prose(71, 20), "mail a.b@c.de or +1 555 010 9999 at 10.0.0.1"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(5, LEAK)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, [(i, t) for i, t, *_ in rows]


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_contract(spark, folder, name):
    at, rows = folder
    out = __spark_entry__.queries()[name](spark, at)
    kinds = dict(out.dtypes)
    assert EXPECTED[name].items() <= kinds.items()
    found = {r.doc_id: r for r in out.collect()}
    assert sorted(found) == [i for i, _ in rows]
    crc = lambda i: zlib.crc32(str(i).encode())
    if name == "op3_minhash":
        expected = groups(rows, 2)
        assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in found.items()} == expected
    elif name == "op5_toxic_segments":
        assert all(r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in found.items())
    elif name == "op7_quality_forest":
        for i, t in rows:
            n, chars, symbols, dup, rep = rules(t)
            r = found[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
            assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    elif name == "op8_attention_scores":
        expected = token_counts(rows, [crc(i) % 7 != 2 for i, _ in rows])
        for i, r in found.items():
            assert r.held_out == (crc(i) % 7 == 2) and (r.n_tokens, r.n_known, r.train_tokens) == expected[i][:3]
            assert abs(r.base_score - expected[i][3]) < 1e-6 * max(1, -expected[i][3]) and r.score < 0
    elif name == "op9_decontaminate":
        for i, t in rows:
            r = found[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == hits(t, [(5, LEAK)])
    elif name == "op10_personal_data":
        for i, t in rows:
            spans = personal(t or "")
            assert [found[i][f"n_{k}"] for k in spans] == [len(v) for v in spans.values()]
            assert all(f"{k}:{a}:{b}" in found[i].spans for k, v in spans.items() for a, b in v)
    else:
        assert found[rows[62][0]].n_tokens == 0 == found[rows[63][0]].n_tokens and len(words(lowered(rows[0][1]))) <= found[0].n_tokens
