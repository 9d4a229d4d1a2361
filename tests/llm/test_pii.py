import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import docs, empty_docs, odd_docs
from tidejoin.llm.pii import KINDS, base_spans, find_spans, luhn, mod97, personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if passes(k, m[0])] for k, p in PATTERNS.items()}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-() 0149%é_", max_size=60))
def test_base_spans_as_the_patterns(text):
    assert base_spans(text) == brute(text)


def test_planted(spark):
    text = "Mail joe.b@ex-am.co.uk, ip 10.0.0.255 not 1.2.3.256; card 4111 1111 1111 1111, call +1 (555) 010-9999. IBAN GB82 WEST 1234 5698 7654 32 here. My SSN is 078-05-1120, phone 555-123-4567."
    assert base_spans(text) == brute(text)
    kinds = [s.kind for s in find_spans(text)[0]]
    assert kinds == ["email", "ip", "card", "phone", "phone", "iban", "national_id"]
    assert luhn("4111111111111111") and not luhn("4111111111111112") and mod97("GB82WEST12345698765432")
    assert "national_id" not in [s.kind for s in find_spans("part 078-05-1120 of the order")[0]]


def test_ibans_before_capitals_and_numbers():
    gb, de, no = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO93 8601 1117 947"
    ibans = lambda text: [text[s.start : s.end] for s in find_spans(text)[0] if s.kind == "iban"]
    for after in ("", " BIC MIDLGB22", " I paid", " 100 EUR", " BIC COBADEFFXXX", " here", ".", " AND THEN SOME MORE CAPITAL WORDS FOLLOW IT"):
        assert [ibans(f"to {x}{after}") for x in (gb, de, no)] == [[gb], [de], [no]]
    assert ibans(f"{gb} {gb} {de} {no}") == [gb, gb, de, no]
    assert ibans(f"XX12 3456 7890 1234 {gb}") == [gb] and ibans(f"{gb}x") == [] and ibans(f"A{de}") == []
    assert ibans("GB83 WEST 1234 5698 7654 32 BIC") == []
    assert ibans("AB12 " * 60_000 + de) == [de] and ibans("A1" * 150_000) == []


def test_secrets():
    found = lambda text: [text[s.start : s.end] for s in find_spans(text)[0] if s.kind == "secret"]
    key, value = "AKIA" + "IOSFODNN7ABCDEFG", "b7db7aa4a5fcc78305"
    assert found(f"use {key} here") == [key] and found(f"x{key}") == [] and found(key + "x") == []
    for name in ("password", "Token", "api_key", "SECRET"):
        assert found(f"the {name}={value} was") == [value] and found(f'{name} : "{value}".') == [value]
    assert found("password=hopefully we meet") == [] and found("token = 12345678") == [] and found("nothing = " + value) == []
    assert found("-----BEGIN RSA PRIVATE KEY-----") == ["-----BEGIN RSA PRIVATE KEY-----"]
    assert found("mail token=joe1@example.org now") == []  # the e-mail address is there already


def test_ibans_against_every_substring():
    rng = random.Random(4)
    for _ in range(300):
        digits = "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int(digits + "131400") % 97  # D is 13, E is 14
        iban = f"DE{check:02d}{digits}"
        shown = " ".join(iban[i : i + 4] for i in range(0, 22, 4)) if rng.random() < 0.5 else iban
        text = f"{rng.choice(['to', 'A1', 'X 77'])} {shown} {rng.choice(['BIC', '12 EUR', 'and', ''])}"
        bare = lambda t: t.replace(" ", "")
        every = {(a, b) for a in range(len(text)) for b in range(a + 15, len(text) + 1) if text[a : a + 2] == "DE" and len(bare(text[a:b])) == 22 and text[b - 1] != " " and mod97(bare(text[a:b]))}
        assert {(s.start, s.end) for s in find_spans(text)[0] if s.kind == "iban"} == every and every


def test_words_nearby_move_scores():
    of = lambda text: [(s.kind, round(s.score, 2)) for s in find_spans(text)[0]]
    assert of("call +15550109999 now") == [("phone", 1.0)] and of("serial +15550109999 now") == [("phone", 0.4)] and of("see +15550109999 now") == [("phone", 0.7)]
    assert of("card 4111111111111111")[0] == ("card", 1.0) and of("order 4111111111111111")[0] == ("card", 0.5)


def test_long_runs_are_quick():
    assert base_spans("7" * 300_000) == {k: [] for k in KINDS}
    assert base_spans("a" * 300_000 + "@")["email"] == []


def test_very_many_spans():
    keys = [f"AKIA{i:015d}X" for i in range(100_000)]
    text = "\n".join(keys)
    began = time.process_time()
    found = find_spans(text)[0]
    assert time.process_time() - began < 60
    assert [text[s.start : s.end] for s in found if s.kind == "secret"] == keys
    text = " ".join(f"token=ab{i}cdefg key AKIA{i:016d} ssn 078-05-{1000 + i % 9000}" for i in range(300))
    spans = sorted((s.start, s.end) for s in find_spans(text)[0])
    assert len(spans) == 900 and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_rows(spark):
    found = personal_data(odd_docs(spark))
    assert found.count() == odd_docs(spark).count() and personal_data(empty_docs(spark)).count() == 0
    row = personal_data(docs(spark, ["x é a@b.c"])).collect()[0]
    assert (row.n_email, row.spans) == (1, "email:4:9") and row.base_sha256 == hashlib.sha256(b"email:4:9").hexdigest()
