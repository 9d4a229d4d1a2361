import random

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import docs, empty_docs, odd_docs, words
from tidejoin.llm import lines as L
from tidejoin.llm.lines import dedup_lines, line_classes, line_links, with_edit_distance


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def linked(a, b, edits):
    most = min(edits, min(len(a), len(b)) // 5)
    return a != b and abs(len(a) - len(b)) <= most and distance(a, b) <= most


def brute(rows, edits):
    """{line: (first document, line number, times, links, kept)}"""
    seen = {}
    for i, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if words(line):
                seen.setdefault(line, []).append((i is None, i, pos))
    out = {}
    for line, places in seen.items():
        others = [o for o in seen if linked(line, o, edits)]
        out[line] = (*min(places)[1:], len(places), len(others), all(min(seen[o]) > min(places) for o in others))
    return out


def dedup(rows, edits):
    """{document: text} of what stays, for rows with ids of their own."""
    place = {(i, pos) for i, pos, _, _, kept in brute(rows, edits).values() if kept}
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        if any((i, pos) in place for pos in range(len(lines))):
            out[i] = "\n".join(x for pos, x in enumerate(lines) if not words(x) or (i, pos) in place)
    return out


def edited(line, rng):
    k = rng.randrange(len(line))
    return rng.choice([line[:k] + "é" + line[k:], line[:k] + line[k + 1 :], line[:k] + "z" + line[k + 1 :]])


def noisy(seed, low=1, high=40, n=25):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é漢") for _ in range(rng.randrange(low, high))) + "x" for _ in range(n)]
    lines = base + [edited(x, rng) for x in base for _ in range(3)]
    for _ in range(2):
        lines += [edited(x, rng) for x in lines[-2 * n :] if len(x) > 1]
    return ["\n".join(rng.choices([*lines, "", " \t"], k=4)) for _ in range(90)]


@pytest.mark.parametrize("edits", [1, 2])
def test_classes_match_brute_force(spark, edits):
    texts = noisy(edits)
    found = line_classes(docs(spark, texts), edits=edits).collect()
    assert sorted(map(tuple, found)) == sorted(brute(list(enumerate(texts)), edits).values())


@pytest.mark.parametrize("frequent", [1, 4, 1000])
def test_every_line_has_its_class(spark, monkeypatch, frequent):
    """Each line of each document, also where it is no first occurrence: its class, links of it, and whether it stays."""
    monkeypatch.setattr(L, "FREQUENT", frequent)
    texts = [*noisy(5), None, "", "\n\n", "one"]
    rows = list(enumerate(texts))
    classes = {(i, pos): (n_links, kept) for i, pos, _, n_links, kept in brute(rows, 2).values()}
    first = {}
    expected = []
    for i, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if words(line):
                place = first.setdefault(line, (i, pos))
                expected.append((i, pos, *place, classes[place][0], classes[place][1] and place == (i, pos)))
    found = L.line_members(docs(spark, texts), edits=2)
    assert found.columns == ["doc_id", "line_no", "first_doc_id", "first_line_no", "n_links", "kept"]
    assert sorted(map(tuple, found.collect())) == expected
    left = {(i, x) for i, text in dedup(rows, 2).items() for x in text.split("\n") if words(x)}
    assert {(r.doc_id, texts[r.doc_id].split("\n")[r.line_no]) for r in found.where("kept").collect()} == left


def test_lines_of_a_carriage_return_have_a_class(spark):
    """White space of the SQL is blanks and tabs; what goes out of a text is a line with a word."""
    texts = ["a line of words\r\n\r\nmore\r", "other words here\r\n\r\n \t\n\x0b\n\x0c"]
    found = {(r.doc_id, r.line_no): (r.n_times, r.kept) for r in line_classes(docs(spark, texts)).collect()}
    assert found == {(0, 0): (1, True), (0, 1): (2, True), (0, 2): (1, True), (1, 0): (1, True), (1, 3): (1, True), (1, 4): (1, True)}
    members = {(r.doc_id, r.line_no): ((r.first_doc_id, r.first_line_no), r.kept) for r in L.line_members(docs(spark, texts)).collect()}
    assert members == {**{place: (place, True) for place in found}, (1, 1): ((0, 1), False)}
    assert {r.doc_id: r.text for r in dedup_lines(docs(spark, texts)).collect()} == dict(enumerate(texts))


def test_what_stays_matches_brute_force(spark):
    edits = 2
    texts = [*noisy(7, 12, 30), None, "", "\n\n", "one"]
    found = dedup_lines(docs(spark, texts), edits=edits)
    assert found.columns == docs(spark, texts).columns
    assert {r.doc_id: r.text for r in found.collect()} == dedup(list(enumerate(texts)), edits)
    assert found.where(F.col("n_chars") != F.length("text")).count() == 0


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(3)
    ids = sorted({rng.randrange(10**4) for _ in range(60)})
    lines = [f"order {i:04d} was sent today" for i in ids] + [f"total of {i} paid" for i in ids[:30]]
    lines = sorted({*lines, *(edited(x, rng) for x in lines[:20])})
    monkeypatch.setattr(L, "HOT", 8)
    for edits in (1, 2):
        expected = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[:i] if linked(a, b, edits)}
        found = line_links(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(2), edits).collect()
        assert len(found) == len(expected) and {frozenset((r.line_a, r.line_b)) for r in found} == expected


def test_thousands_of_lines_of_one_template(spark):
    lines = spark.range(4000).select(F.format_string("invoice number %08d has been sent to the customer as agreed", F.pmod(F.xxhash64("id"), F.lit(10**8))).alias("line"))
    texts = {r.line for r in lines.collect()}
    near = {frozenset((x, x[:k] + c + x[k + 1 :])) for x in texts for k in range(15, 23) for c in "0123456789" if c != x[k] and x[:k] + c + x[k + 1 :] in texts}
    found = {frozenset((r.line_a, r.line_b)) for r in line_links(lines, 1).collect()}
    assert found == near


@pytest.mark.parametrize("form", ["order {:04d} was sent today", "{:04d}", "total of {:04d}", "漢{:04d}é"])
def test_two_edits_on_lines_of_one_template(spark, form):
    """Lines that differ in a few characters in their middle, or in all of them: levels end, and every link is found."""
    lines = [form.format(n) for n in range(0, 10_000, 9)]
    texts = sorted(x for x in lines if len(x) >= L.CHARS)
    found = line_links(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(2), 2).collect()
    number = lambda x: next(x[k : k + 4] for k in range(len(x)) if x[k].isdigit())
    most = min(2, len(form.format(0)) // 5)  # equal beginnings and ends change nothing, so numbers alone are compared
    expected = {frozenset((a, b)) for i, a in enumerate(texts) for b in texts[:i] if distance(number(a), number(b)) <= most}
    assert len(found) == len(expected) and {frozenset((r.line_a, r.line_b)) for r in found} == expected


def test_bit_parallel_distance(spark):
    rng = random.Random(9)
    pairs = [("", ""), ("a", ""), ("", "abc"), ("é", "e"), ("漢字", "字漢")]
    for _ in range(400):
        a = "".join(rng.choice("abé漢") for _ in range(rng.randrange(12)))
        b = a
        for _ in range(rng.randrange(5)):
            b = edited(b, rng) if b else "q"
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (0, 1, 2, 4):
        for r in with_edit_distance(df, "a", "b", most).collect():
            d = distance(r.a, r.b)
            assert r.distance == (d if d <= most else None), (r, most, d)


def test_dedup_keeps_first_lines(spark):
    a, b = "this is the first long line", "this is the other long line"
    texts = [f"{a}\n\n{b}", f"{b}\nnew words in here", a, f"{a}!\nown", f"own2\nown2\n{a}", "clean"]
    found = {r.doc_id: r for r in dedup_lines(docs(spark, texts)).collect()}
    assert {i: r.text for i, r in found.items()} == {0: f"{a}\n\n{b}", 1: "new words in here", 3: "own", 4: "own2", 5: "clean"}
    assert found[4].n_chars == 4


def test_many_lines_and_rows_without_id(spark):
    many = "\n".join(f"line number {i * i} of this text {i % 7919}" for i in range(20_000))
    rows = [(1, many), (None, "first words of a row\nshared by both of them"), (None, "shared by both of them\nand others of its own"), (2, "shared by both of them")]
    df = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in rows], "doc_id long, text string, n_chars int, row string, stay string")
    found = dedup_lines(df, edits=1)
    assert found.columns == df.columns
    texts = sorted(r.text for r in found.where("doc_id IS NULL OR doc_id = 2").collect())
    assert texts == ["and others of its own", "first words of a row", "shared by both of them"]


def test_odd_and_empty_tables(spark):
    assert line_classes(empty_docs(spark)).count() == 0 and dedup_lines(empty_docs(spark)).count() == 0
    found = line_classes(odd_docs(spark)).collect()
    rows = {(r.doc_id, r.text) for r in odd_docs(spark).collect()}
    assert len(found) == len({x for _, t in rows for x in (t or "").split("\n") if words(x)})
    assert {r.text for r in dedup_lines(odd_docs(spark)).collect()} >= {"one", "two words"}
