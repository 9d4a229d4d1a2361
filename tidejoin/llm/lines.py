"""Line dedup: a segment-partition edit join over distinct lines, in DataFrame functions only.

Two lines are linked when at most k edits (characters put in, left out or changed) turn one into the
other, where k grows with the shorter line: one for each CHARS characters, EDITS at most. The shorter
line is parted into k + 1 segments, of which one at least stands in the longer line whole, shifted by no
more than the edits before it allow. The index has the segments of each line by length and number; a
line probes it for every length that it may have to do with, with its substrings at the places allowed. A
key of the index with HOT lines or more is not paired: what is left of its lines beside the segment is
joined in the same way, once the beginning and the end that all of them share are cut off. So lines of one
template part where they differ, and none is dropped. Links are verified by a bit-parallel automaton over
a band of 2k + 1 diagonals.

Plan: equal lines are one class before any join (partial aggregation, so a line in a third of all
documents costs a row a task). Keys with HOT lines are found first, and taken out before keys are
shuffled. Keys and 64-bit hashes alone go through the join; text is fetched for lines that met.
A class is dropped if it is within the edits of an earlier class: by first document, then place there.
Members of a class find it by its hashes: those of frequent classes by a broadcast, so that a line in all documents
is no hot spot, the others by a shuffle.

Defined results: null and empty texts have no lines, lines without a character other than white space
are never duplicates (line_classes and line_members follow the SQL, for which white space is blanks and tabs); every row counts as a document of its own, but rows repeating id and text keep and
lose the same lines; rows without an id come last, by a hash of their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidejoin.llm.staging import few, staged, unused

#: Edits within which lines are linked, and characters of the shorter line for each of them.
EDITS, CHARS = 2, 5
#: Index entries of a key from which its lines are joined by the rest of them.
HOT = 100
#: White space, and what of it the SQL of the queries leaves out: a line of a carriage return, as between paragraphs of some texts, has a class there.
SPACE, SQL_SPACE = " \t\n\x0b\x0c\r", " \t\n"
#: Letters that are counted to tell lines apart before they are compared: common ones, twelve at most.
LETTERS = "etainosr"
#: Pairs of lines that a task compares.
PAIRS = 5_000
#: Rows (keys, or hashes of lines) up to which a counted table is broadcast: 16 MB.
BROADCAST_ROWS = 1_000_000
#: Occurrences from which a line is frequent; its class is broadcast to them.
FREQUENT = 1_000


def split_lines(text: Column) -> Column:
    """The lines of a text, which line feed parts."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def has_word(line: Column, space: str = SPACE) -> Column:
    return F.ltrim(line, F.lit(space)) != ""


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", space: str = SPACE) -> DataFrame:
    """(doc, row, pos, line): the lines of each document with more than white space; row is a hash of id and text."""
    text = F.col(text_col).cast("string")
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), text).alias("row"), F.posexplode(split_lines(text)).alias("pos", "line"))
    return lines.where(has_word(F.col("line"), space))


def _hashes(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def allowed(n: Column, edits: int) -> Column:
    """Edits within which a line of n characters is linked with one as long or longer."""
    return F.least(F.lit(edits), F.floor(n / CHARS).cast("int"))


def _choices(edits: int, delta: int, moved: bool = False) -> list[tuple[int, int, int, int]]:
    """(edits, segment, shift, delta): where a line may have a segment of one shorter by delta.

    The edits before a segment are fewer than its number, and those after it no more than there are
    segments from it on. moved: without those that the index has for the line itself.
    """
    return [
        (e, i, s, delta)
        for e in range(max(1, delta), edits + 1)
        for i in range(1, e + 2)
        for s in range(max(1 - i, delta - (e + 1 - i)), min(i - 1, delta + e + 1 - i) + 1)
        if s or not moved
    ]


def _segments(edits: int) -> list[tuple[int, int, int, int]]:
    """The index's own choices: each segment where it stands."""
    return [(e, i, 0, 0) for e in range(1, edits + 1) for i in range(1, e + 2)]


def _entries(rows: DataFrame, choices: list[tuple[int, int, int, int]], carried: list[str]) -> DataFrame:
    """(carried, key, low, high) for each choice open to rows (g, k, delta, n, text): hash and bounds of the substring.

    Choices are made rows before anything is computed: one long expression for all of them would be
    a method too large for the JVM to compile.
    """
    every = F.array(*(F.struct(*(F.lit(x).alias(name) for x, name in zip(c, ("e", "i", "s", "d"), strict=True))) for c in choices))
    rows = rows.withColumn("c", F.explode(every)).where("c.e = k AND c.d = delta")
    n = F.col("n") - F.col("delta")
    low, high = ((n * i / (F.col("c.e") + 1)).cast("int") + F.col("c.s") for i in (F.col("c.i") - 1, F.col("c.i")))
    rows = rows.withColumns({"low": low, "high": high}).where("low >= 0 AND high <= n")
    key = F.xxhash64("g", n, "c.e", "c.i", F.substring(F.col("text"), F.col("low") + 1, F.col("high") - F.col("low")))
    return rows.select(*carried, key.alias("key"), "low", "high")


def _letters(text: Column) -> Column:
    """How often some letters occur, five bits for each: an edit changes two of them by one at most."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):  # each is taken out of what those before have left, which is shorter
        rest = F.replace(text, F.lit(c), F.lit(""))
        out = out.bitwiseOR(F.shiftleft((F.length(text) - F.length(rest)).bitwiseAND(31).cast("long"), 5 * i))
        text = rest
    return out


def _apart(x: str, y: str) -> Column:
    """Changes of single letters, at least, between two lines, by their _letters."""
    out = F.lit(0)
    for i in range(len(LETTERS)):
        d = F.abs(F.shiftright(x, 5 * i).bitwiseAND(31) - F.shiftright(y, 5 * i).bitwiseAND(31))
        out = out + F.least(d, 32 - d)
    return out


def _join_level(index: DataFrame, probes: DataFrame, edits: int, hot: DataFrame | None, small: bool) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(pairs, index, probes): pairs (a, b) of ids that meet in keys that are not hot, and the next level's tables for the rest.

    index: (g, k, delta 0, id, letters, text); probes: the same, for lines of the index shorter by delta. small: whether hot can be broadcast.
    """
    hint = F.broadcast if small else lambda t: t
    index, probes = (t.withColumn("n", F.length("text")) for t in (index, probes))

    def expanded(index: DataFrame, probes: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
        other = _entries(probes, [c for d in range(edits + 1) for c in _choices(edits, d)], carried)
        if shifted := _choices(edits, 0, moved=True):  # none for one edit
            other = other.union(_entries(index, shifted, carried))
        return _entries(index, _segments(edits), carried), other

    own, other = expanded(index, probes, ["id", "letters"])
    cold = (lambda t: t.join(hint(hot.select("key")), "key", "left_anti")) if hot is not None else lambda t: t
    a = cold(own.select("key", F.col("id").alias("a"), F.col("letters").alias("x")))
    twin = a.select("key", F.col("a").alias("b"), F.col("x").alias("y"))
    b = cold(other.select("key", F.col("id").alias("b"), F.col("letters").alias("y")))
    near = _apart("x", "y") <= 2 * edits
    pairs = a.join(twin, "key").where((F.col("a") < F.col("b")) & near).select("a", "b")
    pairs = pairs.union(a.join(b, "key").where((F.col("a") != F.col("b")) & near).select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    if hot is None:
        return pairs, None, None
    # lines of other lengths have no part in hot keys
    lengths = hint(hot.select("m").distinct())
    index, probes = (t.join(lengths, F.col("n") - F.col("delta") == F.col("m"), "left_semi") for t in (index, probes))
    text = F.col("text")
    # what is left of two lines is no more edits apart than they are, and shorter than they by the segment, so levels come to an end
    rest = F.concat(F.substring(text, F.lit(1), F.col("low")), F.substring(text, F.col("high") + 1, F.col("n"))).alias("text")
    left, right = (t.join(hint(hot.select("key")), "key", "left_semi").select(F.col("key").alias("g"), "k", "delta", "id", "letters", rest) for t in expanded(index, probes, ["k", "delta", "id", "letters", "n", "text"]))
    return pairs, left, right


def _hot_keys(index: DataFrame, edits: int) -> DataFrame:
    """(key, m): keys that HOT entries or more have, of two lines at least, and the length of their lines.

    Segments that leave no more of their line than the edits could change are not split further; so those that are have a
    character at least.
    """
    entries = _entries(index.withColumn("n", F.length("text")), _segments(edits), ["id", "n", "k"]).where("n - high + low > k")
    counts = entries.groupBy("key", F.col("n").alias("m")).agg(F.count("*").alias("times"), F.min("id").alias("x"), F.max("id").alias("y"))
    return counts.where((F.col("times") >= HOT) & (F.col("x") < F.col("y"))).select("key", "m")


def _common(a: str, b: str) -> Column:
    """Characters that two text columns begin with alike, by steps of halving width."""
    shorter = F.least(F.length(a), F.length(b))
    same = lambda at, w: (at + w <= shorter) & (F.substring(a, at + 1, w) == F.substring(b, at + 1, w))
    steps = F.filter(F.array(*(F.lit(1 << i) for i in range(30, -1, -1))), lambda w: w <= shorter)
    return F.aggregate(steps, F.lit(0), lambda at, w: F.when(same(at, w), at + w).otherwise(at))


def _without_shared_ends(index: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the beginning and the end that all texts of a group share: these change no distance."""
    every = index.select("g", "text").union(probes.select("g", "text")).withColumn("back", F.reverse("text"))
    ends = every.groupBy("g").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("text", "back")), F.min(F.length("text")).alias("least"))
    ends = ends.select("g", "least", _common("min_text", "max_text").alias("head"), _common("min_back", "max_back").alias("tail"))
    ends = ends.select("g", "head", F.least("tail", F.col("least") - F.col("head")).alias("tail"))
    cut = F.substring("text", F.col("head") + 1, F.length("text") - F.col("head") - F.col("tail")).alias("text")
    ends = few(staged(ends, "shared-ends"), BROADCAST_ROWS)
    return tuple(t.join(ends, "g").select(*(c for c in t.columns if c != "text"), cut) for t in (index, probes))


def candidates(lines: DataFrame, edits: int) -> DataFrame:
    """(a, b): hashes (h1) of all pairs of lines that may be within the edits, from (line) with repeats."""
    some = lines.where(F.length("line") >= CHARS).select(F.xxhash64("line").alias("id"), F.col("line").alias("text"))

    ground = [F.lit(0).cast("long").alias("g"), allowed(F.length("text"), edits).alias("k"), F.lit(0).alias("delta"), "id"]
    distinct = staged(some.select("id", "text", _letters(F.col("text")).alias("letters")).distinct(), "lines")  # letters are counted before the shuffle, once for each line
    index = distinct.select(*ground, "letters", "text")
    hot = staged(_hot_keys(index, edits), "hot-keys")
    n_hot = hot.count()
    longer = F.explode(F.array(*(F.lit(d) for d in range(1, edits + 1)))).alias("delta")
    probes = index.select("g", "id", "letters", "text", longer).withColumn("k", allowed(F.length("text") - F.col("delta"), edits)).where("delta <= k")
    probes = probes.select(*index.columns)
    found = []
    while True:
        pairs, index, probes = _join_level(index, probes, edits, hot if n_hot else None, n_hot <= BROADCAST_ROWS)
        found.append(staged(pairs, "line-pairs"))
        if not n_hot:
            break
        index, probes = _without_shared_ends(*(staged(t, "line-rests") for t in (index, probes)))
        hot = staged(_hot_keys(index, edits), "hot-keys")
        n_hot = hot.count()
    out = found[0]
    for t in found[1:]:
        out = out.union(t)
    return out.distinct() if len(found) > 1 else out


def with_edit_distance(df: DataFrame, a: str, b: str, most: int, out: str = "distance") -> DataFrame:
    """df with the edits between two text columns if there are `most` (4 or fewer) at most, else NULL.

    What both begin and end with is left out, as it changes no distance. One register of 2 * most + 1 bits
    for each number of edits holds the diagonals that are reachable with so many; all registers are one
    integer, and each character of b moves them at once, until none is left.
    """
    if not 0 <= most <= 4:
        raise ValueError("0 to 4 edits")
    width = 2 * most + 1
    full = (1 << width) - 1
    near = F.abs(F.length(a) - F.length(b)) <= most
    names = [unused(df, n) for n in ("head", "tail", "back_a", "back_b", "mid_a", "mid_b", "end")]
    head, tail, back_a, back_b, mid_a, mid_b, end = names
    df = df.withColumns({head: F.when(near, _common(a, b)), back_a: F.reverse(a), back_b: F.reverse(b)})
    df = df.withColumn(tail, F.when(near, F.least(_common(back_a, back_b), F.least(F.length(a), F.length(b)) - F.col(head))))
    middle = lambda c: F.substring(c, F.col(head) + 1, F.length(c) - F.col(head) - F.col(tail))
    df = df.withColumns({mid_a: middle(a), mid_b: middle(b)})

    chars = F.split(mid_b, "")
    padded = F.concat(F.array_repeat(F.lit(""), most), F.split(mid_a, ""), F.array_repeat(F.lit(""), 3 * most + 1))
    beside = F.arrays_zip(chars, *(F.slice(padded, t + 1, F.size(chars)) for t in range(width)))

    def mask(x: Column) -> Column:
        """The diagonals on which the next characters agree."""
        flags = [F.when(x["0"] == x[str(t + 1)], F.lit(1 << t).cast("long")).otherwise(F.lit(0).cast("long")) for t in range(width)]
        return reduce(Column.bitwiseOR, flags)

    def register(s: Column, e: int) -> Column:
        return F.shiftrightunsigned(s, width * e).bitwiseAND(full)

    def moved(s: Column, m: Column) -> Column:
        now = register(s, 0).bitwiseAND(m)
        found = now
        for e in range(1, most + 1):
            was = register(s, e - 1)
            now = register(s, e).bitwiseAND(m).bitwiseOR(was).bitwiseOR(F.shiftright(was, 1)).bitwiseOR(F.shiftleft(now, 1)).bitwiseAND(full)
            found = found.bitwiseOR(F.shiftleft(now, width * e))
        return found

    start = sum((((1 << (e + 1)) - 1) << most & full) << (width * e) for e in range(most + 1))
    step = lambda s, x: F.when(s == 0, s).otherwise(F.transform(F.array(mask(x)), lambda m: moved(s, m))[0])
    df = df.withColumn(end, F.when(F.col(mid_a).isNotNull() & (F.col(mid_b) != ""), F.aggregate(beside, F.lit(start).cast("long"), step)).when(near, F.lit(start).cast("long")))
    diagonal = F.length(a) - F.length(b) + most
    reached = lambda e: F.coalesce(*(F.when(diagonal == t, F.shiftright(end, width * e + t).bitwiseAND(1)) for t in range(width))) == 1
    return df.withColumn(out, F.coalesce(*(F.when(reached(e), F.lit(e)) for e in range(most + 1)))).drop(*names)


def line_links(lines: DataFrame, edits: int = EDITS, texts: bool = True) -> DataFrame:
    """Pairs of different lines within the edits allowed, each once, from (line) with repeats.

    texts: (line_a, line_b); else (a, b), the _hashes of both.
    """
    pairs = candidates(lines, edits)
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    found = lines.select(F.xxhash64("line").alias("id"), "line").join(few(needed, BROADCAST_ROWS), "id", "left_semi").distinct()
    met = pairs.join(found.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(found.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    met = met.select("line_a", "line_b").repartition(1 + pairs.count() // PAIRS)  # small rows, but each takes long
    most = allowed(F.least(F.length("line_a"), F.length("line_b")), edits).alias("most")
    ends = ["line_a", "line_b"] if texts else [F.struct(*_hashes(F.col(f"line_{s}"))).alias(s) for s in "ab"]
    # staged, as a filter would be moved below the steps of the distance and repeat them
    known = staged(with_edit_distance(met, "line_a", "line_b", edits).select(*ends, "distance", most), "line-distances")
    return known.where("distance BETWEEN 1 AND most").drop("distance", "most")


def _classes(docs: DataFrame, id_col: str, text_col: str, edits: int, space: str = SPACE) -> DataFrame:
    """(h1, h2, place, n_times, n_links, kept) of each distinct line; place: of its first occurrence (no id, id, row, number of the line)."""
    lines = document_lines(docs, id_col, text_col, space)
    place = F.struct(F.col("doc").isNull().alias("absent"), "doc", "row", "pos")
    classes = lines.select(*_hashes(F.col("line")), place.alias("place")).groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("n_times"))
    links = line_links(lines.select("line"), edits, texts=False)
    links = links.union(links.select("b", "a"))
    for s in "ab":
        of = classes.select(F.col("h1").alias("x"), F.col("h2").alias("y"), F.col("place").alias(f"place_{s}"))
        links = links.join(of, (F.col(f"{s}.h1") == F.col("x")) & (F.col(f"{s}.h2") == F.col("y"))).drop("x", "y")
    linked = links.groupBy(F.col("a.h1").alias("h1"), F.col("a.h2").alias("h2")).agg(F.count("*").alias("n_links"), F.max((F.col("place_b") < F.col("place_a")).cast("int")).alias("later"))
    out = classes.join(linked, ["h1", "h2"], "left")
    return out.select("h1", "h2", "place", "n_times", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), (F.coalesce("later", F.lit(0)) == 0).alias("kept"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """A row for each distinct line: id of its first document, number of the line there (from 0), n_times, n_links, and kept (no earlier line within the edits).

    Lines of blanks and tabs alone have none, as in the SQL; those of other white space have.
    """
    found = _classes(docs, id_col, text_col, edits, SQL_SPACE)
    return found.select(F.col("place.doc").alias(id_col), F.col("place.pos").alias("line_no"), "n_times", "n_links", "kept")


def line_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """A row for each line of each document that has a class in line_classes: its id, line_no, and of its class first_{id} and first_line_no (as in line_classes), n_links, and kept.

    kept: the class is, and this is its first occurrence; so lines with kept and a word are those that dedup_lines leaves.
    """
    classes = staged(_classes(docs, id_col, text_col, edits, SQL_SPACE), "line-classes")
    lines = document_lines(docs, id_col, text_col, SQL_SPACE).select("doc", "row", "pos", *_hashes(F.col("line")))
    key, of = ["h1", "h2"], classes.select("h1", "h2", "place", "n_links", F.col("kept").alias("stays"))
    frequent = few(classes.where(F.col("n_times") >= FREQUENT).select(*key), BROADCAST_ROWS)
    met = lines.join(few(of.join(frequent, key, "left_semi"), BROADCAST_ROWS), key)
    met = met.union(lines.join(frequent, key, "left_anti").join(of, key).select(*met.columns))
    first = F.col("place.doc").eqNullSafe(F.col("doc")) & (F.col("place.row") == F.col("row")) & (F.col("place.pos") == F.col("pos"))
    return met.select(F.col("doc").alias(id_col), F.col("pos").alias("line_no"), F.col("place.doc").alias(f"first_{id_col}"), F.col("place.pos").alias("first_line_no"), "n_links", (first & F.col("stays")).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """docs without lines seen before: a line stays where it occurs first alone, if no earlier one is within the edits.

    Documents left without any word go; lines without a word stay where they are. Columns are those of docs.
    """
    row, stay, lines, blank = (unused(docs, n) for n in ("row", "stay", "lines", "blank"))
    kept = _classes(docs, id_col, text_col, edits).where("kept").groupBy(F.col("place.row").alias(row)).agg(F.collect_list("place.pos").alias(stay))
    text = F.col(text_col).cast("string")
    numbered = F.transform(split_lines(text), lambda x, i: F.when(~has_word(x), i))
    cut = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.xxhash64(F.col(id_col), text).alias(row), split_lines(text).alias(lines), F.filter(numbered, lambda i: i.isNotNull()).alias(blank))
    met = cut.join(kept, row)  # below the join, lines are made once; above it, they are looked up by number
    left = F.array_join(F.transform(F.array_sort(F.concat(stay, blank)), lambda i: F.get(F.col(lines), i)), "\n")
    out = met.withColumn(text_col, left)
    return out.select(*(F.length(text_col).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


#: DuckDB's form of the query over documents. Its distance counts bytes, so each pair gets an alphabet of its own of single bytes.
SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
 w AS (SELECT * FROM l WHERE regexp_matches(line, '[^ 	-
]')),
 c AS (SELECT line, min((doc_id, pos)) AS place, count(*) AS n_times, length(line) AS n FROM w GROUP BY line),
 s AS (SELECT line, n, least(2, n // 5) AS k, unnest([0, 1, 2]) AS d FROM c WHERE n >= 5),
 m AS (SELECT s.line AS a, c.line AS b, s.k AS k, list_distinct(string_split(s.line || c.line, '')) AS alphabet FROM s JOIN c ON c.n = s.n + s.d AND s.d <= s.k AND (s.d > 0 OR s.line < c.line)
   AND len(list_intersect(list_distinct(string_split(s.line, '')), list_distinct(string_split(c.line, '')))) >= len(list_distinct(string_split(s.line, ''))) - 2),
 e AS (SELECT a, b FROM m WHERE levenshtein(array_to_string(list_transform(string_split(a, ''), lambda x: chr(list_position(alphabet, x))), ''),
   array_to_string(list_transform(string_split(b, ''), lambda x: chr(list_position(alphabet, x))), '')) <= k),
 x AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 k AS (SELECT x.a AS line, count(*) AS n_links, bool_or(cb.place < ca.place) AS later FROM x JOIN c ca ON ca.line = x.a JOIN c cb ON cb.line = x.b GROUP BY x.a)
SELECT c.place[1] AS doc_id, c.place[2]::INTEGER AS line_no, c.n_times::BIGINT AS n_times, coalesce(k.n_links, 0)::BIGINT AS n_links, NOT coalesce(later, false) AS kept
FROM c LEFT JOIN k USING (line)
"""

#: The same for the lines of each document.
MEMBERS_SQL = (
    SQL.rpartition("SELECT c.place[1]")[0]
    + """SELECT w.doc_id, w.pos::INTEGER AS line_no, c.place[1] AS first_doc_id, c.place[2]::INTEGER AS first_line_no, coalesce(k.n_links, 0)::BIGINT AS n_links,
 w.doc_id IS NOT DISTINCT FROM c.place[1] AND w.pos = c.place[2] AND NOT coalesce(k.later, false) AS kept
FROM w JOIN c ON w.line = c.line LEFT JOIN k ON w.line = k.line
"""
)
