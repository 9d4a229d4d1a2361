"""Suffix-array dedup: passages of MIN_WORDS words or more that stand in more than one document.

Suffixes are kept only where the least GRAM-word hash of 16 neighbouring ones begins. Every stretch of
MIN_WORDS words holds such a place among its first 16 words, chosen by the stretch alone, so both of
its occurrences keep the same suffix with SEED words of the stretch to its right. The suffixes are
sorted by the hash of those SEED words, then by the words around them, of which a suffix carries REACH on
either side. For each way to share REACH words out to the left and the right, the suffixes of a seed are
grouped by all MIN_WORDS words; a group of two documents or more is a match. So every shared stretch is
found, whatever else holds its seed. Longer passages hold many kept suffixes, and their matches are united.

Plan: one Arrow pass makes about one row for eight words, range-partitioned and sorted by (seed,
surroundings, document), so a passage in a third of all documents is dealt over as many partitions as
it needs. Seeds are grouped within a partition. Other partitions may hold its first and last seed too: rows of
these go out gathered by their class, the seed and its surroundings; what a class meets in all partitions
comes from an aggregation over its stretches and the two least documents that each partition has of a stretch.
No pairs are listed. Matches are united per document.

Surrounding words are compared by 16-bit hashes: an end may reach a word too far once in 65,536.

Defined results: null, empty and shorter texts have no passages; rows without an id are not compared;
repeated rows, being one document, do not match each other; columns beside id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidejoin.llm.staging import few, staged
from tidejoin.llm.text import Words, inside_text, mix64, ngram_hashes, slices

MIN_WORDS, GRAM, NEIGHBOURS = 50, 8, 16
REACH = NEIGHBOURS - 1
SEED = MIN_WORDS - REACH
#: Classes of edge rows up to which they are broadcast.
BROADCAST_ROWS = 200_000
_SUFFIX = "doc long, at int, seed long, around binary"
_WIDTH = 4 * REACH + 2  # left words outwards, right words, and how many of each there are


def _window_min(x: np.ndarray) -> np.ndarray:
    """The least of each 16 neighbours."""
    for step in (1, 2, 4, 8):
        x = np.minimum(x[:-step], x[step:])
    return x


def _kept_places(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where suffixes are kept, if SEED words follow."""
    span = GRAM + NEIGHBOURS - 1
    if len(h) < max(span, SEED):
        return np.zeros(0, int)
    grams = ngram_hashes(h, GRAM)
    place = np.arange(len(grams), dtype=np.uint64) & np.uint64(0xFFFFFF)
    least = _window_min(grams & ~np.uint64(0xFFFFFF) | place)  # ties go to the left
    inside = inside_text(first, span, len(h))
    start = np.flatnonzero(inside)
    offset = (least[start] - (start.astype(np.uint64) & np.uint64(0xFFFFFF))) & np.uint64(0xFFFFFF)
    at = np.unique(start + offset.astype(np.int64))
    room = inside_text(first, SEED, len(h))
    at = at[at < len(room)]
    return at[room[at]]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1)
        for low, high in slices(texts):
            w = Words(texts.slice(low, high - low))
            h = w.hashes()
            at = _kept_places(h, w.first)
            if not len(at):
                continue
            text = np.searchsorted(w.first, at, "right") - 1
            begin, end = w.first[text], w.first[text + 1]
            seeds = ngram_hashes(h, 5)  # SEED = 35 words are seven groups of five
            seed = np.zeros(len(at), np.uint64)
            for k in range(0, SEED, 5):
                seed = mix64(seed * np.uint64(0x9E3779B97F4A7C15) + seeds[at + k])
            short = np.pad((h >> np.uint64(48)).astype(np.uint16), (REACH, REACH + SEED))
            left = short[at[:, None] + np.arange(REACH - 1, -1, -1)]
            right = short[at[:, None] + np.arange(REACH + SEED, 2 * REACH + SEED)]
            n_left = np.minimum(at - begin, REACH)
            n_right = np.minimum(end - at - SEED, REACH)
            left[np.arange(REACH) >= n_left[:, None]] = 0
            right[np.arange(REACH) >= n_right[:, None]] = 0
            around = np.concatenate((left.view(np.uint8), right.view(np.uint8), np.column_stack((n_left, n_right)).astype(np.uint8)), axis=1)
            raw = pa.py_buffer(np.ascontiguousarray(around))
            offsets = pa.py_buffer((np.arange(len(at) + 1) * _WIDTH).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[low:high][text]), pa.array((at - begin).astype(np.int32)), pa.array(seed.view(np.int64)), pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, raw])],
                ["doc", "at", "seed", "around"],
            )


def _chunks(seed: np.ndarray, rows: np.ndarray, most: int = 65_536) -> Iterator[np.ndarray]:
    """rows, which are in order of seed, in parts of about `most` that do not divide a seed."""
    starts = np.flatnonzero(np.concatenate(([True], seed[rows][1:] != seed[rows][:-1]))) if len(rows) else np.zeros(0, int)
    low = 0
    while low < len(rows):
        at = np.searchsorted(starts, low + most)
        high = int(starts[at]) if at < len(starts) else len(rows)
        yield rows[low:high]
        low = high


def _splits(seed: np.ndarray, around: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words to the left: (number, rows that carry as many and the rest to the right, hash of these MIN_WORDS words)."""
    words = np.ascontiguousarray(around[:, : 4 * REACH]).view(np.uint16).astype(np.uint64) + np.uint64(1)
    add = lambda h, w: mix64(h * np.uint64(0x9E3779B97F4A7C15) + w)
    right = [np.full(len(seed), 7, np.uint64)]
    for k in range(REACH):
        right.append(add(right[-1], words[:, REACH + k]))
    left = mix64(seed.view(np.uint64))
    for i in range(REACH + 1):
        rows = np.flatnonzero((around[:, 4 * REACH] >= i) & (around[:, 4 * REACH + 1] >= REACH - i))
        yield i, rows, add(left[rows], right[REACH - i][rows])
        if i < REACH:
            left = add(left, words[:, i])


def _least_two(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group of each row, keys of groups, least document of each, next document of each or the same if there is none)."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    number = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    second = d[first]
    other = np.flatnonzero(~new & np.concatenate(([False], d[1:] != d[:-1])))
    of, at = np.unique(number[other], return_index=True)
    second[of] = d[other[at]]
    group = np.empty(len(key), np.int64)
    group[order] = number
    return group, k[first], d[first], second


def _matches(doc: np.ndarray, at: np.ndarray, seed: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, end, other document) of the rows, sorted by seed, with MIN_WORDS words that another document's row has too."""
    starts = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
    several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
    parts = []
    for part in _chunks(seed, np.flatnonzero(np.repeat(several, np.diff(np.append(starts, len(seed)))))):
        most, least, other = np.full(len(part), -1), np.full(len(part), REACH + 1), np.full(len(part), np.iinfo(np.int64).max)
        d = doc[part]
        for i, rows, key in _splits(seed[part], around[part]):
            if not len(rows):
                continue
            group, _, one, two = _least_two(key, d[rows])
            hit = one[group] != two[group]
            rows, group = rows[hit], group[hit]
            most[rows] = i
            least[rows] = np.minimum(least[rows], i)
            other[rows] = np.minimum(other[rows], np.where(d[rows] == one[group], two[group], one[group]))
        hit = np.flatnonzero(most >= 0)
        parts.append((part[hit], at[part[hit]] - most[hit], at[part[hit]] + MIN_WORDS - least[hit], other[hit]))
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4))


#: Rows of several kinds, told apart by what is null: matches (start), edge rows of a class (docs, ats), stretches of a class (split), documents of a
#: stretch (key, doc). Matches have a class that is none, to be dealt by.
_FOUND = "doc long, start int, end int, other long, docs array<long>, ats array<int>, class long, split int, key long"
#: Edge rows of a class that go out as one row at most.
TOGETHER = 4_096


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of a sorted partition. Its first and last seed may be in other partitions, too: of these, every row with its class (seed
    and surroundings), the stretches of each class, and the two least documents of every stretch."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    t = pa.Table.from_batches(found).combine_chunks()
    doc, at, seed = (t.column(c).to_numpy() for c in ("doc", "at", "seed"))
    around = np.frombuffer(b"".join(t.column("around").to_pylist()), np.uint8).reshape(-1, _WIDTH)
    def rows(n: int, **columns: np.ndarray) -> pa.RecordBatch:
        plain = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
        types = {name: plain[kind] for name, kind in (x.split() for x in _FOUND.split(", "))}
        return pa.RecordBatch.from_arrays([pa.array(columns[c]).cast(k) if c in columns else pa.nulls(n, k) for c, k in types.items()], list(types))

    outer = (seed == seed[0]) | (seed == seed[-1])
    inner, edge = np.flatnonzero(~outer), np.flatnonzero(outer)
    if len(inner):
        row, start, end, other = _matches(doc[inner], at[inner], seed[inner], around[inner])
        yield rows(len(row), doc=doc[inner][row], start=start, end=end, other=other, **{"class": doc[inner][row]})
    marks = mix64(seed[edge].view(np.uint64))
    for column in np.ascontiguousarray(np.pad(around[edge], ((0, 0), (0, -_WIDTH % 8)))).view(np.uint64).T:
        marks = mix64(marks * np.uint64(0x9E3779B97F4A7C15) + column)
    order = np.argsort(marks, kind="stable")
    new = np.concatenate(([True], marks[order][1:] != marks[order][:-1]))
    begin = np.flatnonzero(new)
    since = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    cut = np.flatnonzero(since % TOGETHER == 0)
    offsets = pa.array(np.append(cut, len(order)).astype(np.int32))
    lists = {"docs": pa.ListArray.from_arrays(offsets, pa.array(doc[edge][order])), "ats": pa.ListArray.from_arrays(offsets, pa.array(at[edge][order]))}
    yield rows(len(cut), **lists, **{"class": marks[order][cut].view(np.int64)})
    _, once = np.unique(marks, return_index=True)
    firsts = np.zeros(len(edge), bool)
    firsts[once] = True
    for i, place, key in _splits(seed[edge], around[edge]):
        if len(place):
            own = firsts[place]
            yield rows(int(own.sum()), split=np.full(int(own.sum()), i), key=key[own].view(np.int64), **{"class": marks[place][own].view(np.int64)})
            _, keys, one, two = _least_two(key, doc[edge][place])
            more = one != two
            yield rows(len(one) + int(more.sum()), doc=np.concatenate((one, two[more])), key=np.concatenate((keys, keys[more])).view(np.int64))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, n_words, other_id): united passages of each document that other documents have too.

    Words are counted from 0, end_word exclusive; other_id is the least other document that has MIN_WORDS words of it. The id has to be an integer.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    order = ["seed", "around", "doc", "at"]
    suffixes = rows.mapInArrow(_suffixes, _SUFFIX).repartitionByRange(*order).sortWithinPartitions(*order)
    found = staged(suffixes.mapInArrow(_compare, _FOUND), "suffix-matches")
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, 2)
    both = found.where("key IS NOT NULL AND doc IS NOT NULL").groupBy("key").agg(least(F.collect_set("doc")).alias("docs")).where("size(docs) > 1")  # two a partition at most
    stretches = found.where("split IS NOT NULL").select("class", "split", "key").distinct().join(both, "key")
    met = stretches.groupBy("class").agg(F.max("split").alias("most"), F.min("split").alias("least"), least(F.flatten(F.collect_list("docs"))).alias("docs"))  # 16 splits at most
    every = found.where("start IS NOT NULL OR docs IS NOT NULL").select("doc", "start", "end", "other", "ats", F.col("docs").alias("of"), "class").join(few(staged(met, "suffix-classes"), BROADCAST_ROWS), "class", "left")
    other = lambda doc: F.when(doc == F.col("docs")[0], F.col("docs")[1]).otherwise(F.col("docs")[0])
    match = lambda doc, start, end, other: F.struct(doc.alias("doc"), start.cast("int").alias("start"), end.cast("int").alias("end"), other.alias("other"))
    edge = F.zip_with("of", "ats", lambda doc, at: match(doc, at - F.col("most"), at + MIN_WORDS - F.col("least"), other(doc)))
    inner = F.array(match(*(F.col(c) for c in ("doc", "start", "end", "other"))))
    every = every.where("start IS NOT NULL OR docs IS NOT NULL")  # a class that meets nothing has no documents
    matches = every.select(F.explode(F.when(F.col("start").isNotNull(), inner).otherwise(edge)).alias("m")).select("m.*")

    by_start = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    parts = matches.withColumn("part", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("part", F.sum("part").over(by_start))
    united = parts.groupBy("doc", "part").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other_id"))
    return united.select(F.col("doc").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_id")
