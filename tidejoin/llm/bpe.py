"""BPE encoding and decoding by tree concatenation.

A text is cut where a space follows a character that is not white space: the splitting pattern of
byte-level BPE always breaks there, so the units on both sides are encoded apart and their ids joined
without change. Units recur, so each task encodes the distinct ones of a slice once and keeps them. New
units are encoded in runs, one after another as in a text, and the ids of a run are dealt to its units by
the bytes that each token stands for; units that may not follow each other, or whose bytes do not come
out even, are encoded apart. Ids of texts are put together from those of units in Arrow and numpy.

A unit longer than LEAF code points has no such place (long unsplit text). It becomes a binary tree of
halves whose leaves are encoded apart; on the way up, a window around each join is encoded again and
grows until its ids agree with both sides over whole tokens. Ids on either side of the window then
follow each other as they do in an encoding of the whole. Texts that hold a unit longer than SPREAD
are cut into leaves as rows, so that executors share the leaves of one text, and joined by text after.

Defined results: null counts as empty (no ids); repeated rows give repeated results; ids of rows may
be null (their long texts are kept apart by a row number made up in the scan).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidejoin.llm.text import _buffers, slices

#: Longest unit, in code points, that is encoded in one piece.
LEAF = 2_048
#: Longest unit that one task encodes alone.
SPREAD = 65_536
#: Least tokens that a window must share with either side.
AGREE = 3
#: Bytes of the units that a Python worker keeps between slices (each takes some 200 bytes besides).
KEEP = 1_000_000
#: New units that are encoded as one run.
RUN = 500

#: Byte values of white space, and its characters beyond ASCII as numbers of two and three bytes.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WIDE_WHITE = np.array([int.from_bytes(chr(i).encode()) for i in range(128, 0x10000) if chr(i).isspace()])
_ODD_SPACE = re.compile(r"\s ")  # a space after white space is not a safe cut

Ids = list[int]


class Codec:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Keeps nothing: the number of each unit, the ids of all units, and where each unit's begin (and the last one's end)."""
        self.kept: dict[bytes, int] = {}
        self.ids, self.first, self.size = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def plain(self, texts: list[str]) -> list[Ids]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode_unit(self, unit: str) -> Ids:
        """Ids of a unit of any length: special tokens are set apart, long stretches go through the tree."""
        if len(unit) <= LEAF:
            return self.plain([unit])[0]
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", unit) if self.special else [unit]
        out: Ids = []
        for part in parts:
            if len(part) <= LEAF:
                out += self.plain([part])[0] if part else []
            else:
                leaves = [part[a:b] for a, b in leaf_bounds(len(part), LEAF)]
                out += concatenate(list(zip(leaves, self.plain(leaves), strict=True)), self)[1]
        return out

    def numbers(self, units: list[bytes]) -> np.ndarray:
        """The number of each unit (no two are the same); those that are not kept yet are encoded first."""
        if self.size > KEEP and any(u not in self.kept for u in units):
            old = [u for u in units if u in self.kept]
            ids, first = runs(self.ids, self.first, np.array([self.kept[u] for u in old], np.int64))
            self.forget()
            self.keep(old, ids, first)
        self.keep_new([u for u in units if u not in self.kept])
        return np.fromiter((self.kept[u] for u in units), np.int64, len(units))

    def keep(self, units: list[bytes], ids: np.ndarray, first: np.ndarray) -> None:
        """Keeps units whose ids follow each other; first: where each unit's begin."""
        self.kept |= zip(units, range(len(self.kept), len(self.kept) + len(units)), strict=True)
        self.first = np.concatenate((self.first, first[1:] + len(self.ids)))
        self.ids = np.concatenate((self.ids, ids))
        self.size += sum(map(len, units))

    def keep_new(self, units: list[bytes]) -> None:
        apart, fit = [], []
        for u in units:
            text = u.decode()
            (fit if len(text) <= LEAF and text[0] == " " and not text[-1].isspace() else apart).append(u)
        for low in range(0, len(fit), 100 * RUN):
            some = fit[low : low + 100 * RUN]
            found = self.tokenizer.encode_batch_fast([b"".join(some[k : k + RUN]).decode() for k in range(0, len(some), RUN)], add_special_tokens=False)
            ids = np.array([i for e in found for i in e.ids], np.int32)
            ends = np.cumsum(self.token_sizes[ids])
            bounds = np.cumsum([len(u) for u in some])
            first = np.concatenate(([0], np.searchsorted(ends, bounds) + 1))
            if len(ids) and first[-1] == len(ids) and (ends[first[1:] - 1] == bounds).all():
                self.keep(some, ids, first)
            else:
                apart += some
        texts = [u.decode() for u in apart]
        short = iter(self.plain([t for t in texts if len(t) <= LEAF]))
        found = [next(short) if len(t) <= LEAF else self.encode_unit(t) for t in texts]
        self.keep(apart, np.array([i for x in found for i in x], np.int32), np.cumsum([0, *map(len, found)]))

    @cached_property
    def token_sizes(self) -> np.ndarray:
        """How many bytes each token stands for."""
        return np.array([len(x) for x in self.tables[1].to_pylist()], np.int64)

    @cached_property
    def tables(self) -> tuple[pa.Array, pa.Array]:
        """Every id as a decimal, and the bytes that it stands for."""
        known = set(self.tokenizer.get_vocab(with_added_tokens=True).values())
        n = max(known) + 1
        return pa.array(map(str, range(n)), pa.large_string()), pa.array([self.token_bytes(i) if i in known else b"" for i in range(n)], pa.large_binary())

    @lru_cache(maxsize=None)  # noqa: B019  one codec a worker, and as many entries as the vocabulary has
    def token_bytes(self, i: int) -> bytes:
        """The bytes that a token stands for: byte-level vocabularies write each byte as one printable character."""
        token = self.tokenizer.id_to_token(i)
        return token.encode() if token in self.special else bytes(_byte_of()[c] for c in token)

    def pieces(self, ids: Ids) -> list[bytes]:
        return [self.token_bytes(i) for i in ids]


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in means: printable Latin-1 stands for itself, the rest follow from 256 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def leaf_bounds(n: int, leaf: int) -> list[tuple[int, int]]:
    """Bounds of the leaves when [0, n) is halved until no part is longer than leaf."""
    if n <= leaf:
        return [(0, n)]
    parts = 1
    while -(-n // parts) > leaf:
        parts *= 2
    edges = [n * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


def join_two(left: tuple[str, Ids], right: tuple[str, Ids], c: Codec) -> tuple[str, Ids]:
    """The encoding of two adjoining texts, from their own encodings."""
    (a, x), (b, y) = left, right
    text = a + b
    reach = 8
    while True:
        i, j = max(0, len(x) - reach), min(len(y), reach)
        # bytes of the tokens inside the window; a window may only begin and end between characters
        while i > 0 and not _starts_character(c, x, i):
            i -= 1
        while j < len(y) and not _starts_character(c, y, j):
            j += 1
        if i == 0 and j == len(y):
            return text, c.plain([text])[0]
        before = len(b"".join(c.pieces(x[i:])).decode()) if i < len(x) else 0
        after = len(b"".join(c.pieces(y[:j])).decode())
        window = c.plain([a[len(a) - before :] + b[:after]])[0]
        k = AGREE
        if (i == 0 or window[:k] == x[i : i + k]) and (j == len(y) or window[-k:] == y[max(0, j - k) : j]):
            return text, x[:i] + window + y[j:]
        reach *= 2


def _starts_character(c: Codec, ids: Ids, at: int) -> bool:
    return (c.token_bytes(ids[at])[0] & 0xC0) != 0x80


def concatenate(parts: list[tuple[str, Ids]], c: Codec) -> tuple[str, Ids]:
    """Joins neighbours, then neighbours of those, until one is left."""
    while len(parts) > 1:
        parts = [join_two(parts[k], parts[k + 1], c) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def units_of(text: str) -> list[str]:
    """The text cut before each space that follows a character other than white space."""
    if not text:
        return []
    if "  " not in text and _ODD_SPACE.search(text) is None and text[0] != " ":
        head, *rest = text.split(" ")
        return [head, *(" " + r for r in rest)]
    out, low = [], 0
    for m in re.finditer(r"(?<=\S) ", text):
        if m.start() > low:
            out.append(text[low : m.start()])
            low = m.start()
    out.append(text[low:])
    return out


def unit_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where units of UTF-8 texts start, as in units_of."""
    at = np.flatnonzero(data[1:] == 0x20) + 1
    at = at[~_WHITE[data[at - 1]]]
    last = [np.where(at >= k, data[at - k], 0).astype(np.int64) for k in (1, 2, 3)]
    two = last[0] | last[1] << 8
    white = (last[0] >= 0x80) & (np.isin(two, _WIDE_WHITE) | np.isin(two | last[2] << 16, _WIDE_WHITE))
    starts = np.zeros(len(data), bool)
    starts[at[~white]] = True
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(starts)


def runs(values: np.ndarray, first: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values with these numbers, one after another, and where each begins (and the last one ends). first: the same of all runs."""
    length = first[numbers + 1] - first[numbers]
    bounds = np.concatenate(([0], np.cumsum(length)))
    return values[np.arange(bounds[-1]) + np.repeat(first[numbers] - bounds[:-1], length)], bounds


def encode_texts(texts: list[str] | pa.Array, c: Codec) -> Iterator[tuple[int, str, bytes]]:
    """(number of ids, ids as decimals joined by commas, decoded bytes) of each text."""
    offsets, data = _buffers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    starts = unit_starts(offsets, data)
    bounds = np.append(starts, len(data)).astype(np.int64)
    units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    numbers = c.numbers(units.dictionary.to_pylist())[units.indices.to_numpy()]
    ids, first = runs(c.ids, c.first, numbers)
    of_text = first[np.searchsorted(starts, offsets)]
    joined = (pc.binary_join(pa.LargeListArray.from_arrays(of_text, table.take(pa.array(ids))), pa.scalar(sep, table.type)) for table, sep in zip(c.tables, (",", b""), strict=True))
    yield from zip(np.diff(of_text).tolist(), *(x.to_pylist() for x in joined), strict=True)


def _digests(n: int, ids: str, decoded: bytes) -> tuple[int, str, str]:
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest()


def _text(n: int, ids: str, decoded: bytes) -> tuple[list[int], str]:
    return [int(i) for i in ids.split(",")] if ids else [], decoded.decode("utf-8", "replace")


_OUT: dict[str, tuple[str, Callable, list]] = {
    "digests": ("n_tokens long, ids_sha256 string, decoded_sha256 string", _digests, [pa.int64(), pa.string(), pa.string()]),
    "ids": ("ids array<int>, decoded string", _text, [pa.list_(pa.int32()), pa.string()]),
}


def bpe_round_trip(docs: DataFrame, path: str, out: str = "digests", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text encoded with the vocabulary at `path` and decoded again.

    out: "ids" for the ids and the decoded text, "digests" for their number and SHA-256s.
    The vocabulary file has to be on every machine, like any installed package.
    """
    added, shape, arrow = _OUT[out]
    id_field = T.StructField(id_col, docs.schema[id_col].dataType)
    schema = T.StructType([id_field, *T._parse_datatype_string(added).fields])
    names = schema.fieldNames()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    unsplit = F.col("text").rlike(f"[^ ]{{{SPREAD}}}| {{{SPREAD}}}")  # a run of spaces, too, has no place to cut

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for low, high in slices(batch.column(1)):
                found = [shape(*x) for x in encode_texts(batch.column(1).slice(low, high - low), c)]
                columns = [pa.array(list(v), t) for v, t in zip(zip(*found, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], names)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        pattern = re.compile("(" + "|".join(map(re.escape, c.special)) + ")") if c.special else None
        for batch in batches:
            for row, i, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                made, group = [], 0
                for unit in units_of(text):
                    for part in pattern.split(unit) if pattern else [unit]:
                        if part:
                            made += [(row, i, group, part[a:b]) for a, b in leaf_bounds(len(part), SPREAD // 4)]
                            group += 1
                columns = [pa.array([m[k] for m in made], t) for k, t in ((0, pa.int64()), (1, batch.schema.field(1).type), (2, pa.int64()), (3, pa.string()))]
                yield pa.RecordBatch.from_arrays([columns[0], columns[1], columns[2], pa.array(range(len(made)), pa.int64()), columns[3]], ["row", id_col, "part", "leaf", "text"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [c.encode_unit(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    def join_text(frame: pd.DataFrame) -> pd.DataFrame:
        c, ids, decoded = codec(path), [], b""
        for _, part in frame.sort_values("leaf").groupby("part", sort=True):
            ids += concatenate([(t, list(map(int, x))) for t, x in zip(part["text"], part["ids"], strict=True)], c)[1]
        decoded = b"".join(c.pieces(ids))
        return pd.DataFrame([(frame[id_col].iloc[0], *shape(len(ids), ",".join(map(str, ids)), decoded))], columns=names)

    short = rows.where(~unsplit).mapInArrow(encode, schema)
    cut = T.StructType([T.StructField("row", T.LongType()), id_field, *T._parse_datatype_string("part long, leaf long, text string").fields])
    long = (
        rows.where(unsplit).select(F.monotonically_increasing_id().alias("row"), id_col, "text")
        .mapInArrow(leaves, cut).repartition("row", "leaf")
        .mapInArrow(encode_leaves, T.StructType([*cut.fields, *T._parse_datatype_string("ids array<int>").fields]))
        .groupBy("row").applyInPandas(join_text, schema)
    )
    return short.unionByName(long)
