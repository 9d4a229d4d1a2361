"""Vectorised word handling on Arrow text columns.

A column of texts is handled in slices of a few MB: word bounds and 64-bit word hashes come from
numpy passes over the bytes, so no Python object is made per word. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {"p": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        full = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        full[0] = 1
        _powers[name] = np.multiply.accumulate(full)
    return _powers[name][:n]


class Words:
    """The words of a slice of texts.

    data: the bytes; offsets: where each text starts (one more than texts); starts, ends: byte bounds
    of each word; first: the index of each text's first word (one more than texts).
    """

    def __init__(self, texts: pa.Array, lower: bool = False, outside: np.ndarray = _SPACE):
        """outside: for each byte value, whether it parts words."""
        offsets, data = _buffers(texts)
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(self.data)
        inside = ~outside[self.data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.inside = inside
        self.starts = np.flatnonzero(inside & (~before | cut[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._sums: np.ndarray | None = None

    @property
    def count(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans."""
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _power("p", _P, n), out=self._sums[1:])
        inv = _power("inv", _P_INV, len(self.data) + 1)
        raw = (self._sums[ends] - self._sums[starts]) * inv[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array over each text."""
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[self.offsets])

    def per_text_of_words(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-word array over each text."""
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[self.first])


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text each; a longer text is a range of its own."""
    offsets, _ = _buffers(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word, without regard to text bounds; the last n - 1 are missing."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def inside_text(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which starts leave room for n words in their text, of the total - n + 1 starts."""
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):
        at = first[1:] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def map_texts(df: DataFrame, outputs: T.StructType | str, of_slice: Callable[[pa.Array], dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, outputs...) of every row: of_slice gets some texts and returns one array per output column.

    Only the two columns named are read, so other columns and their names do not matter.
    """
    added = T._parse_datatype_string(outputs) if isinstance(outputs, str) else outputs
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *added.fields])
    names = added.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, high in slices(texts):
                out = of_slice(texts.slice(low, high - low))
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), *(pa.array(out[n]) for n in names)], [id_col, *names])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
