"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification, components.

A document's set is its distinct word shingles. Two permutations make the whole signature: the first
scatters the shingles on a ring of 2**32 places, the second, turned by one place for each coordinate,
ranks them. With BANDS bands of ROWS coordinates, a pair at the threshold misses every band with
probability (1 - 0.8**ROWS)**BANDS, below 1e-7.

Links are found without listing the pairs of a bucket:
1. Equal sets are one class, found by aggregation; only class representatives go on.
2. Each bucket links its members to one hub, the member that shares most buckets with others. The
   links are verified on full sets, and components are taken.
3. What remains are pairs in one bucket but in different components. Their size bound and an odd
   sketch (2048 parities; differing bits never exceed differing shingles) rule out nearly all without
   loss; every pair left is verified on full sets. So each pair that shares a bucket is either joined
   through its component, excluded by an exact bound, or verified.

Defined results: null and empty texts have the empty set and are linked with nothing; rows without an
id keep a null component and stay; repeated rows are one node; an id with several texts is one node that has all
their sets, and is linked with whatever any of them is like; ties take the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidejoin.llm.components import components
from tidejoin.llm.staging import few, staged
from tidejoin.llm.text import Words, map_texts, mix64, ngram_hashes

BANDS, ROWS = 32, 4
SKETCH_BITS = 2_048
#: Least similarity, in hundredths.
SIMILAR = 80

#: Ids up to which those of texts to verify are broadcast (16 MB); beyond, texts are shuffled once.
BROADCAST_ROWS = 1_000_000

_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]
_FEATURES = "n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"


def _mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS coordinates of a set of 64-bit shingle hashes."""
    ring = _mix32((shingles >> np.uint64(32)).astype(np.uint32) + np.uint32(0x9E3779B9))
    out = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for low in range(0, len(ring), 2_048):
        np.minimum(out, _mix32(ring[None, low : low + 2_048] + _SHIFTS).min(1), out=out)
    return out


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    h = w.hashes()
    grams = ngram_hashes(h, width)
    for low, high in zip(w.first[:-1], w.first[1:], strict=True):
        if high - low >= width:
            yield np.unique(grams[low : high - width + 1])
        elif high > low:
            whole = np.zeros(1, np.uint64)
            for x in h[low:high]:
                whole = mix64(whole * np.uint64(0x9E3779B97F4A7C15) + x)
            yield mix64(whole + np.uint64(high - low))
        else:
            yield np.zeros(0, np.uint64)


def _features(texts: pa.Array, width: int) -> dict:
    out: dict[str, list] = {"n_shingles": [], "s1": [], "s2": [], "bands": [], "sketch": []}
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for s in shingle_sets(texts, width):
        out["n_shingles"].append(len(s))
        out["s1"].append(int(np.add.reduce(mix64(s + np.uint64(1)), dtype=np.uint64).astype(np.int64)))
        out["s2"].append(int(np.add.reduce(mix64(s ^ np.uint64(0x5BD1E995)), dtype=np.uint64).astype(np.int64)))
        if len(s):
            pairs = signature(s).astype(np.uint64).reshape(BANDS, ROWS // 2, 2)
            words = pairs[..., 0] << np.uint64(32) | pairs[..., 1]
            band = salt
            for k in range(ROWS // 2):
                band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
            out["bands"].append(band.view(np.int64).tolist())
        else:
            out["bands"].append([])
        out["sketch"].append(np.packbits(np.bincount((s % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes())
    types = {"bands": pa.list_(pa.int64()), "sketch": pa.binary()}
    return {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()}


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)


def _possible(differ: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets of these summed sizes can be similar though `differ` shingles at least are in one alone."""
    return (100 + SIMILAR) * differ <= (100 - SIMILAR) * sizes


def _unlike_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one bucket and different labels that the sketches do not rule out; rows come sorted by bucket."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    t = pa.Table.from_batches(found)
    key, node, label, n = (t.column(c).to_numpy() for c in ("key", "node", "label", "n"))
    sketch = _sketches(t.column("sketch"))
    bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        labels, inverse, counts = np.unique(label[low:high], return_inverse=True, return_counts=True)
        rest = np.flatnonzero(inverse != counts.argmax())
        out_a, out_b = [], []
        for i in rest:
            # against the largest component, and against later rows of the others
            other = np.flatnonzero((inverse != inverse[i]) & ((inverse == counts.argmax()) | (np.arange(high - low) > i)))
            differ = np.bitwise_count(sketch[low + other] ^ sketch[low + i]).sum(1)
            ok = other[_possible(differ, n[low + other] + n[low + i])]
            out_a.append(np.full(len(ok), node[low + i])), out_b.append(node[low + ok])
        if out_a and sum(map(len, out_a)):
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= SIMILAR * (len(a) + len(b) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        differ = np.bitwise_count(_sketches(batch.column("sketch_a")) ^ _sketches(batch.column("sketch_b"))).sum(1)
        ok = _possible(differ, batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy())
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _with_both(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    for s in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns)), s)
    return pairs


def near_duplicates(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; the id has to be an integer.

    width: words in a shingle.
    """
    pair = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    seen = staged(map_texts(rows, _FEATURES, lambda texts: _features(texts, width), "node", "text"), "signatures")

    some = seen.where("n_shingles > 0 AND node IS NOT NULL")
    classes = some.groupBy("s1", "s2").agg(F.min("node").alias("class"))
    named = some.join(classes, ["s1", "s2"])
    firsts = named.where("node = class").dropDuplicates(["node", "s1", "s2"])  # a node has a row for each set
    firsts = staged(firsts.select("node", F.col("n_shingles").alias("n"), "bands", "sketch"), "classes")

    shared = Window.partitionBy("key")
    members = firsts.select("node", F.explode("bands").alias("key")).withColumn("c", F.count("*").over(shared)).where("c > 1")
    members = staged(members, "buckets")
    central = members.groupBy("node").agg(F.sum("c").alias("central"))
    members = members.join(central, "node").select("key", "node", "central")
    hubs = members.groupBy("key").agg(F.max(F.struct("central", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    star = members.join(hubs, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    star = staged(_with_both(star, firsts, ["n", "sketch"]).mapInArrow(_rule_out, pair).distinct(), "star")

    def verified(pairs: DataFrame) -> DataFrame:
        needed = staged(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "needed")
        texts = rows.join(few(needed, BROADCAST_ROWS), "node", "left_semi")
        of = lambda t: {"shingles": pa.array([s.tobytes() for s in shingle_sets(t, width)], pa.binary())}
        sets = staged(map_texts(texts, "shingles binary", of, "node", "text").distinct().withColumnRenamed("shingles", "set"), "sets")
        return staged(_with_both(pairs, sets, ["set"]).mapInArrow(_alike, pair).distinct(), "verified")

    # an id with several sets links the classes of all of them
    several = named.groupBy("node").agg(F.min("class").alias("a"), F.max("class").alias("most")).where("a < most")
    same_id = named.select("node", F.col("class").alias("b")).join(several, "node").where("a < b").select("a", "b").distinct()
    links = verified(star).union(staged(same_id, "same-id"))
    labels = components(links)
    left = members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    left = left.withColumn("low", F.min("label").over(shared)).withColumn("high", F.max("label").over(shared)).where("low < high")
    left = left.join(firsts.select("node", "n", "sketch"), "node").select("key", "node", "label", "n", "sketch")
    more = left.repartition("key").sortWithinPartitions("key").mapInArrow(_unlike_pairs, pair).distinct().join(star, ["a", "b"], "left_anti")
    more = verified(staged(more, "unlike"))
    if not more.isEmpty():
        labels = components(links.union(more))

    components_of = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select("s1", "s2", F.coalesce("label", "class").alias("component"))
    out = seen.select("node", "n_shingles", "s1", "s2").join(components_of, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("node"))
    component = F.when(F.col("node").isNotNull(), component)
    return out.select(F.col("node").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("node") == component, F.lit(True)).alias("kept"))


