"""Language-model scoring with a small causal self-attention model written and trained in numpy.

A word goes in as two subword ids (its beginning and its ending, hashed to fixed tables) and comes out
in two steps: attention over a window gives the probability of the word's class (a hashed beginning), as that of a group of
classes times that of the class within the group, and counts over all learning documents give the word within its class. As in the base measure, all words
never seen are one event, here one of each class, which counts as often as the class has kinds of words. The end of
a text is a class of its own. Windows of CONTEXT places overlap by CONTEXT - STRIDE, so that each token
is scored once, with some context before it; padding is masked.

Plan: word counts of blocks of documents are made next to the scan and added up by word (partial
aggregation; 64-bit hashes stand for words), then sent back to the blocks that hold the words, so
neither counts nor vocabulary ever meet in one place; only sums by class (257) come to the
driver. Training reads every token of every learning document once, next to the scan: a document's
consecutive windows belong to one of ROUNDS rounds, by a hash of id and text; in a round a task trains a
model on each TASK_WINDOWS windows, all from the same start, and the weights, of fixed size, are averaged
by an aggregation. Nothing but weights is shuffled; how the input is split decides which windows share a
model, so scores (not counts and base scores) vary a little with it. Scoring sorts each block's counts before
its texts, so that a task holds one block's words and one batch of texts, however large the block is.

Defined results: null and empty texts are one token, the end; words are as in the base measure; rows
without an id are one range of ids; repeated rows count and score alike; with nothing to learn from,
every class is equally likely and every word new.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidejoin.llm.staging import few, staged
from tidejoin.llm.text import Words, mix64, slices

CLASSES, STARTS, TAILS = 256, 1024, 512
#: The classes of words in equal groups: a class has the probability of its group times its own within the group. The end is a group of its own.
GROUPS, MEMBERS = 16, CLASSES // 16
WIDTH, INNER = 16, 32
CONTEXT, STRIDE = 32, 24
#: Rounds of averaging, and windows from which one model is trained before it is averaged with others.
ROUNDS, TASK_WINDOWS = 2, 20_000
#: Windows of a training step, and steps of a task in a round at least.
BATCH, LEAST_STEPS = 64, 100
#: Documents of a block: ids of the same multiple, and bytes of text from which they are more than one block.
BLOCK, BLOCK_BYTES = 4_000, 32_000_000
#: Ranges of ids of more than one block (a few numbers each) up to which their table is broadcast.
BROADCAST_ROWS = 1_000_000
_SHAPES = {
    "start": (STARTS + 1, WIDTH), "tail": (TAILS + 1, WIDTH), "place": (CONTEXT, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH),
    "w1": (WIDTH, INNER), "b1": (INNER,), "w2": (INNER, WIDTH), "u": (WIDTH, GROUPS + 1), "c": (GROUPS + 1,), "ug": (GROUPS, WIDTH, MEMBERS), "cg": (GROUPS, MEMBERS),
}
_FUTURE = np.triu(np.full((CONTEXT, CONTEXT), -1e9, np.float32), 1)
Weights = dict[str, np.ndarray]


def first_weights() -> Weights:
    rng = np.random.default_rng(12)
    return {k: (rng.normal(0, 0.3 if k in ("start", "tail") else 0.02 if k in ("u", "ug") else 0 if k == "cg" else s[0] ** -0.5 if len(s) > 1 else 0, s)).astype(np.float32) for k, s in _SHAPES.items()}


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in _SHAPES])


def unflat(x: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = np.asarray(x[at : at + n], np.float32).reshape(s)
        at += n
    return out


def _large(x: np.ndarray) -> bool:
    """Whether the greatest of a row has to be taken off before exp."""
    return not max(x.max(initial=0), -x.min(initial=0)) < 60


def hidden(w: Weights, start: np.ndarray, tail: np.ndarray) -> dict[str, np.ndarray]:
    """Everything up to the last hidden layer, for windows of ids (batch, CONTEXT)."""
    shape = start.shape
    x = w["start"].take(start, 0)
    x += w["tail"].take(tail, 0)
    x += w["place"][: shape[1]]
    flat_x = x.reshape(-1, WIDTH)  # products over all places at once, not window by window
    qkv = (flat_x @ np.concatenate((w["q"], w["k"], w["v"]), 1)).reshape(*shape, 3 * WIDTH)
    q, k, v = qkv[..., :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
    s = (q * np.float32(WIDTH**-0.5)) @ k.transpose(0, 2, 1)
    large = _large(s)
    s += _FUTURE[: shape[1], : shape[1]]
    if large:
        s -= s.max(-1, keepdims=True)
    np.exp(s, out=s)
    s /= (s.reshape(-1, shape[1]) @ np.ones(shape[1], s.dtype)).reshape(*shape, 1)
    a = s @ v
    y = flat_x + a.reshape(-1, WIDTH) @ w["o"]
    h = y @ w["w1"]
    h += w["b1"]
    np.maximum(h, 0, out=h)
    z = h @ w["w2"]
    z += y
    return {"x": x, "q": q, "k": k, "v": v, "s": s, "a": a} | {n: r.reshape(*shape, -1) for n, r in (("y", y), ("h", h), ("z", z))}


def _softmax(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Turns rows of logits into probabilities, in place; the natural log probability of place `at` of each row."""
    if _large(x):
        x -= x.max(-1, keepdims=True)
    rows = np.arange(len(x))
    found = x[rows, at]
    np.exp(x, out=x)
    sums = x @ np.ones(x.shape[1], x.dtype)
    x /= sums[:, None]
    return found - np.log(sums)


@dataclass
class Targets:
    """Probabilities of some targets, which come sorted: first of the group of classes, then of the class within its group."""

    log: np.ndarray  # natural log probability of each target
    z: np.ndarray  # hidden states, with a one
    group: np.ndarray
    of_group: np.ndarray  # probabilities of all groups
    member: np.ndarray  # of the words, which come before the ends of texts
    of_member: np.ndarray  # probabilities of all classes of the word's group
    edges: list[tuple[int, int]]  # the words of each group

    @classmethod
    def of(cls, w: Weights, z: np.ndarray, target: np.ndarray) -> Targets:
        one = np.ones((len(z), WIDTH + 1), z.dtype)
        one[:, :WIDTH] = z
        group = target // MEMBERS
        of_group = one @ np.concatenate((w["u"], w["c"][None]))
        log = _softmax(of_group, group)
        at = np.searchsorted(target, np.arange(0, CLASSES + 1, MEMBERS)).tolist()
        edges = list(zip(at[:-1], at[1:], strict=True))
        member = target[: at[-1]] % MEMBERS
        of_member = np.empty((at[-1], MEMBERS), z.dtype)
        inner = np.concatenate((w["ug"], w["cg"][:, None]), 1)
        for (low, high), mine in zip(edges, inner, strict=True):
            np.matmul(one[low:high], mine, out=of_member[low:high])
        log[: at[-1]] += _softmax(of_member, member)
        return cls(log, one, group, of_group, member, of_member, edges)

    def back(self, w: Weights, g: Weights) -> np.ndarray:
        """Gradients of minus the mean log probability: of the hidden states, and into g of the output layer."""
        n, words = np.float32(1 / max(1, len(self.log))), len(self.member)
        self.of_group[np.arange(len(self.group)), self.group] -= 1
        self.of_group *= n
        self.of_member[np.arange(words), self.member] -= 1
        self.of_member *= n
        both = self.of_group.T @ self.z
        g["u"], g["c"] = both[:, :WIDTH].T, both[:, WIDTH]
        dz = self.of_group @ w["u"].T
        inner = np.zeros((GROUPS, MEMBERS, WIDTH + 1), dz.dtype)
        for k, (low, high) in enumerate(self.edges):
            d = self.of_member[low:high]
            np.matmul(d.T, self.z[low:high], out=inner[k])
            dz[low:high] += d @ w["ug"][k].T
        g["ug"], g["cg"] = inner[..., :WIDTH].transpose(0, 2, 1), inner[..., WIDTH]
        return dz


def _sorted(target: np.ndarray) -> np.ndarray:
    """The order of targets, without padding (-1)."""
    order = np.argsort(target.astype(np.int16), kind="stable")
    return order[np.count_nonzero(target < 0) :]


def class_log_probs(w: Weights, z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target class, for rows of hidden states."""
    order, out = _sorted(target), np.zeros(len(z), z.dtype)
    out[order] = Targets.of(w, z.take(order, 0), target[order]).log
    return out


def gradients(w: Weights, start: np.ndarray, tail: np.ndarray, target: np.ndarray) -> tuple[float, Weights]:
    """Mean loss over targets of 0 and more, and its gradients."""
    f = hidden(w, start, tail)
    shape = start.shape
    two = lambda a: a.reshape(-1, a.shape[-1])
    order = _sorted(target.ravel())
    found = Targets.of(w, two(f["z"]).take(order, 0), target.ravel()[order])
    loss = -float(found.log.sum()) / max(1, len(order))
    g: Weights = {}
    z = two(f["z"])
    dz = np.zeros_like(z)
    dz[order] = found.back(w, g)
    ones = np.ones(len(z), z.dtype)
    dh = dz @ w["w2"].T
    dh *= two(f["h"]) > 0
    g["w2"], g["w1"], g["b1"] = two(f["h"]).T @ dz, two(f["y"]).T @ dh, ones @ dh
    dy = dh @ w["w1"].T
    dy += dz
    g["o"] = two(f["a"]).T @ dy
    da = (dy @ w["o"].T).reshape(f["a"].shape)
    s = f["s"]
    dqkv = np.empty((*shape, 3 * WIDTH), z.dtype)
    ds = da @ f["v"].transpose(0, 2, 1)
    ds -= ((da * f["a"]).reshape(-1, WIDTH) @ np.ones(WIDTH, z.dtype)).reshape(*shape, 1)
    ds *= s
    ds *= np.float32(WIDTH**-0.5)
    np.matmul(ds, f["k"], out=dqkv[..., :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), f["q"], out=dqkv[..., WIDTH : 2 * WIDTH])
    np.matmul(s.transpose(0, 2, 1), da, out=dqkv[..., 2 * WIDTH :])
    g["q"], g["k"], g["v"] = (a.T for a in np.split(two(dqkv).T @ two(f["x"]), 3))
    dx = two(dqkv) @ np.concatenate((w["q"], w["k"], w["v"]), 1).T
    dx += dy
    g["place"] = np.zeros(_SHAPES["place"], np.float32)
    g["place"][: shape[1]] = dx.reshape(*shape, WIDTH).sum(0)
    for name, ids in (("start", start), ("tail", tail)):
        cells = (ids.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
        g[name] = np.bincount(cells, dx.ravel(), np.prod(_SHAPES[name])).reshape(_SHAPES[name]).astype(np.float32)
    return loss, g


def train(w: Weights, start: np.ndarray, tail: np.ndarray, target: np.ndarray, rate: float = 4e-3, batch: int = BATCH) -> Weights:
    """One pass of Adam over the windows."""
    x = flat(w)
    w = unflat(x)  # views of x
    m, s, step_of = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    for step, low in enumerate(range(0, len(start), batch), 1):
        g = flat(gradients(w, start[low : low + batch], tail[low : low + batch], target[low : low + batch])[1])
        np.subtract(g, m, out=step_of)
        step_of *= np.float32(0.1)
        m += step_of
        np.multiply(g, g, out=g)
        g -= s
        g *= np.float32(0.01)
        s += g
        np.multiply(s, np.float32(1 / (1 - 0.99**step)), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-8)
        np.divide(m, g, out=step_of)
        step_of *= np.float32(rate / (1 - 0.9**step))
        x -= step_of
    return w


class Tokens:
    """Words of some texts with their ids; every text also has a beginning (input) and an end (target).

    Each kind of id is made when it is first asked for.
    """

    def __init__(self, words: Words):
        self.words = words

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        return cls(Words(texts, lower=True))

    def _id(self, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        return (self.words.span_hash(starts, ends) >> np.uint64(40)).astype(np.uint32) % np.uint32(n)

    @cached_property
    def hash(self) -> np.ndarray:
        return self.words.hashes()

    @cached_property
    def start(self) -> np.ndarray:
        w = self.words
        return self._id(w.starts, np.minimum(w.ends, w.starts + 4), STARTS)

    @cached_property
    def tail(self) -> np.ndarray:
        w = self.words
        return self._id(np.maximum(w.starts, w.ends - 3), w.ends, TAILS)

    @cached_property
    def word_class(self) -> np.ndarray:
        w = self.words
        return self._id(w.starts, np.minimum(w.ends, w.starts + 3), CLASSES)

    def sequences(self) -> tuple[np.ndarray, ...]:
        """(start ids, tail ids, targets, first): a place for each token to score, text after text."""
        n = self.words.count
        first = self.words.first + np.arange(len(n) + 1)
        inputs = np.ones(first[-1], bool)
        inputs[first[:-1]] = False  # the beginning of each text
        targets = np.ones(first[-1], bool)
        targets[first[1:] - 1] = False  # its end
        start, tail, target = np.full(first[-1], STARTS), np.full(first[-1], TAILS), np.full(first[-1], CLASSES)
        start[inputs], tail[inputs], target[targets] = self.start, self.tail, self.word_class
        return start, tail, target, first


def _windows(t: Tokens) -> np.ndarray:
    """(windows, 3, CONTEXT): start ids, tail ids and targets of consecutive windows, in which each token is a target once.

    They are mixed by a hash of their place, so that a step does not see one text alone.
    """
    start, tail, target, first = t.sequences()
    length = np.diff(first)
    each = -(-length // CONTEXT)
    text = np.repeat(np.arange(len(length)), each)
    number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    place = (number * CONTEXT)[:, None] + np.arange(CONTEXT)
    real = place < length[text][:, None]
    place = first[text][:, None] + np.minimum(place, length[text][:, None] - 1)
    mixed = np.argsort(mix64(np.arange(len(text), dtype=np.uint64)))
    return np.stack((start[place], tail[place], np.where(real, target[place], -1)), 1)[mixed].astype(np.int16)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """All windows of a task's texts, TASK_WINDOWS at a time."""
    held, count = [], 0
    for batch in batches:
        for low, high in slices(batch.column(0)):
            found = _windows(Tokens.of(batch.column(0).slice(low, high - low)))
            while count + len(found) >= TASK_WINDOWS:
                yield np.concatenate([*held, found[: TASK_WINDOWS - count]])
                found, held, count = found[TASK_WINDOWS - count :], [], 0
            held.append(found)
            count += len(found)
    if count:
        yield np.concatenate(held)


def _trained(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(w)), 0
        for ids in _shards(batches):
            again = np.tile(ids, (max(1, -(-LEAST_STEPS * BATCH // len(ids))), 1, 1)).astype(np.int64)  # few windows are gone through more often
            total += flat(train(unflat(w), again[:, 0], again[:, 1], again[:, 2])).astype(np.float64) * len(ids)
            n += len(ids)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w))), pa.array(total), pa.array(np.full(len(w), n))], ["i", "w", "n"])

    return run


def class_frequencies(class_tokens: np.ndarray) -> Weights:
    """The constants of the output layer with which every class, and the end, is as likely as it is frequent."""
    n = class_tokens + 0.5
    words = n[:CLASSES].reshape(GROUPS, MEMBERS)
    groups = np.append(words.sum(1), n[CLASSES])
    return {"c": np.log(groups / groups.sum()).astype(np.float32), "cg": np.log(words / words.sum(1, keepdims=True)).astype(np.float32)}


def fit_attention(texts: DataFrame, class_tokens: np.ndarray) -> Weights:
    """Weights learned from all of columns text and id; class frequencies are the start."""
    w = flat(first_weights() | class_frequencies(class_tokens))
    for k in range(ROUNDS):
        part = texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS)) == k).select("text")
        mean = part.mapInArrow(_trained(w), "i long, w double, n long").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w"))
        found = mean.toPandas()  # as many rows as the model has weights
        if len(found):
            w = np.zeros(len(w))
            w[found["i"]] = found["w"]
    return unflat(w)


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each block in a batch, with their number in learning texts."""
    names = ["block", "word", "class", "n"]
    for batch in batches:
        block, learn = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        parts = []
        for low, high in slices(batch.column(2)):
            t = Tokens.of(batch.column(2).slice(low, high - low))
            of = t.words.text_of + low
            parts.append((block[of], t.hash, t.word_class, learn[of]))
        for b in np.unique(block):
            mine = [(h[at], c[at], n[at]) for x, h, c, n in parts for at in [x == b]]
            h, c, n = (np.concatenate([m[k] for m in mine]) for k in range(3)) if mine else (np.zeros(0, np.uint64),) * 3
            words, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), b)), pa.array(words.view(np.int64)), pa.array(c[first].astype(np.int32)), pa.array(np.bincount(inverse, weights=n, minlength=len(words)).astype(np.int64))], names)


@dataclass
class Counts:
    """What the driver knows of the corpus: sums by class."""

    tokens: np.ndarray  # learning tokens of each class, the end being the last one
    kinds: np.ndarray  # distinct words of each class

    @property
    def total(self) -> int:
        return int(self.tokens.sum())

    @property
    def distinct(self) -> int:
        return int(self.kinds.sum())


def score_block(texts: pa.Array, words: np.ndarray, times: np.ndarray, w: Weights, counts: Counts) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text. words: sorted hashes of known words; times: their numbers."""
    t = Tokens.of(texts)
    start, tail, target, first = t.sequences()
    c = np.zeros(first[-1], np.int64)
    is_end = target == CLASSES
    c[is_end] = counts.tokens[CLASSES]
    if len(words):
        at = np.minimum(np.searchsorted(words, t.hash), len(words) - 1)
        c[~is_end] = np.where(words[at] == t.hash, times[at], 0)
    per_text = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0, x.dtype)
    base = np.log10((c + 1) / (counts.total + counts.distinct + 1))

    new = np.maximum(counts.kinds, 1)
    in_class = np.zeros(first[-1])
    k = t.word_class
    in_class[~is_end] = np.log(np.where(c[~is_end] > 0, c[~is_end], new[k]) / (counts.tokens[k] + new[k]))

    length = np.diff(first)
    windows = 1 + np.maximum(0, -(-(length - CONTEXT) // STRIDE))
    text = np.repeat(np.arange(len(length)), windows)
    number = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    model = np.zeros(first[-1])
    steps, skip = np.arange(CONTEXT), CONTEXT - STRIDE
    short = length[text] <= STRIDE // 2  # short texts go apart, so that they are not padded to a whole window
    for group, wide in ((np.flatnonzero(short), STRIDE // 2), (np.flatnonzero(~short), CONTEXT)):
        for low in range(0, len(group), 128):
            at = group[low : low + 128]
            place = (number[at] * STRIDE)[:, None] + steps[:wide]
            real = (place < length[text[at]][:, None]) & ((number[at] == 0)[:, None] | (steps[:wide] >= skip))
            place = first[text[at]][:, None] + np.minimum(place, length[text[at]][:, None] - 1)
            z = hidden(w, start[place], tail[place])["z"]
            model[place[real]] = class_log_probs(w, z[real], target[place[real]])
    return {"n_tokens": length, "n_known": per_text((c > 0).astype(np.int64)), "base_score": per_text(base), "score": per_text((model + in_class) / np.log(10))}


def in_blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (id, text, learned) with a column block, and how many are learned from.

    A block is a range of BLOCK ids; ranges with more than BLOCK_BYTES of text are dealt by a hash of id
    and text over as many blocks as they need.
    """
    range_of = F.coalesce(F.floor(F.col("id") / BLOCK).cast("long"), F.lit(-1).cast("long"))
    rows = rows.withColumn("range", range_of)
    sizes = rows.groupBy("range").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("learned").cast("long")).alias("learning"))
    sizes = staged(sizes, "block-sizes")
    learning = sizes.agg(F.sum("learning")).first()[0] or 0
    parts = sizes.select("range", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("parts")).where("parts > 1")
    met = rows.join(few(parts, BROADCAST_ROWS), "range", "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id", "text"), F.col("parts"))).otherwise(F.lit(0).cast("long"))
    return met.select("id", "text", "learned", F.xxhash64("range", part).alias("block")), int(learning)


def _scored(shared):
    """Scores of texts that come sorted by block, each block's known words (no text) before its texts."""
    names = ["id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, counts = shared.value
        block, held, known, times = None, [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            of, is_text = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (is_text[1:] != is_text[:-1]), [True])))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if of[low] != block:
                    block, held, known, times = of[low], [], known[:0], times[:0]
                if not is_text[low]:
                    held.append([batch.column(k).slice(low, high - low).to_numpy(zero_copy_only=False) for k in (4, 5)])
                    continue
                if held:
                    known, at = np.unique(np.concatenate([h[0] for h in held]).astype(np.int64).view(np.uint64), return_index=True)
                    times, held = np.concatenate([h[1] for h in held]).astype(np.int64)[at], []
                texts = batch.column(3).slice(low, high - low)
                for a, b in slices(texts):
                    found = score_block(texts.slice(a, b - a), known, times, weights, counts)
                    own = batch.slice(low + a, b - a)
                    yield pa.RecordBatch.from_arrays([own.column(2), own.column(6), *(pa.array(found[k]) for k in names[2:4]), pa.array(np.full(b - a, counts.total)), *(pa.array(found[k]) for k in names[5:])], names)

    return run


def language_scores(docs: DataFrame, learn: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score) of every row.

    learn: SQL condition on docs for the rows to learn from. The id has to be an integer.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.expr(learn), F.lit(False)).alias("learned"))
    rows, ends = in_blocks(rows)

    found = staged(rows.select("block", "learned", "text").mapInArrow(_block_words, "block long, word long, class int, n long"), "block-words")
    counted = staged(found.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"), F.max("class").alias("class")), "word-counts")
    tokens, kinds = np.zeros(CLASSES + 1, np.int64), np.zeros(CLASSES + 1, np.int64)
    for r in counted.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("kinds")).collect():  # a row a class
        tokens[r["class"]], kinds[r["class"]] = r["c"], r["kinds"]
    tokens[CLASSES], kinds[CLASSES] = ends, int(ends > 0)
    w = fit_attention(rows.where("learned"), tokens)
    shared = docs.sparkSession.sparkContext.broadcast((w, Counts(tokens, kinds)))  # fixed size

    needed = found.select("block", "word").join(counted.select("word", "c"), "word")
    needed = needed.select("block", F.lit(False).alias("is_text"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "word", "c", F.lit(None).cast("boolean").alias("learned"))
    texts = rows.select("block", F.lit(True), "id", "text", F.lit(None).cast("long"), F.lit(None).cast("long"), "learned")
    out = needed.union(texts).repartition("block").sortWithinPartitions("block", "is_text")
    out = out.mapInArrow(_scored(shared), "id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
