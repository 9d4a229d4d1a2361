import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import LONG, UNSPLIT, docs, empty_docs, odd_docs
from tidejoin.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def random_texts(n, seed):
    rng = random.Random(seed)
    signs = ["a", "the", "tion", " ", "  ", "\n", " \n", " ", "é", "漢", "😀", "'s", "'", "'ll", "9", "42", "!!", "<|endoftext|>", "\t", "…", "<|endof", "　 "]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_as_the_library(spark, plain, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 6)  # so that short texts go through the tree too
    c = bpe.Codec(PATH)
    texts = random_texts(1500, 3) + ["'" * 90 + "s", " " * 70 + "x", "a" * 333, "ab" * 77 + " <|endoftext|>" * 3, "", UNSPLIT[:900]]
    for text, (n, ids, decoded) in zip(texts, bpe.encode_texts(texts, c), strict=True):
        expected = plain.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, expected)) and n == len(expected), text
        assert decoded.decode("utf-8", "replace") == plain.decode(expected, skip_special_tokens=False)


def test_rows_and_long_texts(spark, plain):
    texts = ["", None, "hello world", LONG, UNSPLIT, UNSPLIT + "<|endoftext|> " + "z" * 70_000, " " * 80_000 + "x"]
    found = {r.doc_id: r for r in bpe.bpe_round_trip(docs(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_odd_and_empty_tables(spark):
    assert bpe.bpe_round_trip(odd_docs(spark), PATH, "ids").count() == odd_docs(spark).count()
    assert bpe.bpe_round_trip(empty_docs(spark), PATH).count() == 0
    texts = [r.decoded for r in bpe.bpe_round_trip(odd_docs(spark), PATH, "ids").collect()]
    assert sorted(texts) == sorted(r.text or "" for r in odd_docs(spark).collect())


WIDE = ["\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u3002", "\u200b", "\u0142", " ", "  ", "a", "\n", "\U0001f600"]


def test_units_of_bytes_are_those_of_text():
    rng = random.Random(8)
    texts = ["".join(rng.choice(WIDE) for _ in range(rng.randrange(30))) for _ in range(2000)] + ["", " ", "a ", " a"]
    offsets, data = bpe._buffers(pa.array(texts))
    bounds = [*bpe.unit_starts(offsets, data).tolist(), len(data)]
    found = [bytes(data[a:b]).decode() for a, b in zip(bounds, bounds[1:], strict=False)]
    assert found == [u for t in texts for u in bpe.units_of(t)]


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, own):
        self.own, self.texts = own, 0

    def __getattr__(self, name):
        return getattr(self.own, name)

    def encode_batch(self, texts, **how):
        self.texts += len(texts)
        return self.own.encode_batch(texts, **how)

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.own.encode_batch_fast(texts, **how)


@pytest.mark.parametrize("keep", [0, bpe.KEEP])
def test_new_units_go_to_the_library_in_runs(plain, monkeypatch, keep):
    monkeypatch.setattr(bpe, "KEEP", keep)
    c = bpe.Codec(PATH)
    c.tokenizer = Counting(c.tokenizer)
    rng = random.Random(9)
    slices = [[" ".join(f"{rng.choice(['Wort', 'é', '漢', '<|endoftext|>'])}{rng.randrange(9000)}" for _ in range(300)) for _ in range(20)] for _ in range(4)]
    for texts in slices:
        for text, (n, ids, decoded) in zip(texts, bpe.encode_texts(texts, c), strict=True):
            expected = plain.encode(text, add_special_tokens=False).ids
            assert (n, ids, decoded.decode()) == (len(expected), ",".join(map(str, expected)), text)
    assert c.tokenizer.texts < 300  # of some 20,000 different units


def test_units_that_do_not_come_out_even_are_encoded_apart(plain, monkeypatch):
    c = bpe.Codec(PATH)
    c.token_sizes = c.token_sizes + 1  # as if tokens stood for other bytes
    texts = ["some words and some more", "of which none come out even"]
    assert [x[1] for x in bpe.encode_texts(texts, c)] == [",".join(map(str, plain.encode(t, add_special_tokens=False).ids)) for t in texts]
