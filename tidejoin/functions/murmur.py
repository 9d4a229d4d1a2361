"""MurmurHash3 x86 32-bit of one integer, with any seed, in column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
C1, C2, ADD, MIX1, MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
MASK = 0xFFFFFFFF


def _times(a: Column, b: int) -> Column:
    """a * b modulo 2**32, for a below 2**32, without leaving 64 bits."""
    low = a.bitwiseAND(0xFFFF) * F.lit(b)
    high = F.shiftleft((F.shiftrightunsigned(a, 16) * F.lit(b)).bitwiseAND(0xFFFF), 16)
    return (low + high).bitwiseAND(MASK)


def _turn(a: Column, n: int) -> Column:
    return F.shiftleft(a, n).bitwiseAND(MASK).bitwiseOR(F.shiftrightunsigned(a, 32 - n))


def _fold(a: Column, n: int) -> Column:
    return a.bitwiseXOR(F.shiftrightunsigned(a, n))


def murmur3(key: Column, seed: int = 1) -> Column:
    """The unsigned hash of a 32-bit integer, as BIGINT."""
    k = _times(_turn(_times(key.cast("long").bitwiseAND(MASK), C1), 15), C2)
    h = _turn(k.bitwiseXOR(F.lit(seed).cast("long")), 13)
    h = (h * 5 + ADD).bitwiseAND(MASK).bitwiseXOR(F.lit(4).cast("long"))
    return _fold(_times(_fold(_times(_fold(h, 16), MIX1), 13), MIX2), 16)


def bucket(key: Column, buckets: int, seed: int = 1) -> Column:
    """The bucket of a key in a table of a power of two buckets."""
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("the number of buckets has to be a power of two")
    return murmur3(key, seed).bitwiseAND(buckets - 1)
