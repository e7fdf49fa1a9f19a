"""A Bloom sketch of a set of keys, in blocks, built and tested by Spark's own expressions.

A key's hash names a block of 2^15 bits and ``PROBES`` bits in it. The sketch is a table with a
row per block, its bits as 512 longs; broadcast and joined by block inside the scan of the other
side, it lets through every key of the set and few strangers. Sizes are known before anything
is built: ``BITS`` bits a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.plans.keys import key_names, quoted

# Largest sketch that is broadcast, of some 26 million keys.
SKETCH_BYTES = 32 << 20

BITS = 10  # a key; about 1.5 strangers in 100 pass
PROBES = 4
BLOCK_BITS = 1 << 15
WORDS = BLOCK_BITS // 64
_BLOCK_BYTES = BLOCK_BITS // 8 + 128

# Types whose equal values have equal hashes, whatever wrote them.
_HASHED = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.BinaryType,
    T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


def _plain(kind: T.DataType) -> bool:
    return isinstance(kind, _HASHED) or kind == T.StringType()


def can_sketch(one: DataFrame, other: DataFrame, key: str | Sequence[str]) -> bool:
    """Whether keys that a join of both takes for equal have equal hashes."""
    names = key_names(key)
    kinds = [(one.schema[name].dataType, other.schema[name].dataType) for name in names]
    return all(a == b and _plain(a) for a, b in kinds)


def blocks_for(rows: int) -> int:
    return max(1, -(-rows * BITS // BLOCK_BITS))


def sketch_bytes(rows: int) -> int:
    """What a sketch of so many keys takes in a broadcast."""
    return blocks_for(rows) * _BLOCK_BYTES


def _hashes(key: str | Sequence[str], blocks: int) -> tuple[Column, list[tuple[Column, Column]]]:
    """A key's block, and its words and bits there."""
    names = quoted(key_names(key))
    block = F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("long")
    other = F.xxhash64(F.lit(PROBES), *names)

    def bits(low: int, n: int) -> Column:
        return F.shiftrightunsigned(other, low).bitwiseAND((1 << n) - 1).cast("int")

    return block, [(bits(15 * at, 9), bits(15 * at + 9, 6)) for at in range(PROBES)]


def sketch(keys: DataFrame, key: str | Sequence[str], blocks: int) -> DataFrame:
    """``(__block, __words)`` of the keys, null-safe. Repeated keys cost nothing more.

    Hashes are dealt out by block before they are added up: a partial sum in each task would
    be as big as the sketch itself.
    """
    block, probes = _hashes(key, blocks)
    # Bytes come in order and bits in a byte from the lowest; words are read from the highest.
    places = [word * 64 + (7 - F.shiftright(bit, 3)) * 8 + bit.bitwiseAND(7) for word, bit in probes]
    rows = keys.select(block.alias("__block"), F.explode(F.array(*places)).alias("__place"))
    dealt = rows.repartition("__block")
    bitmaps = dealt.groupBy("__block").agg(F.bitmap_construct_agg(F.col("__place").cast("long")).alias("__map"))

    def word(at: Column) -> Column:
        part = F.substring("__map", at * 8 + 1, F.lit(8))
        return F.conv(F.hex(part), 16, -10).cast("long")

    words = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), word)
    return bitmaps.select("__block", words.alias("__words"))


def passing(df: DataFrame, sketched: DataFrame, key: str | Sequence[str], blocks: int) -> DataFrame:
    """The rows of ``df`` whose key may be in the sketch, which must be known to be small."""
    block, probes = _hashes(key, blocks)
    met = block == F.col("__block")
    for word, bit in probes:
        met &= F.getbit(F.col("__words")[word], bit) == 1
    return df.join(F.broadcast(sketched), met, "left_semi")
