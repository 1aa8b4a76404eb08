"""SimHash of word shingles, counted inside the JVM.

A shingle votes with every bit of its hash. Two bits share one 64-bit sum, the upper bit in the
upper half, so 32 sums hold all votes and a text may have two billion shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 64
HALF = BITS // 2
PAIR = (1 << HALF) | 1


def votes(hashes: DataFrame, keys: Sequence[str], hash_column: str = "hash", weight: Column | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Per key: ``count`` (or weight) of non-null hashes and the packed sums of their bits."""
    weight = F.lit(1).cast("long") if weight is None else weight
    bits = [F.shiftrightunsigned(hash_column, place).bitwiseAND(F.lit(PAIR)) * weight for place in range(HALF)]
    return hashes.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col(hash_column).isNotNull(), weight)), F.lit(0)).alias("count"),
        *[F.sum(bit).alias(f"votes_{place}") for place, bit in enumerate(bits)],
        *extra,
    )


def majority(count: str = "count") -> Column:
    """The 64-bit number whose bits are set in more than half of the votes; 0 without votes."""
    low = [F.col(f"votes_{place}").bitwiseAND(F.lit((1 << HALF) - 1)) for place in range(HALF)]
    high = [F.shiftrightunsigned(f"votes_{place}", HALF) for place in range(HALF)]
    bit = lambda place: (1 << place) - (1 << BITS if place == BITS - 1 else 0)
    set_bits = [F.when(sum_ * 2 > F.col(count), F.lit(bit(place))).otherwise(F.lit(0)) for place, sum_ in enumerate(low + high)]
    return reduce(Column.bitwiseOR, set_bits).cast("long")


def shingle_hashes(rows: DataFrame, keys: Sequence[str], words: Column, size: int, hashed: Callable[[list[Column]], Column]) -> DataFrame:
    """One row per shingle of ``size`` words: keys, ``place`` and ``hash``.

    A text of fewer words is one shingle of all of them; a text of none is one row with a null hash.
    """
    split = rows.select(*keys, words.alias("_words"))
    last = F.greatest(F.size("_words") - size, F.lit(0))
    places = split.select(*keys, "_words", F.explode(F.sequence(F.lit(0), last)).alias("place"))
    parts = [F.get("_words", F.col("place") + step) for step in range(size)]
    return places.select(*keys, "place", F.when(F.size("_words") > 0, hashed(parts)).alias("hash"))


def hex64(number: Column) -> Column:
    """Sixteen lowercase hex digits."""
    return F.lpad(F.lower(F.hex(number)), 16, "0")


def block_count(fingerprints: int, radius: int) -> int:
    """Blocks whose shared bits leave a few dozen random fingerprints to a key; any number finds the same pairs."""
    blocks = radius + 1
    while fingerprints >> (BITS * (blocks - radius) // blocks) > 64 and blocks < 2 * radius + 2:
        blocks += 1
    return blocks


def block_masks(radius: int, blocks: int) -> list[int]:
    """One mask per table: two fingerprints within ``radius`` bits agree under at least one of them.

    They differ in at most ``radius`` of the blocks, so some choice of the others agrees wholly.
    """
    edges = [BITS * place // blocks for place in range(blocks + 1)]
    parts = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [mask - (mask >> (BITS - 1) << BITS) for mask in masks]


def block_keys(fingerprint: Column, masks: Sequence[int]) -> Column:
    """Array of (table, bits): the fingerprint under every mask."""
    return F.array(*[F.struct(F.lit(table).alias("table"), fingerprint.bitwiseAND(F.lit(mask)).alias("bits")) for table, mask in enumerate(masks)])
