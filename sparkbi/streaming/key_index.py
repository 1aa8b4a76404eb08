"""Which silver hours may hold an event: a Bloom filter per hour, kept as rows of a table.

A filter is cut into blocks of four 64-bit words. An id picks one block by hash and sets four bits in each
of its words, so testing an id against an hour needs one row of that hour's filter. The
number of blocks is a power of two that follows the hour's number of events at ``BITS_PER_KEY``, which keeps the
chance that an hour is named in vain near one in several million per id. A filter never misses an id it was given.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BITS_PER_KEY = 40
WORDS, BITS_PER_WORD, WORD_BITS = 4, 4, 6
BLOCK_BITS = WORDS << WORD_BITS
#: At most this many blocks in a filter; an hour beyond 400 million events gets fuller, not wrong.
MOST_SIZE = 26
FILTER = "dt string, hour string, size int, block int, w0 long, w1 long, w2 long, w3 long"


def id_words(key: Column) -> list[Column]:
    """The bits that an id sets in each word of its block."""
    words = []
    for half in range(2):  # 48 bits of a hash place eight bits in two words
        number = F.xxhash64(key, F.lit(half + 1))
        for word in range(2):
            steps = [F.shiftrightunsigned(number, WORD_BITS * (word * BITS_PER_WORD + bit)).bitwiseAND(F.lit((1 << WORD_BITS) - 1)) for bit in range(BITS_PER_WORD)]
            words.append(reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), step.cast("int")) for step in steps]))
    return words


def id_block(key: Column, size: Column) -> Column:
    """The block of an id in a filter of ``2 ** size`` blocks."""
    return F.pmod(F.xxhash64(key), F.call_function("shiftleft", F.lit(1).cast("long"), size)).cast("int")


def sizes(counted: DataFrame) -> dict[tuple[str, str], int]:
    """Filter size by day and hour from (dt, hour, events); a row per hour reaches the driver."""
    return {(row["dt"], row["hour"]): min(MOST_SIZE, max(0, (row["events"] * BITS_PER_KEY // BLOCK_BITS).bit_length())) for row in counted.collect()}


def build_filters(events: DataFrame, size: Column) -> DataFrame:
    """The filters of all days and hours in ``events`` (event_id, dt, hour). Words are or-ed in the tasks first."""
    placed = events.withColumn("size", size.cast("int"))
    words = {f"w{number}": word for number, word in enumerate(id_words(F.col("event_id")))}
    bits = placed.select("dt", "hour", "size", id_block(F.col("event_id"), F.col("size")).alias("block"), *[word.alias(name) for name, word in words.items()])
    return bits.groupBy("dt", "hour", "size", "block").agg(*[F.bit_or(name).alias(name) for name in words])


def may_hold(ids: DataFrame, filters: DataFrame, used: Sequence[int]) -> DataFrame:
    """(event_id, dt, hour) for every id and hour whose filter does not rule it out; ``used``: sizes among the filters."""
    words = {f"i{number}": word for number, word in enumerate(id_words(F.col("event_id")))}
    asked = ids.select("event_id", *[word.alias(name) for name, word in words.items()], F.explode(F.array(*[F.lit(size) for size in used])).alias("_size"))
    asked = asked.withColumn("_block", id_block(F.col("event_id"), F.col("_size")))
    set_bits = [F.col(f"w{number}").bitwiseAND(F.col(f"i{number}")) == F.col(f"i{number}") for number in range(WORDS)]
    met = filters.join(asked, reduce(Column.__and__, set_bits, (F.col("size") == F.col("_size")) & (F.col("block") == F.col("_block"))))
    return met.select("event_id", "dt", "hour")
