"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Only the number of pieces of each length matters to a packing, and there are at most
``capacity`` lengths, however many documents there are. So the matching runs over that
histogram, and every step moves whole runs of equal pieces:

* pieces above a third of the capacity pair at most twice per sequence: the longest takes the
  longest partner that still fits, which gives as many pairs as possible;
* smaller pieces, longest first, go to the sequence with the smallest gap that holds them.

The outcome is a list of runs (length, first rank, last rank, first sequence, offset). Documents
find their place by their rank among the pieces of equal length. Ranks come from counts per
(length, block), so no length, however common, is numbered in one task.

Nulls: a null text is an empty one and packs as the end id alone; a null id is kept. Repeated
rows are packed once each. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sparkbi.llm.common import per_worker, saved, ship_by_value
from sparkbi.llm.word_bpe import WordBpe

PIECE_SCHEMA = "id long, piece int, start long, length long, ids_crc32 long"
ROWS_PER_BLOCK = 50_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokenize whole texts, add the end id and cut what is longer than ``capacity``."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker("word_bpe", tokenizer, lambda: WordBpe(tokenizer))
        for batch in batches:
            rows: list[tuple] = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encoder.packed(text.as_py() or "") + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    here = ids[at : at + 4 * capacity]
                    rows.append((number, piece, at // 4, len(here) // 4, zlib.crc32(here)))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, types)], ["id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(cut, PIECE_SCHEMA)


class _Gaps:
    """Open sequences by the room they have left, in runs of equal ones: (first sequence, how many)."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, gap: int, first: int, many: int) -> None:
        if gap <= 0 or many <= 0:
            return
        if gap not in self.runs:
            self.runs[gap] = []
            insort(self.sizes, gap)
        self.runs[gap].append((first, many))

    def take_smallest(self, least: int) -> tuple[int, int, int] | None:
        """Remove a run with the smallest gap of at least ``least``: (gap, first, how many)."""
        place = bisect_left(self.sizes, least)
        if place == len(self.sizes):
            return None
        gap = self.sizes[place]
        first, many = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap], self.sizes[place]
        return gap, first, many


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, rank_from, rank_to, each, first_sequence, offset)`` that place every piece.

    The pieces of a length with rank in ``[rank_from, rank_to)`` go ``each`` to a sequence,
    from ``first_sequence`` on, the first of them at ``offset``.
    """
    left = {length: many for length, many in counts.items() if many}
    placed = dict.fromkeys(left, 0)
    gaps, runs, sequences = _Gaps(), [], 0

    def place(length: int, many: int, each: int, first: int, offset: int) -> None:
        runs.append((length, placed[length], placed[length] + many * each, each, first, offset))
        placed[length] += many * each
        left[length] -= many * each

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        length = large[-1]
        partner_at = bisect_left(large, capacity - length + 1) - 1  # the longest that still fits
        partner = large[partner_at] if partner_at >= 0 else None
        if partner == length and left[length] == 1:
            partner = large[partner_at - 1] if partner_at > 0 else None
        if partner is None:
            many, used = left[length], length
            place(length, many, 1, sequences, 0)
        elif partner == length:
            many, used = left[length] // 2, 2 * length
            place(length, many, 2, sequences, 0)
        else:
            many, used = min(left[length], left[partner]), length + partner
            place(length, many, 1, sequences, 0)
            place(partner, many, 1, sequences, length)
        gaps.add(capacity - used, sequences, many)
        sequences += many
        large = [other for other in large if left[other]]
    for length in sorted((length for length in left if left[length]), reverse=True):
        while left[length]:
            found = gaps.take_smallest(length)
            if found is None:
                each = min(capacity // length, left[length])
                found = (capacity, sequences, max(1, left[length] // each))
                sequences += found[2]
            gap, first, many = found
            each = min(gap // length, left[length])
            full = min(many, left[length] // each)
            place(length, full, each, first, capacity - gap)
            gaps.add(gap - each * length, first, full)
            gaps.add(gap, first + full, many - full)
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the path of the vocabulary file, present on every executor.
    """
    spark = docs.sparkSession
    made = token_pieces(docs, tokenizer, capacity, end_id, id_column, text_column)
    pieces = saved(made.withColumn("row", F.monotonically_increasing_id()))
    # At most one row per length up to the capacity reaches the driver.
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = max(32, sum(counts.values()) // ROWS_PER_BLOCK)
    rows = pieces.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    per_block = rows.groupBy("length", "block").agg(F.count(F.lit(1)).alias("here"))
    earlier = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row per block
    starts = per_block.select("length", "block", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "block").orderBy("row")) - 1
    ranked = rows.withColumn("inside", inside).join(starts, ["length", "block"]).withColumn("rank", F.col("before") + F.col("inside"))
    # The runs depend on the capacity and the lengths in use, not on how many pieces there are.
    runs = spark.createDataFrame(plan_packing(counts, capacity), "run_length long, rank_from long, rank_to long, each long, first long, base long")
    here = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    step = F.col("rank") - F.col("rank_from")
    return ranked.join(F.broadcast(runs), here).select(
        F.col("id").alias(id_column),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + step % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


ship_by_value(__name__)
