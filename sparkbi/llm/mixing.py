"""Mix sources to target weights by hash thresholds, without sorting the documents.

Every document has a hash. A histogram of words by (source, leading hash bits) shows in
which bucket a source's budget runs out; only that bucket is counted again by the next bits,
until the bits are used up. What remains per source is one threshold, and a filter decides
each document. Whole repetitions come first: a source whose target is 1.4 times its size
gives every document once and the documents under a 0.4 threshold a second time.

Nulls: a null text has no words, a null source is a source of its own and comes last, a null
id hashes like an empty one. Documents without words are taken or not by the same threshold
and never change a budget. Repeated rows hash alike; a last level of bits drawn from the
row number splits such a group, so the count taken is the same in every run. An empty table
gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkbi.llm.common import WORD, broadcast_if, saved

LEVEL_BITS = 15
CONTENT_LEVELS = 4  # 60 bits of a content hash
TIE_LEVELS = 2  # 30 bits of the row's own number
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def content_hash(id_: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text."""
    content = F.concat_ws("\x1f", F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(content), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Target words per source from ``source`` and ``source_size``, one row each.

    The budget is ``share`` of all words, split by weight. A source stops at ``most`` times
    its size and the rest goes on to the others by weight. In order of size per weight the
    sources that stop are a prefix, so prefix sums give the common level in one pass. The
    windows see one row per source, not per document.
    """
    index = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (index % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    ranked = caps.withColumns(
        {
            "stopped": F.coalesce(F.sum("cap").over(earlier), F.lit(0)),
            "used": F.coalesce(F.sum("weight").over(earlier), F.lit(0)),
            "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
            "all_weight": F.sum("weight").over(everything),
            "rank": F.row_number().over(ratio),
        }
    ).withColumn("level", (F.col("budget") - F.col("stopped")) / (F.col("all_weight") - F.col("used")))
    free = F.col("level") * F.col("weight") <= F.col("cap")
    common = F.min_by(F.when(free, F.col("level")), F.when(free, F.col("rank"))).over(everything)
    target = F.least(F.col("cap").cast("double"), common * F.col("weight"))
    return ranked.withColumn("target", F.coalesce(target, F.col("cap").cast("double"))).select("source", "source_size", "target")


def _same_source() -> Column:
    return F.col("source").eqNullSafe(F.col("to_source"))


def _cuts(rows: DataFrame, budgets: DataFrame, sources: int) -> DataFrame:
    """Per source the threshold ``cut`` (an array of level values) and whether rows equal to it are taken.

    ``rows``: source, size, digits (array of level values). ``budgets``: source, budget.
    """
    state = budgets.select(F.col("source").alias("to_source"), "budget", F.lit(0).cast("long").alias("filled"), F.array().cast("array<int>").alias("cut"))
    levels = CONTENT_LEVELS + TIE_LEVELS
    for level in range(levels):
        counted = (
            rows.withColumn("digit", F.element_at("digits", level + 1)).groupBy("source", "digit").agg(F.sum("size").alias("words"))
        )
        # At most 2^LEVEL_BITS rows per source.
        order = W.partitionBy("source").orderBy("digit")
        reach = counted.withColumns({"upto": F.sum("words").over(order), "last": F.lead("digit").over(order).isNull()})
        joined = reach.join(broadcast_if(state.drop("edge"), sources, BROADCAST_SOURCES), _same_source())
        # The first bucket that goes over what is left; the last one if rounding leaves none.
        over = F.col("filled") + F.col("upto") > F.col("budget")
        bucket = F.when(over, F.col("digit"))
        found = joined.groupBy("source").agg(
            F.coalesce(F.min(bucket), F.max("digit")).alias("digit"),
            F.coalesce(
                F.min_by(F.when(over, F.col("upto") - F.col("words")), bucket), F.max(F.when(F.col("last"), F.col("upto") - F.col("words")))
            ).alias("below"),
            F.coalesce(F.min_by(F.when(over, F.col("words")), bucket), F.max(F.when(F.col("last"), F.col("words")))).alias("words"),
            F.first("budget").alias("budget"),
            F.first("filled").alias("filled"),
            F.first("cut").alias("cut"),
        )
        state = saved(
            found.select(
                F.col("source").alias("to_source"),
                "budget",
                (F.col("filled") + F.col("below")).alias("filled"),
                F.concat("cut", F.array(F.col("digit").cast("int"))).alias("cut"),
                F.col("words").alias("edge"),
            )
        )
        if level + 1 < levels:
            cut = broadcast_if(state.select("to_source", F.element_at("cut", -1).alias("_cut")), sources, BROADCAST_SOURCES)
            boundary = rows.join(cut, _same_source()).where(F.element_at("digits", level + 1) == F.col("_cut"))
            # a few thousandths of the rows at the first level, a handful after it
            rows = saved(boundary.select("source", "size", "digits"))
    room = F.col("budget") - F.col("filled")
    return state.select("to_source", "cut", (F.col("edge") - room < room).alias("take_equal"))


def _digits(id_: Column, text: Column) -> Column:
    content = content_hash(id_, text)
    mask = F.lit((1 << LEVEL_BITS) - 1)
    shifts = [LEVEL_BITS * (CONTENT_LEVELS - 1 - level) for level in range(CONTENT_LEVELS)]
    own = F.xxhash64(F.monotonically_increasing_id())
    values = [F.shiftrightunsigned(content, shift).bitwiseAND(mask) for shift in shifts]
    values += [F.shiftrightunsigned(own, LEVEL_BITS * level).bitwiseAND(mask) for level in range(TIE_LEVELS)]
    return F.array(*[value.cast("int") for value in values])


@dataclass(frozen=True)
class Mix:
    """What a mix decides: ``rows`` (id, source, size, digits) and one row of ``plan`` per source."""

    rows: DataFrame
    plan: DataFrame
    most: int

    def decide(self, rows: DataFrame) -> DataFrame:
        """Join the plan to rows with ``source`` and ``digits``; adds source_size, target and ``copies``."""
        under = (F.col("digits") < F.col("cut")) | (F.col("take_equal") & (F.col("digits") == F.col("cut")))
        extra = (F.col("budget") > 0) & under
        return rows.join(self.plan, _same_source()).withColumn("copies", F.least(F.col("whole") + extra.cast("int"), F.lit(self.most)))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> Mix:
    """Count the words per source and hash bucket and find the thresholds."""
    rows = saved(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            word_count(F.col(text_column)).alias("size"),
            _digits(F.col(id_column), F.col(text_column)).alias("digits"),
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = saved(source_targets(sizes, weights, share, most))
    sources = targets.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    budgets = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = _cuts(rows.select("source", "size", "digits"), budgets.select("source", "budget"), sources)
    plan = budgets.join(cuts, F.col("source").eqNullSafe(F.col("to_source"))).drop("source")
    return Mix(rows, broadcast_if(plan, sources, BROADCAST_SOURCES), most)


def mix(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` words.

    ``options`` are those of ``plan_mix``.
    """
    made = plan_mix(docs, id_column=id_column, **options)
    return made.decide(made.rows).select(
        F.col("id").alias(id_column),
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns."""
    made = plan_mix(docs, id_column=id_column, text_column=text_column, source_column=source_column, **options)
    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("document")
    rows = docs.select(whole, F.col(source_column).alias("source"), _digits(F.col(id_column), F.col(text_column)).alias("digits"))
    repeated = made.decide(rows).where(F.col("copies") > 0).select("document", F.explode(F.expr("array_repeat(0, copies)")))
    return repeated.select("document.*")
