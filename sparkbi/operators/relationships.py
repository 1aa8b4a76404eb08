"""Which columns relate to a chosen one, how strongly, and how to plot it.

Statistics for all candidates of one kind are computed together in long form: one row per
(candidate, x, y), so thirty candidates cost one set of shuffles, not thirty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkbi.functions.columns import as_double, dtype, is_number, number, require, row_order, to_time
from sparkbi.operators.aggregates import first_value
from sparkbi.operators.profile import profile
from sparkbi.operators.ranks import with_ranks
from sparkbi.operators.running import hash_sample
from sparkbi.session import cut_lineage

MAX_LEVELS, MIN_DAYS = 30, 3
NO_DIRECTION = 1e-12
CLIP = {"low": 0.01, "middle": 0.5, "high": 0.99}

# The method names shown with each relation type.
METHODS = {
    "numeric_numeric": "Spearman",
    "categorical_categorical": "Bias-corrected Cramer's V",
    "categorical_numeric": "Eta squared",
    "datetime_numeric": "Daily trend Spearman",
}
SIGNED = ("numeric_numeric", "datetime_numeric")

RESULT = "column string, relation_type string, score double, pearson double, sample_size long"


@dataclass(frozen=True)
class Request:
    column: str
    candidate_limit: int = 30
    sample_limit: int | None = None
    result_limit: int = 5
    minimum_pair_samples: int = 100
    seed: int = 42
    entity_key: str | None = None
    time_column: str | None = None
    grain: str | None = None
    order_by: Sequence[str] = ()
    max_levels: int = 30
    null_limit: float = 0.8


def judged(profiled: DataFrame, request: Request) -> DataFrame:
    """The profile with ``place`` for columns to compare, best first, and ``skipped`` saying why others are not.

    The most complete columns come first, among them those that do not number the rows, then the
    most varied. ``profiled`` has one row per column.
    """
    plain = F.col("semantic_type").isin("identifier", "text")
    skipped = (
        F.when(F.col("name") == request.column, "chosen column")
        .when(plain, "identifier or free text")
        .when(F.col("unique_count") <= 1, "no variation")
        .when(F.col("null_ratio") >= request.null_limit, "too many nulls")
    )
    numbers_rows = (F.col("unique_count") == F.col("row_count")).cast("int")
    best = W.partitionBy("fit").orderBy("null_ratio", numbers_rows, F.desc("unique_count"), "position")
    ranked = profiled.withColumn("skipped", skipped).withColumn("fit", F.col("skipped").isNull()).withColumn("place", F.row_number().over(best))
    late = F.when(F.col("fit") & (F.col("place") > request.candidate_limit), "beyond the candidate limit")
    # Of two categories both must have few levels, of a category and a number the category.
    chosen = F.max(F.when(F.col("name") == request.column, F.struct("semantic_type", "unique_count"))).over(W.partitionBy())
    levels = F.greatest(*[F.when(kind == "categorical", count).otherwise(0) for kind, count in ((F.col("semantic_type"), F.col("unique_count")), (chosen["semantic_type"], chosen["unique_count"]))])
    crowded = F.when(levels > request.max_levels, "too many levels")
    # Levels are judged again on the pairs that are scored; at an entity's grain there may be fewer.
    compared = F.col("fit") & (F.col("place") <= request.candidate_limit)
    reason = F.coalesce("skipped", late, crowded if not request.entity_key else F.lit(None))
    return ranked.withColumns({"place": F.when(compared, F.col("place")), "skipped": reason}).drop("fit")


def skipped_candidates(df: DataFrame, request: Request, profiled: DataFrame | None = None) -> DataFrame:
    """``column`` and ``reason`` of every column that ``analyze`` leaves out before scoring."""
    found = judged(profile(df) if profiled is None else profiled, request)
    return found.where(F.col("skipped").isNotNull() & (F.col("name") != request.column)).select(F.col("name").alias("column"), F.col("skipped").alias("reason"))


def latest_grain(df: DataFrame, entity_key: str, time_column: str, order_by: Sequence[str] = ()) -> DataFrame:
    """The last row of each entity by time; a missing time counts as the latest."""
    require(df, [entity_key, time_column])
    order = row_order(df, [time_column, *order_by], descending=True)
    place = F.row_number().over(W.partitionBy(entity_key).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def mean_grain(df: DataFrame, entity_key: str, order_by: Sequence[str] = ()) -> DataFrame:
    """One row per entity: numeric columns averaged, others by their first non-null value."""
    require(df, [entity_key])
    merged = []
    for name in df.columns:
        if name == entity_key:
            continue
        if is_number(dtype(df, name)):
            merged.append(F.avg(number(df, name)).alias(name))
        else:
            merged.append(first_value(df, name, order_by).alias(name))
    return df.groupBy(entity_key).agg(*merged)


def _long(df: DataFrame, names: Sequence[str], x: Column, y: dict[str, Column]) -> DataFrame:
    """Complete pairs as ``column, x, y``, one row per candidate and input row."""
    cells = [F.struct(F.lit(name).alias("column"), y[name].alias("y")) for name in names]
    long = df.select(x.alias("x"), F.inline(F.array(*cells))).select("column", "x", "y")
    return long.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def _merged(pairs: DataFrame) -> DataFrame:
    """Equal pairs as one row with their count ``n``.

    Merging starts on the map side, so a pair held by a third of all rows shrinks to one
    row per task before anything is shuffled.
    """
    return pairs.groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def _cuts(side: str) -> dict[str, Column]:
    """The clipping quantiles of one ranked side as aggregates, linearly interpolated."""
    found = {}
    for name, p in CLIP.items():
        place = F.lit(float(p)) * (F.col(f"{side}_total") - 1)
        before, upto = F.col(f"{side}_before"), F.col(f"{side}_before") + F.col(f"{side}_same")
        low, high = (F.max(F.when((before <= edge(place)) & (edge(place) < upto), F.col(side))) for edge in (F.floor, F.ceil))
        part = F.max(place - F.floor(place))
        found[name] = F.when(part == 0, low).otherwise(low * (1 - part) + high * part)
    return found


def numeric_numeric(pairs: DataFrame) -> DataFrame:
    """Spearman and winsorised Pearson per candidate from ``column, x, y`` rows.

    Equal pairs are counted first; then each side is ranked where its rows lie, so ranks are never joined back
    and a value with a third of all rows spreads over tasks.
    """
    joined = _merged(pairs)
    for side, other in (("x", "y"), ("y", "x")):
        joined = with_ranks(joined, ["column"], side, "n", [other], prefix=f"{side}_")
    limits = joined.groupBy("column").agg(
        *[cut.alias(f"{side}_{name}") for side in ("x", "y") for name, cut in _cuts(side).items()],
        *[F.count_if(f"{side}_opens").alias(f"{side}_levels") for side in ("x", "y")],
    )
    # One row per candidate column, so the broadcast is bounded by the candidate limit.
    joined = joined.join(F.broadcast(limits), "column")
    for side in ("x", "y"):
        clipped = F.least(F.greatest(F.col(side), F.col(f"{side}_low")), F.col(f"{side}_high"))
        # Measuring from the median keeps the sums of squares well conditioned.
        joined = joined.withColumns({f"c{side}": clipped - F.col(f"{side}_middle"), f"r{side}": F.col(f"{side}_rank") - (F.col(f"{side}_total") + 1) / 2})
    n = F.col("n")
    sums = joined.groupBy("column").agg(
        F.sum(n).alias("size"),
        F.min(F.least("x_levels", "y_levels")).alias("levels"),
        *[
            F.sum(n * F.col(a) * F.col(b)).alias(f"{a}_{b}")
            for a, b in (("rx", "ry"), ("rx", "rx"), ("ry", "ry"), ("cx", "cy"), ("cx", "cx"), ("cy", "cy"))
        ],
        F.sum(n * F.col("cx")).alias("cx"),
        F.sum(n * F.col("cy")).alias("cy"),
    )
    size = F.col("size")
    cross = F.col("cx_cy") - F.col("cx") * F.col("cy") / size
    spread = (F.col("cx_cx") - F.col("cx") * F.col("cx") / size) * (F.col("cy_cy") - F.col("cy") * F.col("cy") / size)
    varied = F.col("levels") > 1
    return sums.select(
        "column",
        F.when(varied, F.try_divide(F.col("rx_ry"), F.sqrt(F.col("rx_rx") * F.col("ry_ry")))).otherwise(0.0).alias("score"),
        F.when(varied, F.try_divide(cross, F.sqrt(F.greatest(spread, F.lit(0.0))))).otherwise(0.0).alias("pearson"),
        F.col("size").alias("sample_size"),
    )


def categorical_categorical(pairs: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Bias-corrected Cramér's V per candidate; candidates above ``max_levels`` levels are left out."""
    cells = _merged(pairs)
    n, size = F.col("n"), F.col("size")
    rows = cells.groupBy("column", "x").agg(F.sum("n").alias("row_n"))
    columns = cells.groupBy("column", "y").agg(F.sum("n").alias("column_n"))
    levels = (
        rows.groupBy("column")
        .agg(F.count(F.lit(1)).alias("r"), F.sum("row_n").alias("size"))
        .join(columns.groupBy("column").agg(F.count(F.lit(1)).alias("k")), "column")
        .where(F.greatest("r", "k") <= max_levels)
    )
    # One row per candidate column, so the broadcast is bounded by the candidate limit.
    known = cells.join(F.broadcast(levels), "column").join(rows, ["column", "x"]).join(columns, ["column", "y"])
    table = known.groupBy("column", "size", "r", "k").agg(
        F.sum(n.cast("double") * n / (F.col("row_n").cast("double") * F.col("column_n"))).alias("ratio")
    )
    rest = F.greatest(size - 1, F.lit(1))
    r, k = F.col("r"), F.col("k")
    phi = F.greatest(F.lit(0.0), (F.col("ratio") - 1) - (k - 1) * (r - 1) / rest)
    r_fixed = r - (r - 1) * (r - 1) / rest
    k_fixed = k - (k - 1) * (k - 1) / rest
    room = F.least(k_fixed - 1, r_fixed - 1)
    score = F.when((F.least("r", "k") >= 2) & (room > 0), F.sqrt(F.try_divide(phi, room))).otherwise(0.0)
    return table.select("column", score.alias("score"), F.lit(None).cast("double").alias("pearson"), size.alias("sample_size"))


def categorical_numeric(groups: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Eta squared per candidate from ``column, category, n, average, spread`` rows."""
    weighted = F.sum(F.col("n") * F.col("average"))
    whole = groups.groupBy("column").agg(
        F.count(F.lit(1)).alias("levels"), F.sum("n").alias("size"), (weighted / F.sum("n")).alias("middle")
    )
    # One row per candidate column, so the broadcast is bounded by the candidate limit.
    seen = groups.join(F.broadcast(whole.where(F.col("levels") <= max_levels)), "column")
    away = F.col("average") - F.col("middle")
    between = F.sum(F.col("n") * away * away)
    share = F.try_divide(between, F.sum(F.col("spread")) + between)
    return (
        seen.groupBy("column", "size")
        .agg(F.coalesce(share, F.lit(0.0)).alias("score"))
        .select("column", "score", F.lit(None).cast("double").alias("pearson"), F.col("size").alias("sample_size"))
    )


def _category_groups(df: DataFrame, names: Sequence[str], category: dict[str, Column], value: dict[str, Column]) -> DataFrame:
    cells = [
        F.struct(F.lit(name).alias("column"), category[name].alias("category"), value[name].alias("v")) for name in names
    ]
    long = df.select(F.inline(F.array(*cells))).where(F.col("category").isNotNull() & F.col("v").isNotNull())
    return long.groupBy("column", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("v").alias("average"),
        (F.var_pop("v") * F.count(F.lit(1))).alias("spread"),
    )


def daily_trend(pairs: DataFrame) -> DataFrame:
    """Spearman of day order against the daily mean, from ``column, day, v`` rows.

    Fewer than three days score 0. After the daily mean a candidate has one row per
    calendar day, which bounds the windows here.
    """
    daily = pairs.groupBy("column", "day").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy("column")
    ties = W.partitionBy("column", "mean")
    ranked = daily.select(
        "column",
        "n",
        F.row_number().over(whole.orderBy("day")).cast("double").alias("day_rank"),
        (F.rank().over(whole.orderBy("mean")) + (F.count(F.lit(1)).over(ties) - 1) / 2).alias("mean_rank"),
    )
    score = F.when(F.count(F.lit(1)) >= MIN_DAYS, F.corr("day_rank", "mean_rank")).otherwise(0.0)
    return ranked.groupBy("column").agg(score.alias("score"), F.sum("n").alias("sample_size")).select(
        "column", "score", F.lit(None).cast("double").alias("pearson"), "sample_size"
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``column, score, pearson, sample_size`` for two numeric columns."""
    require(df, [x, y])
    return numeric_numeric(_long(df, [y], as_double(df, x), {y: as_double(df, y)}))


def winsorized_pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return spearman(df, x, y).select("column", F.col("pearson").alias("score"), "sample_size")


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    require(df, [x, y])
    return categorical_categorical(_long(df, [y], F.col(x), {y: F.col(y)}))


def eta_squared(df: DataFrame, category: str, value: str) -> DataFrame:
    require(df, [category, value])
    return categorical_numeric(_category_groups(df, [value], {value: F.col(category)}, {value: as_double(df, value)}))


def _day_pairs(df: DataFrame, names: Sequence[str], time: dict[str, Column], value: dict[str, Column]) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("column"), F.to_date(time[n]).alias("day"), value[n].alias("v")) for n in names]
    return df.select(F.inline(F.array(*cells))).where(F.col("day").isNotNull() & F.col("v").isNotNull())


def trend(df: DataFrame, time_column: str, value: str) -> DataFrame:
    require(df, [time_column, value])
    return daily_trend(_day_pairs(df, [value], {value: to_time(df, time_column)}, {value: as_double(df, value)}))


def _relation(chosen: str, other: str) -> str | None:
    kinds = {chosen, other}
    if kinds == {"numeric"}:
        return "numeric_numeric"
    if kinds == {"categorical"}:
        return "categorical_categorical"
    if kinds == {"categorical", "numeric"}:
        return "categorical_numeric"
    return "datetime_numeric" if kinds == {"datetime", "numeric"} else None


def _score(df: DataFrame, relation: str, chosen: str, chosen_type: str, names: list[str], max_levels: int) -> DataFrame:
    if relation == "numeric_numeric":
        return numeric_numeric(_long(df, names, as_double(df, chosen), {n: as_double(df, n) for n in names}))
    if relation == "categorical_categorical":
        texts = {n: F.col(n).cast("string") for n in names}
        return categorical_categorical(_long(df, names, F.col(chosen).cast("string"), texts), max_levels)
    if relation == "categorical_numeric":
        fixed = chosen_type == "categorical"
        category = {n: F.col(chosen if fixed else n).cast("string") for n in names}
        value = {n: as_double(df, n if fixed else chosen) for n in names}
        return categorical_numeric(_category_groups(df, names, category, value), max_levels)
    fixed = chosen_type == "datetime"
    time = {n: to_time(df, chosen if fixed else n) for n in names}
    value = {n: as_double(df, n if fixed else chosen) for n in names}
    return daily_trend(_day_pairs(df, names, time, value))


#: Chart of each relation type: its kind, aggregate, time grain, and the semantic type that belongs on the x axis.
#: Without one the chosen column is x.
CHARTS = {
    "numeric_numeric": ("scatter", None, None, None),
    "categorical_categorical": ("heatmap", "count", None, None),
    "categorical_numeric": ("boxplot", None, None, "categorical"),
    "datetime_numeric": ("line", "mean", "day", "datetime"),
}


def _charts(relation: str, chosen: str, chosen_type: str) -> dict[str, Column]:
    """The suggested chart: its type, what goes on each axis, aggregate and time grain."""
    kind, aggregate, grain, across = CHARTS[relation]
    axes = {"chart_x": F.lit(chosen), "chart_y": F.col("column")}
    if across not in (None, chosen_type):
        axes = dict(zip(axes, reversed(axes.values())))
    fixed = {"chart_aggregate": F.lit(aggregate).cast("string"), "chart_time_grain": F.lit(grain).cast("string")}
    return {"chart_type": F.lit(kind), **axes, **fixed}


def at_grain(df: DataFrame, request: Request) -> DataFrame:
    if not request.entity_key:
        if request.grain:
            raise ValueError("grain needs an entity_key")
        return df
    require(df, [request.entity_key])
    if (request.grain or "mean") == "mean":
        return mean_grain(df, request.entity_key, request.order_by)
    if request.grain != "latest":
        raise ValueError(f"unknown grain: {request.grain}")
    if not request.time_column or request.time_column not in df.columns:
        raise ValueError("the latest grain needs a time column of the dataset")
    return latest_grain(df, request.entity_key, request.time_column, request.order_by)


def analyze(df: DataFrame, request: Request, profiled: DataFrame | None = None) -> DataFrame:
    """Scored relations of ``request.column``, best first within each relation type.

    The profile is collected (one row per column) to choose candidates, and numeric relations sort
    their pairs into checkpointed blocks while they are built; the rest is lazy. ``sample_limit`` is off unless given: statistics use all rows.
    """
    # One row per column of the table.
    facts = judged(profile(df) if profiled is None else profiled, request).orderBy("place").collect()
    chosen_type = next((row["semantic_type"] for row in facts if row["name"] == request.column), None)
    if chosen_type is None:
        raise KeyError(request.column)
    if chosen_type in ("identifier", "text"):
        raise ValueError("identifier and free text columns are not compared")
    kept = [row for row in facts if row["place"] is not None]
    needed = list(dict.fromkeys([request.column, *[row["name"] for row in kept]]))
    rows = at_grain(df, request).select(*[F.col(f"`{name}`") for name in needed])
    counted = rows.agg(F.count(F.lit(1)).alias("rows"))
    sampled = F.lit(False)
    total = counted.scalar()
    if request.sample_limit:
        limit = request.sample_limit
        sampled = counted.select(F.col("rows") > limit).scalar()
        total = counted.select(F.least(F.col("rows"), F.lit(limit))).scalar()
        rows = hash_sample(rows, limit, request.seed)
    if request.sample_limit or request.entity_key:
        rows = cut_lineage(rows)  # every relation below reads it, and its making shuffles

    by_relation: dict[str, list[str]] = {}
    for row in kept:
        relation = _relation(chosen_type, row["semantic_type"])
        if relation:
            by_relation.setdefault(relation, []).append(row["name"])
    parts = []
    for relation, names in by_relation.items():
        scored = _score(rows, relation, request.column, chosen_type, names, request.max_levels)
        parts.append(
            scored.where(F.col("sample_size") >= request.minimum_pair_samples)
            .withColumn("relation_type", F.lit(relation))
            .withColumns(_charts(relation, request.column, chosen_type))
        )
    if not parts:
        empty = df.sparkSession.createDataFrame([], RESULT)
        nothing = {name: F.lit(None).cast("string") for name in _charts("numeric_numeric", "", "")}
        parts.append(empty.withColumns(nothing))
    items = reduce(DataFrame.unionByName, parts)
    return _assemble(items, request, total, len(kept), sampled)


def _assemble(items: DataFrame, request: Request, total: Column, compared: int, sampled: Column) -> DataFrame:
    finite = F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0))
    signed = F.col("relation_type").isin(*SIGNED)
    direction = (
        F.when(~signed | (F.abs("score") < NO_DIRECTION), "none").when(F.col("score") > 0, "positive").otherwise("negative")
    )
    method = F.lit(None).cast("string")
    for relation, name in METHODS.items():
        method = F.when(F.col("relation_type") == relation, name).otherwise(method)
    grain = f"At {request.grain or 'mean'} grain per {request.entity_key}: " if request.entity_key else ""
    reason = F.concat(
        F.lit(grain),
        F.format_string("%s is %.3f over %,d complete pairs.", F.col("method"), F.col("score"), F.col("sample_size")),
        F.when(F.col("pearson").isNull(), "").otherwise(
            F.format_string(" Pearson with both 1%% tails clipped is %.3f.", F.col("pearson"))
        ),
    )
    strongest = F.row_number().over(W.partitionBy("relation_type").orderBy(F.abs("score").desc(), "column"))
    ready = (
        items.withColumn("score", finite)
        .withColumn("method", method)
        .withColumn("direction", direction)
        .withColumn("pearson", F.round("pearson", 6))
        .withColumn("reason", reason)
        .withColumn("_place", strongest)
        .where(F.col("_place") <= request.result_limit)
    )
    gap = 1 - F.col("sample_size") / F.greatest(total, F.lit(1))
    return ready.select(
        F.lit(request.column).alias("selected_column"),
        "column",
        "relation_type",
        "method",
        F.round("score", 6).alias("score"),
        "direction",
        "pearson",
        "sample_size",
        F.round(gap, 6).alias("null_ratio"),
        "reason",
        *_charts("numeric_numeric", "", ""),
        F.lit(compared).alias("compared_candidates"),
        sampled.alias("sampled"),
    ).orderBy(F.abs("score").desc(), "column")


def recommend(df: DataFrame, column: str, profiled: DataFrame | None = None) -> DataFrame:
    """The single strongest relation of ``column`` with its suggested chart."""
    return analyze(df, Request(column, result_limit=1), profiled).limit(1)
