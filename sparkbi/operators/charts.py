"""The numbers behind histogram, scatter, box plot and heat map charts.

Each function returns the plotted rows with the sample size repeated on every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from sparkbi.functions.columns import as_double, require
from sparkbi.functions.text import three_digits
from sparkbi.operators.query import Filter, apply_filters
from sparkbi.operators.quantiles import exact_quantiles
from sparkbi.operators.running import hash_sample

TOP_CATEGORIES = 30
MIN_BINS, MAX_BINS = 5, 100
BOX = {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}


def _edge(low: Column, high: Column, index: Column, bins: int) -> Column:
    return F.when(index == bins, high).otherwise(low + index * ((high - low) / bins))


def histogram(df: DataFrame, x: str, bins: int = 20, filters: Sequence[Filter] = ()) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed on the right; empty bins listed.

    A constant column is widened by half a unit each way, an empty one uses [0, 1].
    """
    if not MIN_BINS <= bins <= MAX_BINS:
        raise ValueError(f"bins must be between {MIN_BINS} and {MAX_BINS}")
    require(df, [x])
    values = apply_filters(df, filters).select(as_double(df, x).alias("v")).where(F.col("v").isNotNull())
    low, high = F.min("v"), F.max("v")
    margin = F.when(low == high, 0.5).otherwise(0.0)
    span = values.agg(
        F.struct(
            F.coalesce(low - margin, F.lit(0.0)).alias("low"),
            F.coalesce(high + margin, F.lit(1.0)).alias("high"),
            F.count(F.lit(1)).alias("rows"),
        ).alias("span")
    ).scalar()

    placed = values.withColumn("s", span)
    low, high = F.col("s.low"), F.col("s.high")
    guess = F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    # Division may land one bin off right at an edge; the edges themselves decide.
    exact = (
        F.when(F.col("v") < _edge(low, high, F.col("g"), bins), F.col("g") - 1)
        .when((F.col("v") >= _edge(low, high, F.col("g") + 1, bins)) & (F.col("g") < bins - 1), F.col("g") + 1)
        .otherwise(F.col("g"))
    )
    counts = placed.withColumn("g", guess).select(exact.alias("bin")).groupBy("bin").count()

    axis = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("s", span)
    lower, upper = _edge(low, high, F.col("bin"), bins), _edge(low, high, F.col("bin") + 1, bins)
    return axis.join(counts, "bin", "left").select(
        "bin",
        lower.alias("lower"),
        upper.alias("upper"),
        F.concat(three_digits(lower), F.lit("–"), three_digits(upper)).alias("label"),
        F.coalesce("count", F.lit(0)).alias("count"),
        F.col("s.rows").alias("sample_size"),
    ).orderBy("bin")


def scatter(
    df: DataFrame, x: str, y: str | None, limit: int = 2000, seed: int = 42, filters: Sequence[Filter] = ()
) -> DataFrame:
    """Non-null pairs; above ``limit`` a seeded sample of exactly that size."""
    if not y:
        raise ValueError("a scatter chart needs a y column")
    require(df, [x, y])
    pairs = (
        apply_filters(df, filters)
        .select(as_double(df, x).alias("x"), as_double(df, y).alias("y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    size = pairs.agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("size")).scalar()
    return hash_sample(pairs, limit, seed).withColumn("sample_size", size)


def _top(values: DataFrame, column: str, top: int) -> DataFrame:
    """The ``top`` most frequent categories; names break ties."""
    return (
        values.groupBy(column)
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.col("rows").desc(), F.col(column).asc())
        .limit(top)
    )


def boxplot(df: DataFrame, group: str | None, x: str, filters: Sequence[Filter] = (), top: int = TOP_CATEGORIES) -> DataFrame:
    """Minimum, quartiles and maximum for the ``top`` most frequent groups."""
    if not group:
        raise ValueError("a box plot needs a group column")
    require(df, [group, x])
    pairs = (
        apply_filters(df, filters)
        .select(F.col(group).alias("category"), as_double(df, x).alias("v"))
        .where(F.col("category").isNotNull() & F.col("v").isNotNull())
    )
    # At most ``top`` rows reach the driver; the names then filter the scan itself.
    most = _top(pairs, "category", top).collect()
    kept = pairs.where(F.col("category").isin([row["category"] for row in most])) if most else pairs.where("false")
    sizes = df.sparkSession.createDataFrame(
        [(row["category"], row["rows"]) for row in most], T.StructType([pairs.schema["category"], T.StructField("rows", T.LongType())])
    )
    return (
        exact_quantiles(kept, ["category"], "v", BOX)
        .join(F.broadcast(sizes), "category")
        .select(F.col("category").cast("string").alias("category"), *BOX, "rows")
        .withColumn("sample_size", F.lit(sum(row["rows"] for row in most)).cast("long"))
        .orderBy(F.col("rows").desc(), "category")
    )


def heatmap(df: DataFrame, x: str, y: str | None, filters: Sequence[Filter] = (), top: int = TOP_CATEGORIES) -> DataFrame:
    """Counts on a dense grid of the ``top`` most frequent x and y texts, zeros included.

    Both axes are counted in one scan; only rows in the grid are then counted as cells.
    """
    if not y:
        raise ValueError("a heat map needs a second category column")
    require(df, [x, y])
    rows = (
        apply_filters(df, filters)
        .select(F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    sides = F.inline(F.array(*[F.struct(F.lit(side).alias("axis"), F.col(side).alias("name")) for side in "xy"]))
    names = rows.select(sides).groupBy("axis", "name").agg(F.count(F.lit(1)).alias("rows"))
    # Tasks keep ``top`` names per axis before the shuffle.
    place = F.row_number().over(W.partitionBy("axis").orderBy(F.desc("rows"), "name"))
    kept = names.withColumn("place", place).where(F.col("place") <= top).collect()
    axes = {side: [row["name"] for row in sorted(kept, key=lambda row: row["place"]) if row["axis"] == side] for side in "xy"}
    size = rows.agg(F.count(F.lit(1)).alias("size")).scalar()
    inside = F.col("x").isin(axes["x"]) & F.col("y").isin(axes["y"]) if kept else F.lit(False)
    cells = rows.where(inside).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(one, two) for one in axes["x"] for two in axes["y"]], "x string, y string")
    return (
        grid.join(F.broadcast(cells), ["x", "y"], "left")  # at most top times top rows
        .select("x", "y", F.coalesce("n", F.lit(0)).alias("count"))
        .withColumn("sample_size", size)
    )
