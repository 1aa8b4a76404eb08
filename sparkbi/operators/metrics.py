"""Named metrics and multi-widget dashboards, batched into shared scans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkbi.functions.columns import number, require, sum0
from sparkbi.operators import charts
from sparkbi.operators.query import AGGREGATIONS, Filter, aggregate_column, apply_filters, is_ordered

CHART_KINDS = ("histogram", "scatter", "boxplot", "heatmap")
QUERY_KINDS = ("kpi", "bar", "line")
MAX_WIDGET_ROWS = 1000


@dataclass(frozen=True)
class Metric:
    name: str
    aggregation: str
    column: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    unit: str | None = None

    def __post_init__(self) -> None:
        if self.aggregation not in (*AGGREGATIONS, "ratio"):
            raise ValueError(f"unsupported aggregation: {self.aggregation}")
        if self.aggregation == "ratio" and not (self.numerator and self.denominator):
            raise ValueError("a ratio metric needs a numerator and a denominator")


def metric_column(df: DataFrame, metric: Metric) -> Column:
    require(df, [metric.column, metric.numerator, metric.denominator])
    if metric.aggregation == "ratio":
        top, bottom = sum0(number(df, metric.numerator)), sum0(number(df, metric.denominator))
        return F.try_divide(top.cast("double"), bottom.cast("double"))
    return aggregate_column(df, metric.aggregation, metric.column).cast("double")


def metric(df: DataFrame, definition: Metric) -> DataFrame:
    """One metric as a one-row frame with column ``value``."""
    return df.agg(metric_column(df, definition).alias("value"))


def metrics(df: DataFrame, definitions: Sequence[Metric]) -> DataFrame:
    """Every metric of one dataset from a single scan: ``name, unit, value``."""
    values = [metric_column(df, item).alias(f"m{index}") for index, item in enumerate(definitions)]
    rows = [
        F.struct(
            F.lit(item.name).alias("name"),
            F.lit(item.unit).cast("string").alias("unit"),
            F.col(f"m{index}").alias("value"),
        )
        for index, item in enumerate(definitions)
    ]
    return df.agg(*values).select(F.inline(F.array(*rows)))


@dataclass(frozen=True)
class Widget:
    widget_id: str
    kind: str
    dataset: str
    column: str | None = None
    aggregation: str = "sum"
    dimension: str | None = None
    series: str | None = None
    secondary: str | None = None
    limit: int = 100
    bins: int = 20
    sample_limit: int = 2000
    seed: int = 42
    top: int = charts.TOP_CATEGORIES

    def __post_init__(self) -> None:
        if self.kind not in (*QUERY_KINDS, *CHART_KINDS):
            raise ValueError(f"unknown widget type: {self.kind}")
        if not 1 <= self.limit <= MAX_WIDGET_ROWS:
            raise ValueError(f"limit must be between 1 and {MAX_WIDGET_ROWS}")


def dashboard(
    datasets: dict[str, DataFrame], widgets: Sequence[Widget], shared: Filter | None = None
) -> DataFrame:
    """All widgets in long form: ``widget_id, category, series, value``.

    The shared filter is applied once per dataset. Widgets with the same dataset,
    dimension and series are computed by one aggregate, so a dashboard costs one scan per
    distinct grouping rather than one per widget.
    """
    filtered = {
        name: apply_filters(df, [shared] if shared else [])
        for name, df in datasets.items()
        if any(widget.dataset == name for widget in widgets)
    }
    groups: dict[tuple, list[Widget]] = {}
    parts = []
    for widget in widgets:
        if widget.kind in CHART_KINDS:
            parts.append(_chart(filtered[widget.dataset], widget))
        else:
            groups.setdefault((widget.dataset, widget.dimension, widget.series), []).append(widget)
    parts += [_grouped(filtered[name], dim, series, members) for (name, dim, series), members in groups.items()]
    return reduce(DataFrame.unionByName, parts)


def _text(name: str | None) -> Column:
    return F.col(name).cast("string") if name else F.lit(None).cast("string")


def _grouped(df: DataFrame, dimension: str | None, series: str | None, members: list[Widget]) -> DataFrame:
    keys = [name for name in (dimension, series) if name]
    require(df, [*keys, *[widget.column for widget in members]])
    aggregates = {
        f"v{index}": aggregate_column(df, widget.aggregation, widget.column).cast("double")
        for index, widget in enumerate(members)
    }
    table = df.groupBy(*[F.col(name) for name in keys]).agg(*[c.alias(name) for name, c in aggregates.items()])
    values = F.array(
        *[
            F.struct(F.lit(w.widget_id).alias("widget_id"), F.lit(w.limit).alias("_limit"), F.col(f"v{i}").alias("value"))
            for i, w in enumerate(members)
        ]
    )
    long = table.select(*keys, F.inline(values))
    if dimension:
        order = [F.col(name).asc_nulls_last() for name in keys]
        if not is_ordered(df, dimension):
            order.insert(0, F.col("value").desc_nulls_last())
        # A rank limit per widget; Spark prunes each task to the largest limit before the shuffle.
        place = F.row_number().over(W.partitionBy("widget_id").orderBy(*order))
        most = max(widget.limit for widget in members)
        long = long.withColumn("_place", place).where((F.col("_place") <= most) & (F.col("_place") <= F.col("_limit")))
    return long.select("widget_id", _text(dimension).alias("category"), _text(series).alias("series"), "value")


def _chart(df: DataFrame, widget: Widget) -> DataFrame:
    label = F.lit(widget.widget_id).alias("widget_id")
    if widget.kind == "histogram":
        rows = charts.histogram(df, widget.column, widget.bins)
        return rows.select(
            label,
            F.col("label").alias("category"),
            _text(None).alias("series"),
            F.col("count").cast("double").alias("value"),
        )
    if widget.kind == "scatter":
        rows = charts.scatter(df, widget.column, widget.secondary, widget.sample_limit, widget.seed)
        return rows.select(
            label, F.col("x").cast("string").alias("category"), _text(None).alias("series"), F.col("y").alias("value")
        )
    if widget.kind == "boxplot":
        rows = charts.boxplot(df, widget.dimension, widget.column, top=widget.top)
        corners = F.array(*[F.struct(F.lit(name).alias("series"), F.col(name).alias("value")) for name in charts.BOX])
        return rows.select(label, "category", F.inline(corners))
    rows = charts.heatmap(df, widget.column, widget.secondary, top=widget.top)
    return rows.select(
        label, F.col("x").alias("category"), F.col("y").alias("series"), F.col("count").cast("double").alias("value")
    )
