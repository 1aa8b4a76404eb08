from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkbi.operators.charts import boxplot, heatmap, histogram, scatter
from sparkbi.operators.metrics import Metric, Widget, dashboard, metric, metrics
from sparkbi.operators.query import Filter, Query, query


def rows(df):
    return [tuple(row) for row in df.collect()]


@pytest.fixture
def spend(spark):
    data = [("search", "KR", 100.0), ("social", "KR", 30.0), ("search", "US", 50.0)]
    return spark.createDataFrame(data, "channel string, region string, spend double")


def test_filtered_group_sum_is_descending(spend):
    got = query(spend, Query("channel", measure="spend", filters=[Filter("region", "eq", "KR")]))
    assert rows(got) == [("search", 100.0), ("social", 30.0)]


def test_unknown_columns_are_named(spend):
    with pytest.raises(ValueError, match="profit, revenue"):
        query(spend, Query("channel", measure="revenue", filters=[Filter("profit", "eq", 1)]))


def test_measure_is_needed(spend):
    with pytest.raises(ValueError):
        query(spend, Query("channel", aggregation="mean"))
    with pytest.raises(ValueError):
        query(spend, Query("region", measure="channel", aggregation="sum"))


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 1001}, {"aggregation": "median"}, {"filters": [Filter("a")] * 21}])
def test_request_bounds(bad):
    with pytest.raises(ValueError):
        Query("a", measure="b", **bad)


def test_numeric_dimension_ascends(spark):
    df = spark.createDataFrame([(20, 5.0), (10, 1.0), (15, 9.0)], "minute int, gold double")
    assert [row[0] for row in rows(query(df, Query("minute", measure="gold")))] == [10, 15, 20]


def test_series_rows_and_order(spark):
    df = spark.createDataFrame([(10, "b", 1.0), (10, "a", 2.0), (5, "a", 3.0), (5, "b", 4.0)], "minute int, patch string, gold double")
    got = query(df, Query("minute", "patch", "gold", "mean"))
    assert got.columns == ["category", "series", "value"]
    assert rows(got) == [(5, "a", 3.0), (5, "b", 4.0), (10, "a", 2.0), (10, "b", 1.0)]


def test_null_rules(spark):
    df = spark.createDataFrame([("a", None), (None, 1.0), (None, 2.0), ("b", 5.0)], "k string, v double")
    assert rows(query(df, Query("k", measure="v"))) == [("b", 5.0), (None, 3.0), ("a", 0.0)]
    assert rows(query(df, Query(measure="v", filters=[Filter("k", "eq", "a")]))) == [(0.0,)]
    assert rows(query(df, Query(measure="v", aggregation="mean", filters=[Filter("k", "eq", "a")]))) == [(None,)]
    assert rows(query(df, Query(aggregation="count", filters=[Filter("k", "ne", "b")]))) == [(3,)]
    assert rows(query(df, Query(aggregation="count", filters=[Filter("v", "gt", 0)]))) == [(3,)]
    assert rows(query(df, Query(aggregation="count", filters=[Filter("v", "eq", None)]))) == [(1,)]
    assert rows(query(df, Query(aggregation="count", filters=[Filter("k", "in", ["a", None])]))) == [(3,)]


def test_literal_without_a_typed_form_matches_nothing(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert rows(query(df, Query(aggregation="count", filters=[Filter("x", "eq", "abc")]))) == [(0,)]
    assert rows(query(df, Query(aggregation="count", filters=[Filter("x", "ne", 1.5)]))) == [(2,)]
    assert rows(query(df, Query(aggregation="count", filters=[Filter("x", "gt", 1.5)]))) == [(1,)]


def test_boolean_measure(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "k string, w boolean")
    assert rows(query(df, Query("k", measure="w", aggregation="mean"))) == [("b", 1.0), ("a", 0.5)]


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 7).alias("g"), F.lit("x").alias("unused")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = query(df, Query("g", aggregation="count", filters=[Filter("id", "gte", 900)]))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,900)" in plan
    assert "ReadSchema: struct<id:bigint,g:bigint>" in plan


def test_histogram_edges_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.2,), (0.3,), (1.0,), (None,)], "x double")
    got = histogram(df, "x", 10)
    assert [row["count"] for row in got.collect()] == [1, 1, 2, 0, 0, 0, 0, 0, 0, 1]  # 0.3 lies below 3 * 0.1
    first = got.first()
    assert (first["label"], first["sample_size"]) == ("0–0.1", 5)


def test_histogram_of_a_constant_and_of_nothing(spark):
    same = histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 5).collect()
    assert (same[0]["lower"], same[-1]["upper"], [row["count"] for row in same]) == (2.5, 3.5, [0, 0, 2, 0, 0])
    none = histogram(spark.createDataFrame([], "x double"), "x", 5).collect()
    assert (none[0]["lower"], none[-1]["upper"], sum(row["count"] for row in none)) == (0.0, 1.0, 0)


def test_scatter_is_exact_and_repeatable(spark):
    df = spark.range(500).select(F.col("id").cast("int").alias("x"), (F.col("id") * 2).cast("int").alias("y"))
    one = scatter(df, "x", "y", 100, seed=7)
    two = scatter(df.repartition(9), "x", "y", 100, seed=7)
    assert sorted(rows(one)) == sorted(rows(two))
    assert one.count() == 100 and one.first()["sample_size"] == 100
    assert sorted(rows(scatter(df, "x", "y", 100, seed=8))) != sorted(rows(one))


def test_scatter_of_copies_keeps_its_size(spark):
    same = spark.range(1000).select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    assert scatter(same, "x", "y", 300).count() == 300
    assert scatter(same.limit(50), "x", "y", 300).count() == 50


def test_boxplot_keeps_thirty_groups(spark, partitions):
    df = spark.range(2000).select((F.col("id") % 40).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    df = df.union(spark.range(1000).select(F.lit("hot").alias("g"), F.col("id").cast("double").alias("v")))
    got = {row["category"]: row for row in boxplot(df, "g", "v").collect()}
    assert len(got) == 30 and got["hot"]["sample_size"] == 1000 + 29 * 50
    hot = got["hot"]
    assert [hot[name] for name in ("minimum", "q1", "median", "q3", "maximum")] == [0.0, 249.75, 499.5, 749.25, 999.0]


def test_heatmap_is_dense_and_sized_before_the_cut(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 2)], "x string, y int")
    got = heatmap(df, "x", "y")
    assert sorted(rows(got)) == [("a", "1", 2, 3), ("a", "2", 0, 3), ("b", "1", 0, 3), ("b", "2", 1, 3)]


def test_metrics(spark):
    df = spark.createDataFrame([(100.0, 50.0), (200.0, 100.0)], "revenue double, spend double")
    assert rows(metric(df, Metric("roas", "ratio", numerator="revenue", denominator="spend"))) == [(2.0,)]
    got = rows(metrics(df, [Metric("m", "mean", "revenue", unit="KRW"), Metric("n", "count")]))
    assert got == [("m", "KRW", 150.0), ("n", None, 2.0)]
    with pytest.raises(ValueError):
        Metric("r", "ratio", numerator="revenue")


def test_dashboard_shares_scans(spend):
    widgets = [
        Widget("a", "bar", "s", "spend", dimension="channel"),
        Widget("b", "bar", "s", None, "count", dimension="channel"),
        Widget("c", "kpi", "s", "spend", "max"),
    ]
    board = dashboard({"s": spend}, widgets, Filter("region", "eq", "KR"))
    assert sorted(rows(board), key=str) == [
        ("a", "search", None, 100.0),
        ("a", "social", None, 30.0),
        ("b", "search", None, 1.0),
        ("b", "social", None, 1.0),
        ("c", None, None, 100.0),
    ]
    with pytest.raises(ValueError):
        Widget("d", "pie", "s")
