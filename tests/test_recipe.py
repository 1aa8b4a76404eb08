from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkbi.operators.recipe import Step, apply_step, build_recipe


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def test_join_on_different_names(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "campaign_id string, spend int")
    right = spark.createDataFrame([("a", "search"), ("b", "social")], "campaign_key string, channel string")
    config = {"right_dataset_id": "r", "left_on": ["campaign_id"], "right_on": ["campaign_key"], "validate": "one_to_one"}
    got = apply_step(left, "join", config, lookup=lambda name: right)
    assert rows(got) == [("a", 1, "a", "search"), ("b", 2, "b", "social")]


@pytest.mark.parametrize("validate, fails", [("one_to_one", True), ("many_to_one", True), ("one_to_many", False), (None, False), ("many_to_many", False)])
def test_join_cardinality(spark, validate, fails):
    left = spark.createDataFrame([("a",)], "id string")
    right = spark.createDataFrame([("a", 1), ("a", 2)], "id string, v int")
    config = {"right_dataset_id": "r", "left_on": ["id"], "validate": validate}
    if fails:
        with pytest.raises(ValueError):
            apply_step(left, "join", config, lookup=lambda name: right)
    else:
        assert rows(apply_step(left, "join", config, lookup=lambda name: right)) == [("a", 1), ("a", 2)]


def test_join_null_keys_and_suffix(spark):
    left = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("y", 20)], "k string, v int")
    config = {"right_dataset_id": "r", "left_on": ["k"]}
    got = apply_step(left, "join", config, lookup=lambda name: right)
    assert got.columns == ["k", "v", "v_right"]
    assert rows(got) == [("x", 2, None), (None, 1, 10)]


@pytest.mark.parametrize("config", [{"left_on": []}, {"left_on": ["k"], "right_on": ["k", "v"]}, {"left_on": ["k"], "how": "outer"}, {"left_on": ["k"], "validate": "1:1"}])
def test_bad_joins(spark, config):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError):
        apply_step(df, "join", {"right_dataset_id": "r", **config}, lookup=lambda name: df)


def test_casts_turn_bad_values_into_null(spark):
    df = spark.createDataFrame([("1.5", "2024-01-02"), ("x", "2024/01/03 10:20"), (None, "never")], "n string, t string")
    got = build_recipe(df, [Step("cast", {"column": "n", "dtype": "number"}), Step("cast", {"column": "t", "dtype": "datetime"})])
    assert [(row["n"], str(row["t"])) for row in got.collect()] == [(1.5, "2024-01-02 00:00:00"), (None, "2024-01-03 10:20:00"), (None, "None")]
    with pytest.raises(ValueError):
        apply_step(df, "cast", {"column": "n", "dtype": "money"})


@pytest.mark.parametrize("method, filled", [("mean", 2.6), ("median", 2.0), ("mode", 2), ("value", 9)])
def test_fill(spark, method, filled):
    df = spark.createDataFrame([(1,), (2,), (2,), (4,), (4,), (None,)], "x int")
    got = apply_step(df, "fill_missing", {"column": "x", "method": method, "value": 9})
    assert sorted(row[0] for row in got.collect()) == sorted([1, 2, 2, 4, 4, filled])


def test_fill_edge_cases(spark):
    empty = spark.createDataFrame([(None,)], "x int")
    assert rows(apply_step(empty, "fill_missing", {"column": "x", "method": "mode"})) == [(None,)]
    with pytest.raises(ValueError):
        apply_step(empty, "fill_missing", {"column": "x"})


@pytest.mark.parametrize("keep, kept", [("first", [("a", 1), ("b", 5)]), ("last", [("a", 3), ("b", 5)]), (False, [("b", 5)]), ("none", [("b", 5)])])
def test_drop_duplicates(spark, partitions, keep, kept):
    df = spark.createDataFrame([("a", 2), ("a", 3), ("a", 1), ("b", 5)], "k string, v int")
    assert rows(apply_step(df, "drop_duplicates", {"columns": ["k"], "keep": keep}, ["v"])) == kept
    assert rows(apply_step(df.union(df), "drop_duplicates", {})) == rows(df)


def test_surplus_copies_are_dropped_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 2)], "k string, v int").repartition(3)
    plan = apply_step(df, "drop_duplicates", {"columns": ["k"]}, ["v"])._jdf.queryExecution().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


@pytest.mark.parametrize(
    "operator, value, kept",
    [
        ("eq", "ab", ["ab"]),
        ("ne", "ab", ["a.b", "b", None]),
        ("gt", "ab", ["b"]),
        ("lte", "ab", ["a.b", "ab"]),
        ("contains", ".", ["a.b"]),
        ("in", ["b", None], ["b", None]),
    ],
)
def test_text_filters(spark, operator, value, kept):
    df = spark.createDataFrame([("ab",), ("a.b",), ("b",), (None,)], "s string")
    got = apply_step(df, "filter", {"column": "s", "operator": operator, "value": value})
    assert sorted((row[0] for row in got.collect()), key=str) == sorted(kept, key=str)


def test_bad_filters(spark):
    df = spark.createDataFrame([("ab",)], "s string")
    with pytest.raises(ValueError):
        apply_step(df, "filter", {"column": "s", "operator": "in", "value": "ab"})
    with pytest.raises(ValueError):
        apply_step(df, "filter", {"column": "s", "operator": "like", "value": "ab"})


def test_calculate(spark):
    df = spark.createDataFrame([(6, 3, "x", "y"), (1, 0, "p", None), (0, 0, "", "")], "a int, b int, s string, t string")
    steps = [
        Step("calculate", {"left": "a", "right": "b", "operator": "divide", "target": "q"}),
        Step("calculate", {"left": "a", "right": 2, "operator": "multiply", "target": "m"}),
        Step("calculate", {"left": "s", "right": "t", "operator": "add", "target": "c"}),
        Step("select", {"columns": ["q", "m", "c"]}),
    ]
    assert [tuple(row) for row in build_recipe(df, steps).collect()] == [(2.0, 12, "xy"), (None, 2, None), (None, 0, "")]


def test_aggregate_functions(spark, partitions):
    data = [("a", 1.0, 1), ("a", 3.0, 2), ("a", None, 3), ("b", None, 4), (None, 7.0, 5)]
    df = spark.createDataFrame(data, "k string, v double, o int")
    results = {}
    for function in ("sum", "mean", "count", "min", "max", "median", "std", "var", "nunique", "first", "last", "prod", "any", "all"):
        got = apply_step(df, "aggregate", {"group_by": ["k"], "metrics": {"v": function}}, ["o"]).collect()
        assert [row["k"] for row in got] == ["a", "b", None]
        results[function] = [row["v"] for row in got]
    assert results["sum"] == [4.0, 0.0, 7.0] and results["mean"] == [2.0, None, 7.0]
    assert results["count"] == [2, 0, 1] and results["nunique"] == [2, 0, 1]
    assert results["median"] == [2.0, None, 7.0] and results["first"] == [1.0, None, 7.0] and results["last"] == [3.0, None, 7.0]
    assert results["std"] == [pytest.approx(2**0.5), None, None] and results["var"] == [pytest.approx(2.0), None, None]
    assert results["prod"] == [3.0, 1.0, 7.0] and results["any"] == [True, False, True] and results["all"] == [True, True, True]


@pytest.mark.parametrize("config", [{"group_by": [], "metrics": {"v": "sum"}}, {"group_by": ["k"], "metrics": {"v": "kurt"}}, {"group_by": ["k"], "metrics": {"s": "sum"}}])
def test_bad_aggregates(spark, config):
    df = spark.createDataFrame([("a", 1, "t")], "k string, v int, s string")
    with pytest.raises(ValueError):
        apply_step(df, "aggregate", config)


def test_pivot(spark):
    df = spark.createDataFrame([("r1", "x", 1), ("r1", "x", 2), ("r2", "y", 5), (None, "x", 9), ("r3", None, 9)], "i string, c string, v int")
    got = apply_step(df, "pivot", {"index": "i", "columns": "c", "values": "v"})
    assert got.columns == ["i", "x", "y"] and rows(got) == [("r1", 3, 0), ("r2", 0, 5)]
    mean = apply_step(df, "pivot", {"index": "i", "columns": "c", "values": "v", "aggfunc": "mean", "fill_value": None, "pivot_values": ["y"]})
    assert mean.columns == ["i", "y"]


def test_recipe_limits(spark):
    df = spark.createDataFrame([(1,)], "x int")
    for steps in ([], [Step("select", {"columns": ["x"]})] * 51):
        with pytest.raises(ValueError):
            build_recipe(df, steps)
    with pytest.raises(ValueError):
        apply_step(df, "explode", {})
    with pytest.raises(ValueError, match="y, z"):
        apply_step(df, "select", {"columns": ["z", "x", "y"]})


def test_recipe_is_one_lazy_plan(spark):
    df = spark.range(10).select(F.col("id"), (F.col("id") % 2).alias("g"))
    plan = build_recipe(df, [Step("filter", {"column": "id", "operator": "gt", "value": 3}), Step("aggregate", {"group_by": ["g"], "metrics": {"id": "sum"}})])
    assert rows(plan) == [(0, 18), (1, 21)]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_heavy_keys_are_split(spark, how):
    """Null keys on a third of the rows and one value on another: equal to the plain join, and no task gets either whole."""
    wanted = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id") % 997)
        left = spark.range(30_000).select(key.cast("int").alias("k"), F.lit("same").alias("v")).repartition(8)
        right = spark.range(-1, 500).select(F.when(F.col("id") >= 0, F.col("id")).cast("double").alias("k"), F.col("id").alias("w")).union(spark.sql("SELECT 7D, 70L"))
        config = {"right_dataset_id": "r", "left_on": ["k"], "how": how}
        plain = apply_step(left, "join", config, lookup=lambda name: right)
        split = apply_step(left, "join", config | {"split_heavy": True}, lookup=lambda name: right)
        counts = lambda df: sorted(map(str, df.groupBy(*df.columns).count().collect()))
        assert split.columns == plain.columns and counts(split) == counts(plain)
        most = lambda df: max(row["count"] for row in df.groupBy(F.spark_partition_id()).count().collect())
        assert most(plain) > 10_000 and most(split) < 6_000
        # a heavy key found on one side only, and keys whose types do not compare by hash
        few = right.where("k > 400")
        assert counts(apply_step(left, "join", config | {"split_heavy": True}, lookup=lambda name: few)) == counts(apply_step(left, "join", config, lookup=lambda name: few))
        text = right.select(F.col("k").cast("int").cast("string").alias("k"), "w")
        assert counts(apply_step(left, "join", config | {"split_heavy": True}, lookup=lambda name: text)) == counts(apply_step(left, "join", config, lookup=lambda name: text))
        assert apply_step(left.where("false"), "join", config | {"split_heavy": True}, lookup=lambda name: right).count() == 0
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
