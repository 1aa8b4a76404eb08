from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row, functions as F

from sparkbi.operators import relationships as rel
from sparkbi.operators.profile import profile, semantic_types


def first(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def noisy(spark):
    rnd = random.Random(3)
    data = []
    for i in range(400):
        x = rnd.choice([0, 0, 0, rnd.randint(1, 60)])  # most rows share one value
        y = x * 2 + rnd.gauss(0, 20) if i % 9 else None
        data.append((x, y, rnd.choice("abc"), f"2024-01-{1 + i % 20:02d}"))
    return pd.DataFrame(data, columns=["x", "y", "c", "d"])


def test_spearman_and_clipped_pearson_match_pandas(spark, noisy, partitions):
    pair = noisy[["x", "y"]].dropna().astype(float)
    ranks = pair.rank()
    clipped = pair.clip(pair.quantile(0.01), pair.quantile(0.99), axis=1)
    got = first(rel.spearman(spark.createDataFrame(noisy.astype(object).where(noisy.notna(), None), "x int, y double, c string, d string"), "x", "y"))
    assert got["sample_size"] == len(pair)
    assert got["score"] == pytest.approx(ranks.x.corr(ranks.y), abs=1e-12)
    assert got["pearson"] == pytest.approx(clipped.x.corr(clipped.y), abs=1e-12)


def test_constant_side_scores_zero(spark):
    df = spark.range(10).select(F.lit(1.0).alias("x"), F.col("id").cast("double").alias("y"))
    got = first(rel.spearman(df, "x", "y"))
    assert (got["score"], got["pearson"]) == (0.0, 0.0)


def test_identical_categories(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "b"), ("b", "b")] * 50, "x string, y string")
    assert first(rel.cramers_v(df, "x", "y"))["score"] > 0.95


def test_cramers_v_matches_the_direct_formula(spark, noisy):
    frame = noisy.assign(g=np.where(noisy.x > 0, "p", noisy.c))
    table = pd.crosstab(frame.g, frame.c).to_numpy(dtype=float)
    n, (r, k) = table.sum(), table.shape
    expected = np.outer(table.sum(1), table.sum(0)) / n
    phi = max(0.0, ((table - expected) ** 2 / expected).sum() / n - (k - 1) * (r - 1) / (n - 1))
    score = math.sqrt(phi / min(k - (k - 1) ** 2 / (n - 1) - 1, r - (r - 1) ** 2 / (n - 1) - 1))
    df = spark.createDataFrame(frame[["g", "c"]])
    assert first(rel.cramers_v(df, "g", "c"))["score"] == pytest.approx(score, abs=1e-12)


def test_too_many_levels_are_skipped_and_single_level_is_zero(spark):
    wide = spark.range(200).select((F.col("id") % 31).cast("string").alias("x"), (F.col("id") % 2).cast("string").alias("y"))
    assert rel.cramers_v(wide, "x", "y").count() == 0
    assert rel.eta_squared(wide.withColumn("v", F.rand(1)), "x", "v").count() == 0
    assert first(rel.cramers_v(wide.withColumn("x", F.lit("one")), "x", "y"))["score"] == 0.0


def test_separated_groups(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 10.0)] * 50, "c string, v double")
    assert first(rel.eta_squared(df, "c", "v"))["score"] > 0.95
    assert first(rel.eta_squared(df.withColumn("v", F.lit(3.0)), "c", "v"))["score"] == 0.0


def test_eta_squared_matches_pandas(spark, noisy):
    pair = noisy[["c", "y"]].dropna()
    mean = pair.y.mean()
    between = sum(len(v) * (v.mean() - mean) ** 2 for _, v in pair.groupby("c").y)
    df = spark.createDataFrame(pair)
    assert first(rel.eta_squared(df, "c", "y"))["score"] == pytest.approx(between / ((pair.y - mean) ** 2).sum(), abs=1e-12)


def test_daily_trend(spark, noisy):
    daily = noisy[["d", "y"]].dropna().groupby("d").y.mean()
    df = spark.createDataFrame(noisy[["d", "y"]].dropna())
    got = first(rel.trend(df, "d", "y"))
    assert got["score"] == pytest.approx(np.corrcoef(np.arange(len(daily)), daily.rank())[0, 1], abs=1e-12)
    short = df.where("d < '2024-01-03'")
    assert first(rel.trend(short, "d", "y"))["score"] == 0.0


def entities(spark):
    data = [(f"e{i}", minute, i * minute, i + minute) for i in range(20) for minute in (10, 20)]
    return spark.createDataFrame(data, "entity string, minute int, gold int, ap int")


def test_latest_grain_keeps_one_row_per_entity(spark):
    request = rel.Request("gold", entity_key="entity", time_column="minute", grain="latest", minimum_pair_samples=20)
    got = rel.analyze(entities(spark), request).collect()
    assert got and {row["sample_size"] for row in got} <= {20}
    assert rel.latest_grain(entities(spark), "entity", "minute").select("minute").distinct().collect() == [Row(minute=20)]


def test_missing_time_counts_as_latest(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", None, 20), ("b", 3, 30), (None, 1, 40), (None, 2, 50)], "k string, t int, v int")
    assert sorted(row["v"] for row in rel.latest_grain(df, "k", "t").collect()) == [20, 30, 50]


def test_mean_grain(spark):
    df = spark.createDataFrame([("a", 1, None, 2.0), ("a", 2, "x", 4.0), ("b", 1, "y", None), ("a", 3, "z", None)], "k string, o int, s string, v double")
    got = {row["k"]: (row["s"], row["v"]) for row in rel.mean_grain(df, "k", ["o"]).collect()}
    assert got == {"a": ("x", 3.0), "b": ("y", None)}


@pytest.mark.parametrize(
    "request_", [rel.Request("gold", grain="mean"), rel.Request("gold", entity_key="nobody"), rel.Request("gold", entity_key="entity", grain="latest"), rel.Request("gold", entity_key="entity", grain="sum")]
)
def test_bad_grains(spark, request_):
    with pytest.raises(ValueError):
        rel.analyze(entities(spark), request_)


def test_boolean_outcome_is_compared(spark):
    df = spark.createDataFrame([(i, i > 10) for i in range(20)], "gold int, win boolean")
    got = rel.analyze(df, rel.Request("win", minimum_pair_samples=20)).collect()
    assert [(row["column"], row["relation_type"], row["direction"]) for row in got] == [("gold", "numeric_numeric", "positive")]


def test_analysis_assembly(spark):
    rnd = random.Random(5)
    data = []
    for i in range(300):
        v = rnd.random()
        data.append((i, v, v + rnd.random() / 10, -v, rnd.random(), "hi" if v > 0.5 else "lo", None if i % 4 == 0 else v * 2, f"free text {rnd.random()}"))
    df = spark.createDataFrame(data, "row_id int, v double, near double, against double, noise double, level string, holes double, words string")
    got = rel.analyze(df, rel.Request("v", result_limit=2)).collect()
    assert [row["column"] for row in got if row["relation_type"] == "numeric_numeric"] == ["against", "holes"]
    by_name = {row["column"]: row for row in got}
    assert by_name["against"]["score"] == -1.0 and by_name["against"]["direction"] == "negative"
    assert by_name["holes"]["sample_size"] == 225 and by_name["holes"]["null_ratio"] == 0.25
    assert (by_name["level"]["chart_type"], by_name["level"]["chart_x"], by_name["level"]["chart_y"]) == ("boxplot", "level", "v")
    assert by_name["level"]["direction"] == "none" and "225 complete pairs" in by_name["holes"]["reason"]
    assert {row["compared_candidates"] for row in got} == {5} and not any(row["sampled"] for row in got)
    assert rel.recommend(df, "v").first()["column"] == "against"
    sampled = rel.analyze(df, rel.Request("v", sample_limit=120)).collect()
    assert all(row["sampled"] and row["sample_size"] <= 120 for row in sampled)
    with pytest.raises(ValueError):
        rel.analyze(df, rel.Request("row_id"))
    with pytest.raises(KeyError):
        rel.analyze(df, rel.Request("nothing"))


def test_no_comparable_column_gives_an_empty_result(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("v"), F.concat(F.lit("text"), "id").alias("words"))
    assert rel.analyze(df, rel.Request("v")).count() == 0


def test_candidate_order_and_limits(spark):
    def fact(name, kind, unique, nulls):
        return (name, kind, unique, nulls, 100)

    facts = [
        fact("x", "numeric", 50, 0.0),
        fact("holes", "numeric", 60, 0.3),
        fact("unique", "numeric", 100, 0.0),
        fact("few", "categorical", 3, 0.0),
        fact("many", "numeric", 80, 0.0),
        fact("empty", "numeric", 10, 0.8),
        fact("single", "numeric", 1, 0.0),
        fact("key", "identifier", 100, 0.0),
        fact("words", "text", 90, 0.0),
    ]
    schema = "name string, semantic_type string, unique_count long, null_ratio double, row_count long, position int"
    table = spark.createDataFrame([(*fact, place) for place, fact in enumerate(facts)], schema)

    def kept(request):
        return [row["name"] for row in rel.judged(table, request).where("place is not null").orderBy("place").collect()]

    assert kept(rel.Request("x")) == ["many", "few", "unique", "holes"]
    assert kept(rel.Request("x", candidate_limit=1)) == ["many"]
    assert kept(rel.Request("x", null_limit=0.2)) == ["many", "few", "unique"]
    assert rel.judged(table, rel.Request("x", max_levels=2)).where("skipped = 'too many levels'").first()["name"] == "few"
    why = {row["column"]: row["reason"] for row in rel.skipped_candidates(table, rel.Request("x", candidate_limit=3), table).collect()}
    assert why == {
        "holes": "beyond the candidate limit", "empty": "too many nulls", "single": "no variation",
        "key": "identifier or free text", "words": "identifier or free text",
    }


def test_semantic_rules(spark):
    rows = [
        (i, i, f"2024-01-{1 + i % 28:02d}" if i % 20 else "soon", "soon" if i % 5 == 0 else "2024-01-01", i % 2 == 0, "ab"[i % 2], f"sentence {i}", None, float(i), "x" * 90)
        for i in range(100)
    ]
    schema = "id int, paid int, order_date string, due_time string, flag boolean, level string, words string, nothing string, price double, long string"
    got = {row["name"]: row["semantic_type"] for row in semantic_types(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "id": "identifier",
        "paid": "identifier",
        "order_date": "datetime",
        "due_time": "categorical",
        "flag": "numeric",
        "level": "categorical",
        "words": "text",
        "nothing": "text",
        "price": "numeric",
        "long": "text",
    }


def test_profile_facts(spark):
    df = spark.createDataFrame([(1.0, "a", None), (3.0, "a", "q"), (None, "b", None)], "v double, s string, n string")
    got = {row["name"]: row for row in profile(df).collect()}
    assert (got["v"]["null_count"], got["v"]["null_ratio"], got["v"]["unique_count"]) == (1, 0.333333, 2)
    assert (got["v"]["minimum"], got["v"]["maximum"], got["v"]["mean"]) == (1.0, 3.0, 2.0)
    assert sorted(got["s"]["sample_values"]) == ["a", "b"] and got["n"]["sample_values"] == ["q"]
    close = {row["name"]: row["unique_count"] for row in profile(df, approximate=True).collect()}
    assert close == {"v": 2, "s": 2, "n": 1}
    assert [row["unique_count"] for row in profile(df.where("false")).collect()] == [0, 0, 0]


def test_long_texts_are_told_apart_whole(spark):
    df = spark.createDataFrame([("x" * 5000 + str(i % 3),) for i in range(30)], "t string")
    assert profile(df).first()["unique_count"] == 3
