from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window as W, functions as F

from sparkbi.operators.asof import attach_asof
from sparkbi.operators import quantiles, ranks
from sparkbi.operators.quantiles import exact_quantiles
from sparkbi.operators.ranks import with_ranks
from sparkbi.operators.running import BLOCK, blocked, hash_sample, running


def hot(spark, rows=3000):
    """A third of all rows in one group."""
    rnd = random.Random(11)
    data = [("hot" if i % 3 == 0 else f"g{i % 40}", i, rnd.randint(-3, 3)) for i in range(rows)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "g string, o int, v int")


def test_running_equals_a_plain_window(spark, partitions):
    df = hot(spark)
    got = running(df, ["g"], ["o"], sums={"s": F.col("v")}, peaks={"p": "s"}, lasts={"l": F.when(F.col("v") > 2, F.col("v"))}, totals={"t": F.col("v")})
    w = W.partitionBy("g").orderBy("o").rowsBetween(W.unboundedPreceding, 0)
    plain = (
        df.withColumn("s", F.sum("v").over(w))
        .withColumn("p", F.max("s").over(w))
        .withColumn("l", F.last(F.when(F.col("v") > 2, F.col("v")), ignorenulls=True).over(w))
        .withColumn("t", F.sum("v").over(W.partitionBy("g")))
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select(got.columns).collect()))


def test_a_hot_group_is_spread_over_blocks(spark, partitions):
    blocks = blocked(hot(spark), ["g"], ["o"]).where("g = 'hot'").groupBy(BLOCK).agg(F.min("o").alias("a"), F.max("o").alias("b"))
    found = [(row["a"], row["b"]) for row in blocks.orderBy(BLOCK).collect()]
    assert len(found) >= partitions // 4
    assert all(earlier[1] < later[0] for earlier, later in zip(found, found[1:]))


def test_merged_blocks_keep_their_order(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    blocks = blocked(hot(spark, 6000), [], ["o"]).groupBy(BLOCK).agg(F.min("o").alias("a"), F.max("o").alias("b")).orderBy(BLOCK).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(earlier["b"] < later["a"] for earlier, later in zip(blocks, blocks[1:]))


def test_running_without_groups_and_with_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7)], "g string, o int, v int")
    assert sorted(row["s"] for row in running(df, ["g"], ["o"], sums={"s": F.col("v")}).collect()) == [5, 7, 11]
    alone = running(df.withColumn("o", F.col("v")), [], ["o"], sums={"s": F.col("v")})
    assert sorted(row["s"] for row in alone.collect()) == [5, 11, 18]


def test_exact_quantiles_equal_numpy(spark, partitions):
    rnd = np.random.default_rng(2)
    values = {"a": rnd.normal(size=501), "b": rnd.integers(0, 4, 300).astype(float), "c": np.array([7.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    asked = {"p0": 0.0, "p1": 0.01, "p37": 0.37, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for row in exact_quantiles(df, ["g"], "v", asked).collect():
        assert np.allclose([row[name] for name in asked], np.quantile(values[row["g"]], list(asked.values())), atol=1e-12)


@pytest.mark.parametrize("sketch,ranks,margin", [(4096, 2048, 0.002), (64, 32, 0.02), (16, 8, 0.0)])
def test_exact_quantiles_over_many_scans(spark, monkeypatch, sketch, ranks, margin):
    """Small sketches need many scans, and cuts without a margin miss; ties, infinities, null keys and tiny groups stay exact."""
    for name, value in {"SKETCH": sketch, "RANKS": ranks, "FITS": ranks // 2, "MARGIN": margin}.items():
        monkeypatch.setattr(quantiles, name, value)
    rnd = np.random.default_rng(4)
    # a value with a third of the rows
    values = {None: np.r_[rnd.normal(size=700), np.zeros(350)], "t": rnd.integers(0, 3, 900).astype(float), "two": np.array([1.0, 2.0]), "one": np.array([-0.0]), "inf": np.array([-math.inf, 0.0, 1.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("t", None), ("t", math.nan), ("none", None)], "g string, v double").repartition(5)
    asked = {"p0": 0.0, "p1": 0.013, "p33": 0.33, "p50": 0.5, "p100": 1.0}
    got = {row["g"]: row for row in exact_quantiles(df, ["g"], "v", asked).collect()}
    assert set(got) == set(values)
    for g in (None, "t", "two", "one"):
        assert np.allclose([got[g][name] for name in asked], np.quantile(values[g], list(asked.values())), atol=1e-12)
    assert got["inf"]["p0"] == -math.inf and got["inf"]["p50"] == 0.0
    alone = exact_quantiles(df.where("g is null"), [], "v", {"m": 0.5, "q": 0.9}).collect()
    assert np.allclose(list(alone[0]), np.quantile(values[None], [0.5, 0.9]))
    assert exact_quantiles(df.where("false"), [], "v", {"m": 0.5}).collect() == [(None,)] and exact_quantiles(df.where("false"), ["g"], "v", {"m": 0.5}).collect() == []


def test_hash_sample_spreads_over_the_data(spark):
    df = spark.range(20000)
    got = [row["id"] for row in hash_sample(df, 2000, 1).collect()]
    assert len(set(got)) == 2000 and abs(np.mean(got) - 10000) < 600


def test_asof_takes_the_latest_earlier_value(spark, partitions):
    rnd = random.Random(4)
    right = [("hot" if i % 3 else "b", rnd.randint(0, 200), i) for i in range(300)]
    left = [(rnd.choice(["hot", "b", "none"]), rnd.randint(-10, 220), i) for i in range(200)]
    known = spark.createDataFrame(right, "k string, t int, v int")
    asked = spark.createDataFrame(left, "k string, t int, q int")
    got = {row["q"]: row["v"] for row in attach_asof(asked, known, ["k"], "t", "v", ["v"]).collect()}
    for k, t, q in left:
        earlier = [(rt, v) for rk, rt, v in right if rk == k and rt <= t]
        assert got[q] == (max(earlier)[1] if earlier else None)


def test_asof_keeps_a_null_value_as_the_latest(spark):
    known = spark.createDataFrame([("a", 1, 5), ("a", 2, None)], "k string, t int, v int")
    asked = spark.createDataFrame([("a", 3)], "k string, t int")
    assert attach_asof(asked, known, ["k"], "t", "v").first()["v"] is None


def test_hash_sample_draws_rows_not_values(spark):
    """Equal rows come in one by one: heavy values keep their share, though their copies are never written out."""
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 7, "heavy").otherwise(F.concat(F.lit("v"), F.col("id") % 50)).alias("value"))
    samples = [sorted(row["value"] for row in hash_sample(df.repartition(parts), 1000, 5).collect()) for parts in (3, 9)]
    assert samples[0] == samples[1] and len(samples[0]) == 1000
    assert abs(samples[0].count("heavy") - 700) < 75 and len(set(samples[0])) > 10
    assert sorted(row["value"] for row in hash_sample(df.limit(30), 50, 5).collect()) == sorted(row["value"] for row in df.limit(30).collect())


def test_hash_sample_has_the_right_law_and_size(spark):
    """Copies of a value in the sample follow the hypergeometric law; sizes near the number of rows and above are exact."""
    df = spark.range(4000).select(F.when(F.col("id") < 1200, 0).when(F.col("id") < 1600, 1).otherwise(F.col("id")).alias("v"))
    counts = np.array([[sum(row["v"] == v for row in got) for v in (0, 1)] for got in (hash_sample(df, 200, seed).collect() for seed in range(40))])
    for column, many in enumerate((1200, 400)):
        share = many / 4000
        spread = math.sqrt(200 * share * (1 - share) * (3800 / 3999))
        assert abs(counts[:, column].mean() - 200 * share) < 4 * spread / math.sqrt(40) and 0.6 * spread < counts[:, column].std() < 1.5 * spread
    for size in (1, 3700, 3999, 4000, 9000):
        got = hash_sample(df, size, 3).collect()
        assert len(got) == min(size, 4000) and sum(row["v"] == 0 for row in got) <= 1200 and len({row["v"] for row in got if row["v"] > 1}) == sum(row["v"] > 1 for row in got)
    assert hash_sample(df.where("false"), 5, 1).count() == 0
    plan = hash_sample(df, 200, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ranks_in_place(spark, partitions):
    """Groups and single values over many blocks, null groups and weights; against ranks of the written-out rows."""
    rnd = np.random.default_rng(8)
    rows = [(g, float(v), int(t), int(w)) for g in ("a", None, "c") for v, t, w in zip(np.round(rnd.normal(size=120), 1), rnd.permutation(120), rnd.integers(1, 5, 120))]
    rows += [("a", 0.5, 1000 + t, 2) for t in range(260)] + [("one", 7.0, 0, 3)]  # one value with more than a third of all rows
    df = spark.createDataFrame(rows, "g string, v double, t int, w int").repartition(6)
    got = with_ranks(df, ["g"], "v", "w", ["t"], prefix="v_").collect()
    assert sorted((row["g"] or "", row["v"], row["t"], row["w"]) for row in got) == sorted((g or "", v, t, w) for g, v, t, w in rows)
    for g in ("a", None, "c", "one"):
        written = np.array([v for key, v, _, w in rows if key == g for _ in range(w)])
        mine = [row for row in got if row["g"] == g]
        for row in mine:
            assert (row["v_before"], row["v_same"], row["v_total"]) == ((written < row["v"]).sum(), (written == row["v"]).sum(), len(written))
            assert row["v_rank"] == (written < row["v"]).sum() + ((written == row["v"]).sum() + 1) / 2
        assert sorted(row["v"] for row in mine if row["v_opens"]) == sorted(set(written))
    if partitions == 64:  # the hot value is ranked in many tasks
        hot = with_ranks(df, ["g"], "v", "w", ["t"]).where("g = 'a' and v = 0.5").groupBy(F.spark_partition_id()).count().collect()
        assert len(hot) > 10 and max(row["count"] for row in hot) < 60
    assert with_ranks(df.where("false"), ["g"], "v", "w").count() == 0


@pytest.mark.parametrize("size", [1, 7, 100])
def test_ranks_hold_a_block_of_a_fixed_size(spark, monkeypatch, size):
    """A partition of any size is ranked block by block, over groups and values that run through many blocks."""
    monkeypatch.setattr(ranks, "BLOCK_ROWS", size)
    rows = [(g, float(v % 9), v) for g in ("a", None, "b") for v in range(50)] + [("a", 3.0, 100 + t) for t in range(60)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    for row in with_ranks(df, ["g"], "v", "w", ["w"]).collect():
        mine = [(v, w) for g, v, w in rows if g == row["g"]]
        before, same = sum(w for v, w in mine if v < row["v"]), sum(w for v, w in mine if v == row["v"])
        assert (row["before"], row["same"], row["total"], row["rank"]) == (before, same, sum(w for _, w in mine), before + (same + 1) / 2)
    batches = [pa.RecordBatch.from_pydict({"v": list(range(start, start + n))}) for start, n in ((0, 5), (5, 0), (5, 250), (255, 3))]
    tables = list(ranks._blocks(iter(batches), size))
    assert max(map(len, tables)) <= size and [v for table in tables for v in table.column("v").to_pylist()] == list(range(258))
