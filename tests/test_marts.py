from __future__ import annotations

import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbi.functions.text import text_stat, three_digits
from sparkbi.operators import marts
from sparkbi.operators.catalog import efficiency, reference_prices
from sparkbi.operators.documents import lacking_patches
from sparkbi.operators.pricing import non_negative, price_model
from sparkbi.operators.rates import normalize_rates

STATES = "match_id string, minute int, team_id int, role string, total_gold int, inventory array<long>, win boolean, participant_id int, game_version string, champion_id int"


@pytest.fixture(scope="module")
def states(spark):
    rows = [
        ("m", 10, 100, "MIDDLE", 1000, [1], True, 1, "16.18.1", 5),
        ("m", 10, 100, "TOP", 900, [1, 2], True, 2, "16.18.1", 6),
        ("m", 10, 200, "MIDDLE", 700, None, False, 3, "16.18.1", 7),
        ("m", 10, 200, "TOP", 800, [99, 1, 1], False, 4, "16.18.1", 8),
    ]
    return spark.createDataFrame(rows, STATES)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "Long Sword", 350, 10.0, 0.0, 0.0), (2, "Amplifying Tome", 400, 0.0, 20.0, 0.0)]
    return spark.createDataFrame(rows, "item_id int, item_name string, total_gold int, ad double, ap double, ability_haste double")


def test_context_mart(states, items):
    got = {(row["team_id"], row["role"]): row for row in marts.context_mart(states, items).collect()}
    assert len(got) == 4
    row = got[100, "MIDDLE"]
    assert (row["inventory_cost"], row["item_names"], row["inventory_ad"], row["inventory_ap"]) == (350.0, "Long Sword", 10.0, 0.0)
    assert (row["team_gold_diff"], row["lane_gold_diff"], row["observed_win"]) == (400, 300, 1)
    assert (got[200, "TOP"]["item_names"], got[200, "TOP"]["inventory_cost"]) == ("99, Long Sword, Long Sword", 700.0)
    assert (got[200, "MIDDLE"]["item_names"], got[200, "MIDDLE"]["inventory_cost"]) == ("", 0.0)


def test_inventory_has_one_meaning(spark, items):
    """Small and large ids, repeated snapshots, repeated items, repeated catalog rows, null and unknown ids."""
    held = [[1], [1], [1, 1, 2], [], None, [99], [None, 2], [-5, 1]]
    rows = [("m", 10, 100, "TOP", 5, inventory, True, 1, "16.18.1", 1) for inventory in held]
    answers = []
    for factor in (1, 1_000_000):
        shifted = [(*row[:5], row[5] and [i and i * factor for i in row[5]], *row[6:]) for row in rows]
        catalog = items.union(items).withColumn("item_id", (F.col("item_id") * factor).cast("long"))
        got = marts.inventory_stats(spark.createDataFrame(shifted, STATES), catalog).collect()
        answers.append(sorted((row["inventory_cost"], row["inventory_ad"], row["inventory_ap"]) for row in got))
    assert answers[0] == answers[1]
    assert answers[0] == sorted([(350.0, 10.0, 0.0)] * 3 + [(1100.0, 20.0, 20.0), (400.0, 0.0, 20.0)] + [(0.0, 0.0, 0.0)] * 3)


def test_inventories_are_never_collected(spark, items):
    """The facts of all inventories, or a catalog of many entries, come by shuffle whatever their files' sizes promise."""
    rows = spark.range(2000).select(F.array("id", F.col("id") + 1, "id").alias("inventory"), F.lit("16.18.1").alias("game_version"), F.lit(1).alias("k"))
    many = spark.range(marts.SMALL_CATALOG + 1).select(
        F.col("id").alias("item_id"), F.concat(F.lit("i"), "id").alias("item_name"), F.col("id").alias("total_gold"), F.lit("16.18.1").alias("patch")
    )
    folder = tempfile.mkdtemp(prefix="catalog-")
    rows.write.parquet(f"{folder}/rows")
    many.write.parquet(f"{folder}/many")
    for by_patch in (False, True):
        priced = marts.inventory_stats(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/many"), (), by_patch)
        assert "Broadcast" not in priced._jdf.queryExecution().executedPlan().toString()
        got = priced.agg(F.sum("inventory_cost").alias("cost"), F.max(F.when(F.col("inventory")[0] == 7, F.col("item_names"))).alias("names")).first()
        assert (got["cost"], got["names"]) == (float(3 * sum(range(2000)) + 2000), "i7, i8, i7")


def test_same_number_of_two_inventories(spark, states, items, monkeypatch):
    """No result depends on the hash that inventories travel by."""
    want = sorted(map(str, marts.inventory_stats(states, items).collect()))
    by_patch = items.withColumn("patch", F.lit("16.18.1"))
    monkeypatch.setattr(marts.F, "xxhash64", lambda *columns: F.lit(1).cast("long"))
    assert sorted(map(str, marts.inventory_stats(states, items).collect())) == want
    assert sorted(map(str, marts.inventory_stats(states, by_patch, by_patch=True).collect())) == want


def test_cohorts(states, items):
    context = marts.context_mart(states, items)
    assert sum(row["sample_players"] for row in marts.bucket_cohorts(context).collect()) == 4
    buckets = {(row["gold_bucket_start"], row["gold_bucket_end"]) for row in marts.bucket_cohorts(context).collect()}
    assert buckets == {(1000, 1499), (500, 999)}
    with pytest.raises(ValueError):
        marts.bucket_cohorts(context, 0)
    covered = marts.coverage(context).collect()
    assert sum(row["sample_players"] for row in covered) == 4 and {row["patch"] for row in covered} == {"16.18"}
    assert {row["role"]: row["inventory_missing_ratio"] for row in covered} == {"MIDDLE": 0.5, "TOP": 0.0}
    trend = marts.patch_trend(context).first()
    assert (trend["sample_matches"], trend["observed_win_rate"], trend["average_total_gold"]) == (1, 0.5, 850.0)
    assert marts.win_summary(context).count() == 4


def test_lane_picks_the_first_opponent_without_pairing(spark, partitions):
    rows = [("m", 10, team, "TOP", gold, [], True, pid, "1.1", 1) for pid, (team, gold) in enumerate([(200, 5), (100, 1), (100, 2), (200, 6), (300, 9)])]
    got = {row["participant_id"]: row["total_gold_opponent"] for row in marts.lane_diff(spark.createDataFrame(rows, STATES)).collect()}
    assert got == {0: 1, 3: 1, 1: 5, 2: 5, 4: 5}


def test_few_lanes_do_not_move_the_snapshots(spark, states, items, monkeypatch):
    """Whatever size Spark supposes: a row per lane goes to every task while there are few, and the answer is the same beyond."""
    build = {
        "coverage": lambda: marts.coverage(marts.context_mart(states, items)),
        "lanes": lambda: marts.lane_diff(states),
        "context": lambda: marts.context_mart(states, items),
    }
    off = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {key: spark.conf.get(key, None) for key in off}
    try:
        for key in off:
            spark.conf.set(key, "-1")
        made = {name: query() for name, query in build.items()}
        plans = {name: df._jdf.queryExecution().executedPlan().toString() for name, df in made.items()}
        for plan in plans.values():
            assert any("BroadcastHashJoin" in line and "role" in line for line in plan.splitlines())
            assert not any("SortMergeJoin" in line and "role" in line for line in plan.splitlines())
        got = {name: sorted(map(str, df.collect())) for name, df in made.items()}
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    monkeypatch.setattr(marts, "FEW_LANES", 1)
    assert {name: sorted(map(str, query().collect())) for name, query in build.items()} == got


def _shuffles(df, column):
    """Shuffles of the plan by the column ``column``, among others."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(re.search(rf"Exchange hashpartitioning\(.*\b{column}#", line) is not None for line in plan.splitlines())


def test_snapshots_carry_no_hash_of_their_inventory(spark, states, items):
    """The number that brings items and snapshots together is computed from the inventory, not shuffled beside it."""
    rows = marts.inventory_stats(states, items)
    assert _shuffles(rows, "_number") == 1  # the items
    assert _shuffles(rows, "inventory") == 1  # the snapshots


def test_item_sets_are_moved_once(spark, states, items):
    context = marts.context_mart(states.unionByName(states.withColumn("match_id", F.lit("n"))), items)
    summary = marts.win_summary(context)
    assert _shuffles(summary, "item_names") == 1
    got = {(row["champion_id"], row["item_names"]): (row["sample_players"], row["sample_matches"], row["observed_win_rate"]) for row in summary.collect()}
    assert got == {
        (5, "Long Sword"): (2, 2, 1.0),
        (6, "Long Sword, Amplifying Tome"): (2, 2, 1.0),
        (7, ""): (2, 2, 0.0),
        (8, "99, Long Sword, Long Sword"): (2, 2, 0.0),
    }


def test_lane_without_opponent_and_missing_role(spark):
    rows = [("m", 10, 100, None, 5, [], True, 1, "1.1", 1), ("m", 10, 200, None, 7, [], True, 2, "1.1", 1), ("m", 10, 200, "TOP", 9, [], True, 3, "1.1", 1)]
    got = {row["participant_id"]: row["lane_gold_diff"] for row in marts.lane_diff(spark.createDataFrame(rows, STATES)).collect()}
    assert got == {1: -2, 2: 2, 3: None}


def test_each_patch_uses_its_own_catalog(spark, items):
    rows = [("m", 10, 1, "TOP", 5, [1], True, 1, "16.18.1", 1), ("n", 10, 1, "TOP", 5, [1], True, 1, "16.17.2", 1), ("o", 10, 1, "TOP", 5, [1], True, 1, None, 1)]
    catalog = items.withColumn("patch", F.lit("16.18.1")).union(items.withColumn("total_gold", F.lit(300)).withColumn("patch", F.lit("16.17.1")))
    got = {row["match_id"]: row["inventory_cost"] for row in marts.inventory_stats(spark.createDataFrame(rows, STATES), catalog, by_patch=True).collect()}
    assert got == {"m": 350.0, "n": 300.0, "o": 0.0}


def test_item_events(spark):
    events = spark.createDataFrame([("m", 1, 900_000, "ITEM_PURCHASED", 7), ("m", 1, 30_000, "ITEM_SOLD", 7), ("m", 1, 0, "ITEM_PURCHASED", 8)], "match_id string, participant_id int, timestamp_ms long, event_type string, item_id int")
    items = spark.createDataFrame([(7, "X", 3000, 3, True), (7, "X", 3000, 3, True)], "item_id int, item_name string, total_gold int, item_tier int, is_final_item boolean")
    got = {row["timestamp_ms"]: (row["minute"], row["is_completion_event"]) for row in marts.item_event_mart(events, items).collect()}
    assert got == {900_000: (15.0, True), 30_000: (0.5, False), 0: (0.0, False)}
    plain = marts.item_event_mart(events, items.drop("is_final_item")).collect()
    assert len(plain) == 3 and not any(row["is_completion_event"] for row in plain)


def test_reference_prices_and_efficiency(items, spark):
    prices = reference_prices(items)
    assert {row["stat"]: row["reference_gold_per_unit"] for row in prices.collect()} == {"ad": 35.0, "ap": 20.0}
    extra = items.union(spark.createDataFrame([(3, "Gift", 0, 2.0, None, 0.0)], items.schema))
    got = {row["item_id"]: row for row in efficiency(extra, prices).collect()}
    assert (got[1]["estimated_stat_value"], got[1]["gold_efficiency_percent"], got[1]["passive_shadow_price"]) == (350.0, 100.0, 0.0)
    assert (got[3]["estimated_stat_value"], got[3]["gold_efficiency_percent"], got[3]["passive_shadow_price"]) == (70.0, None, -70.0)


def model_items(spark, count=6):
    rng = np.random.default_rng(1)
    rows = [(i, f"item {i}", float(100 + 30 * a + 20 * b + rng.normal()), float(a), float(b), 0.0) for i, (a, b) in enumerate(rng.integers(0, 12, (count, 2)))]
    return spark.createDataFrame(rows, "item_id int, item_name string, total_gold double, ad double, ap double, mana double")


def test_price_model_recovers_prices(spark):
    items = model_items(spark, 200)
    got = {row["stat"]: row for row in price_model(items, ["ad", "ap", "mana"], row_key=["item_id"], bootstrap=50).collect()}
    assert set(got) == {"ad", "ap"}  # a stat without mass takes no part
    for stat, price in (("ad", 30), ("ap", 20)):
        row = got[stat]
        assert row["ridge_gold_per_unit"] == pytest.approx(price, rel=0.02) and row["nnls_gold_per_unit"] >= 0
        assert row["ci95_low"] <= row["ridge_gold_per_unit"] <= row["ci95_high"] and row["sample_items"] == 200
    again = {row["stat"]: row for row in price_model(items.repartition(7), ["ad", "ap", "mana"], row_key=["item_id"], bootstrap=50).collect()}
    assert again["ad"]["ci95_low"] == pytest.approx(got["ad"]["ci95_low"])


def test_small_and_too_small_models(spark):
    got = price_model(model_items(spark, 6), ["ad", "ap"], bootstrap=20).collect()
    assert all(row["ridge_gold_per_unit"] >= 0 and row["nnls_gold_per_unit"] >= 0 for row in got)
    with pytest.raises(ValueError):
        price_model(model_items(spark, 3), ["ad", "ap"])
    with pytest.raises(ValueError):
        price_model(model_items(spark, 6), ["ad", "ap"], bootstrap=5)


def test_non_negative_solution_meets_its_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 60, 5))
    gram = np.einsum("bni,bnj->bij", x, x) + np.eye(5)
    moment = rng.normal(size=(4, 5)) * 20
    found = non_negative(gram, moment)
    slope = np.einsum("bij,bj->bi", gram, found) - moment
    assert (found >= 0).all() and (slope > -1e-6).all() and np.allclose(found * slope, 0, atol=1e-5)
    assert (found == 0).any()


@pytest.mark.parametrize(
    "text, value",
    [("<b>20</b> Ability Haste", 20.0), ("Ability Haste +15.5", 15.5), ("ability haste 7 and 9 ability haste", 7.0), ("no number", 0.0), (None, 0.0), ("<x>5</x>Ability<br>Haste", 5.0), ("5 <i>Ability</i> Haste", 0.0)],
)
def test_text_stat(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(text_stat(F.col("t"), "Ability Haste")).first()[0] == value


def test_three_digits_equal_c_formatting(spark):
    values = [0.0, 0.5, 100.0, 999.4, 1000.0, 12345.678, 0.00012345, 0.000012345, -2.25, -1e10, 123.456, 1e-7, 50.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", three_digits(F.col("v"))).collect()
    assert {row[0]: row[1] for row in got} == {v: f"{v:.3g}" for v in values}


def test_rates(spark):
    df = spark.createDataFrame([("16.18", "Ahri", "Boots", 120, "52.3", 12.5, "k"), ("16.18", "Ahri", "Boots", None, "0.4", None, "k")], "`Version` string, ` Champion ` string, item string, games int, WinRate string, pickrate double, zone string")
    got = normalize_rates(df)
    assert got.columns == ["patch", "champion_name", "item_name", "sample_games", "pick_rate", "win_rate", "benchmark_source", "usage_scope", "zone"]
    one, two = got.collect()
    assert (one["win_rate"], one["pick_rate"], two["win_rate"], two["pick_rate"]) == (pytest.approx(0.523), 0.125, 0.4, None)


@pytest.mark.parametrize(
    "row, schema",
    [
        (("Ahri", "Boots"), "champ string, item string"),
        (("Ahri", 50.0), "champ string, winrate double"),
        (("Boots", 50.0), "item string, winrate double"),
        (("Ahri", "Boots", 150.0), "champ string, item string, winrate double"),
        (("Ahri", "Boots", -0.5), "champ string, item string, winrate double"),
        (("Ahri", "Boots", -1), "champ string, item string, games int"),
    ],
)
def test_bad_rates(spark, row, schema):
    with pytest.raises(ValueError):
        normalize_rates(spark.createDataFrame([row], schema))


def test_empty_rates(spark):
    with pytest.raises(ValueError):
        normalize_rates(spark.createDataFrame([], "champ string, item string, games int"))


def test_three_digits_in_the_middle(spark):
    """Ties go to the even digit, as the exact binary value decides them."""
    values = [75850.0, 25950.0, 250500.0, 1.265, 26.55, 1.005, -75850.0, 999.5]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", three_digits(F.col("v")).alias("text")).collect()
    assert {row["v"]: row["text"] for row in got} == {v: "%.3g" % v for v in values}
    assert got[0]["text"] == "7.58e+04"


def test_entries_that_hold_for_many_patches_are_not_multiplied(spark, items):
    """A catalog whose entries list their patches answers as one row per patch does, and moves by item alone."""
    patches = [f"16.{number}.1" for number in range(1, 31)]
    listed = items.withColumn("patch", F.array(*[F.lit(patch) for patch in patches]))
    other = items.where("item_id = 1").withColumn("total_gold", F.lit(9999)).withColumn("patch", F.array(F.lit("16.3.1"), F.lit("15.1.1")))
    catalog = listed.unionByName(other)
    rows = [("m", 10, 100, "TOP", 5, inventory, True, 1, f"16.{number}.2", 1) for number in (1, 3, 31) for inventory in ([1, 2, 1], [2], [], None, [99, None, -5, 1 << 40])]
    states = spark.createDataFrame(rows, STATES)
    priced = marts.inventory_stats(states, catalog, by_patch=True)
    want = marts.inventory_stats(states, catalog.withColumn("patch", F.explode("patch")), by_patch=True)
    assert sorted(map(str, priced.collect())) == sorted(map(str, want.collect()))
    assert {row["inventory_cost"] for row in priced.where("size(inventory) = 3").collect()} == {1100.0, 20398.0, 0.0}
    assert _shuffles(priced, "_of_patch") == 0
    assert [row["patch"] for row in lacking_patches(states, catalog).collect()] == ["16.31"]


def test_snapshots_alone_in_their_group_are_not_moved(spark, states, items, monkeypatch, tmp_path):
    """Of a published context only the snapshots of groups with more than one are shuffled; the summary is the same."""
    twice = states.unionByName(states.where("champion_id > 6").withColumn("match_id", F.lit("n"))).unionByName(states.withColumn("minute", F.lit(None).cast("int")))
    marts.context_mart(twice, items).write.parquet(str(tmp_path / "context"))
    context = spark.read.parquet(str(tmp_path / "context"))
    want = marts.win_summary(context)
    for most in (marts.FEW_SETS, 0):
        monkeypatch.setattr(marts, "FEW_SETS", most)
        got = marts.win_summary(context, published=True)
        assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    monkeypatch.undo()
    plan = marts.win_summary(context, published=True)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning", line)]
    assert len(moved) == 1 and "LeftSemi" in plan and "LeftAnti" in plan
