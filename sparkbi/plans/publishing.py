"""Round trips through files and published versions, written under the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkbi.functions.hashing import fingerprint_columns
from sparkbi.operators.recipe import Step
from sparkbi.plans.registry import query, table
from sparkbi.session import checkpoint_dir
from sparkbi.operators.query import Filter
from sparkbi.sources.differences import merged_profile, sync_changed
from sparkbi.sources.files import coerce_datetimes, preview, read_csv, read_parquet, union_all
from sparkbi.sources.published import publish, read_current, run_recipe, sync_named


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"


@query("parquet_read", "SELECT * FROM customer")
def parquet_read(spark, folder):
    return read_parquet(spark, f"{folder}/customer.parquet")


@query("csv_roundtrip", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def csv_roundtrip(spark, folder):
    path = _scratch(spark)
    table(spark, folder, "part").drop("p_type").write.option("header", True).csv(path)
    return read_csv(spark, path, schema="p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double")


@query(
    "coerce_datetimes",
    "SELECT event_id, CASE WHEN event_id % 20 <> 0 THEN ts END AS event_time, CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS VARCHAR) ELSE 'later' END AS due_date FROM events",
)
def coerced(spark, folder):
    text = F.col("ts").cast("string")
    rows = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_id") % 20 != 0, text).otherwise("unknown").alias("event_time"),
        F.when(F.col("event_id") % 5 != 0, text).otherwise("later").alias("due_date"),
    )
    # 95 % of event_time parse, so it is a datetime; 80 % of due_date is too little.
    return coerce_datetimes(rows).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@query("preview")
def previewed(spark, folder):
    return preview(table(spark, folder, "orders"), 100)


@query(
    "preview_ordered",
    "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS o_orderdate) FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def preview_ordered(spark, folder):
    """The preview of an ordered table is its first rows, times in ISO text."""
    return preview(table(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey"), 100)


@query(
    "sync_changed_bucket",
    "SELECT c_custkey, c_name, CASE WHEN c_custkey = 5 THEN 0 ELSE c_acctbal END AS c_acctbal, 1 AS written FROM customer WHERE c_custkey <> 6",
)
def sync_changed_bucket(spark, folder):
    """A changed row rewrites one key bucket; a deleted one another, if it is not the same, in a later sync."""
    root = _scratch(spark)
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    sync_changed(rows, root, "customers", ["c_custkey"], "api")
    paid = rows.withColumn("c_acctbal", F.when(F.col("c_custkey") == 5, 0.0).otherwise(F.col("c_acctbal")))
    sync_changed(paid, root, "customers", ["c_custkey"], "api")
    last = sync_changed(paid.where("c_custkey <> 6"), root, "customers", ["c_custkey"], "api")
    return read_current(spark, root, "customers").withColumn("written", F.lit(len(last["buckets_written"])))


@query(
    "profile_incremental",
    """
    SELECT name AS "column", (SELECT count(*) FROM orders) AS rows, nulls, low, high, true AS distinct_close, true AS median_close, true AS few_read FROM (
        SELECT 'o_orderkey' AS name, 0 AS nulls, min(o_orderkey)::DOUBLE AS low, max(o_orderkey)::DOUBLE AS high FROM orders UNION ALL
        SELECT 'o_custkey', count(*) - count(nullif(o_custkey % 9, 0)), min(CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END)::DOUBLE, max(CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END)::DOUBLE FROM orders UNION ALL
        SELECT 'o_totalprice', 0, min(CASE WHEN o_orderkey = 3 THEN 1e7 ELSE o_totalprice END), max(CASE WHEN o_orderkey = 3 THEN 1e7 ELSE o_totalprice END) FROM orders)
    """,
)
def profile_incremental(spark, folder):
    """The profile after one order changed: the sketches of one bucket are new, all others are merged as they were; estimates lie within four errors."""
    root = _scratch(spark)
    custkey = F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("o_custkey")
    rows = table(spark, folder, "orders").select("o_orderkey", custkey, "o_totalprice")
    changed = rows.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 3, 1e7).otherwise(F.col("o_totalprice")))
    sync_changed(rows, root, "orders", ["o_orderkey"], "api")
    last = sync_changed(changed, root, "orders", ["o_orderkey"], "api")
    names = ["o_orderkey", "o_custkey", "o_totalprice"]
    long = changed.select(F.inline(F.array(*[F.struct(F.lit(name).alias("column"), F.col(name).cast("double").alias("v")) for name in names])))
    made = merged_profile(spark, root, "orders")
    known = long.join(F.broadcast(made.select("column", "median")), "column").groupBy("column").agg(
        F.count_distinct("v").alias("exact"), (F.count_if(F.col("v") <= F.col("median")) / F.count("v")).alias("share")
    )
    near = (F.abs(F.col("distinct") - F.col("exact")) <= 2 + 0.065 * F.col("exact")).alias("distinct_close")
    middle = (F.abs(F.col("share") - 0.5) <= 0.02).alias("median_close")
    return made.join(known, "column").select("column", "rows", "nulls", "low", "high", near, middle, F.lit(len(last["buckets_written"]) == 1).alias("few_read"))


@query(
    "publish_clustered",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, true AS few_files FROM orders
    WHERE o_totalprice > 400000 AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
    """,
)
def publish_clustered(spark, folder):
    """Orders clustered by price and date; a filter on both opens at most half of the sixteen files."""
    root = _scratch(spark)
    publish(table(spark, folder, "orders"), root, "orders", with_profile=False, cluster_by=["o_totalprice", "o_orderdate"], files=16)
    filters = [Filter("o_totalprice", "gt", 400000), Filter("o_orderdate", "gte", "1997-01-01"), Filter("o_orderdate", "lt", "1998-01-01")]
    found = read_current(spark, root, "orders", filters=filters)
    return found.withColumn("few_files", F.lit(len(found.inputFiles()) <= 8))


@query(
    "union_all",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier",
)
def unioned(spark, folder):
    buyers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    sellers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return union_all([buyers, sellers])


@query("fingerprint_stable", "SELECT count(*) AS row_count, true AS same_after_shuffle, false AS same_after_change FROM lineitem")
def fingerprint_stable(spark, folder):
    rows = table(spark, folder, "lineitem")
    one = rows.agg(F.struct(*fingerprint_columns(rows)).alias("f"))
    shuffled = rows.repartition(16, "l_partkey")
    two = shuffled.agg(F.struct(*fingerprint_columns(shuffled)).alias("g"))
    changed = rows.withColumn("l_tax", F.when((F.col("l_orderkey") == 7) & (F.col("l_tax") == 0), 0.5).otherwise(F.col("l_tax") + 0.0) + F.lit(1e-9))
    three = changed.agg(F.struct(*fingerprint_columns(changed)).alias("h"))
    return one.select(
        F.col("f.row_count").alias("row_count"),
        (F.col("f") == two.scalar()).alias("same_after_shuffle"),
        (F.col("f") == three.scalar()).alias("same_after_change"),
    )


@query(
    "publish_roundtrip",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus <> 'P'",
)
def publish_roundtrip(spark, folder):
    """Publish, sync without change, run a recipe as version 2 and read the current version."""
    root = _scratch(spark)
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    publish(rows, root, "orders", with_profile=False)
    if sync_named(rows.repartition(3), root, "orders", "upload")["version_number"] != 1:
        raise RuntimeError("an unchanged frame must not make a version")
    steps = [
        Step("filter", {"column": "o_orderstatus", "operator": "ne", "value": "P"}),
        Step("calculate", {"left": "o_totalprice", "operator": "multiply", "right": 2, "target": "o_totalprice"}),
    ]
    run_recipe(spark, root, "orders", "doubled", steps)
    return read_current(spark, root, "orders")
