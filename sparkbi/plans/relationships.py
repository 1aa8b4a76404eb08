"""Column relationships on the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkbi.operators import relationships as rel
from sparkbi.plans.bi import rounded
from sparkbi.plans.registry import query, table


def _rank(column: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0"


def spearman_sql(source: str, x: str, y: str) -> str:
    pairs = f"(SELECT {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"(SELECT coalesce(corr(a, b), 0) FROM (SELECT {_rank('x')} AS a, {_rank('y')} AS b FROM {pairs}))"


def pearson_sql(source: str, x: str, y: str) -> str:
    pairs = f"(SELECT {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    cuts = f"(SELECT quantile_cont(x, 0.01) xl, quantile_cont(x, 0.99) xh, quantile_cont(y, 0.01) yl, quantile_cont(y, 0.99) yh FROM {pairs})"
    return f"(SELECT coalesce(corr(least(greatest(x, xl), xh), least(greatest(y, yl), yh)), 0) FROM {pairs}, {cuts})"


def eta_sql(source: str, category: str, value: str) -> str:
    rows = f"(SELECT {category} AS g, {value} AS v FROM {source} WHERE {category} IS NOT NULL AND {value} IS NOT NULL)"
    groups = f"(SELECT g, count(*) AS n, avg(v) AS m FROM {rows} GROUP BY g)"
    whole = f"(SELECT avg(v) AS mu, var_pop(v) * count(*) AS total FROM {rows})"
    return f"(SELECT sum(n * (m - mu) * (m - mu)) / any_value(total) FROM {groups}, {whole})"


def cramers_sql(source: str, x: str, y: str) -> str:
    rows = f"(SELECT {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    cells = (
        f"(SELECT x, y, CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER (PARTITION BY x) AS DOUBLE) AS rn, "
        f"CAST(sum(count(*)) OVER (PARTITION BY y) AS DOUBLE) AS cn FROM {rows} GROUP BY x, y)"
    )
    facts = f"(SELECT sum(n * n / (rn * cn)) - 1 AS phi, sum(n) AS size, count(DISTINCT x) AS r, count(DISTINCT y) AS k FROM {cells})"
    return (
        "(SELECT sqrt(greatest(0, phi - (k - 1) * (r - 1) / (size - 1)) / "
        f"least(k - (k - 1) * (k - 1) / (size - 1) - 1, r - (r - 1) * (r - 1) / (size - 1) - 1)) FROM {facts})"
    )


def trend_sql(source: str, time: str, value: str) -> str:
    days = f"(SELECT CAST({time} AS DATE) AS d, avg({value}) AS v FROM {source} WHERE {time} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1)"
    return spearman_sql(days, "d", "v")


@query(
    "rel_spearman",
    f"SELECT round({spearman_sql('(SELECT l_extendedprice AS x, nullif(l_quantity, 7) AS y FROM lineitem)', 'x', 'y')}, 6) AS score, "
    "(SELECT count(*) FROM lineitem WHERE l_quantity <> 7) AS sample_size",
)
def rel_spearman(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("quantity", F.nullif("l_quantity", F.lit(7.0)))
    return rounded(rel.spearman(rows, "l_extendedprice", "quantity").select("score", "sample_size"), 6, "score")


@query(
    "rel_winsor_pearson",
    f"SELECT round({pearson_sql('part', 'p_retailprice', 'p_partkey')}, 6) AS score, (SELECT count(*) FROM part) AS sample_size",
)
def rel_winsor_pearson(spark, folder):
    found = rel.winsorized_pearson(table(spark, folder, "part"), "p_retailprice", "p_partkey")
    return rounded(found.select("score", "sample_size"), 6, "score")


TYPED_PARTS = "(SELECT *, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS mixed FROM part)"


@query(
    "rel_cramers_v",
    f"SELECT round({cramers_sql('(SELECT l_returnflag AS x, CASE WHEN l_linenumber > 3 THEN l_returnflag ELSE l_linestatus END AS y FROM lineitem)', 'x', 'y')}, 6) AS score",
)
def rel_cramers_v(spark, folder):
    y = F.when(F.col("l_linenumber") > 3, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))
    rows = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("x"), y.alias("y"))
    return rounded(rel.cramers_v(rows, "x", "y").select("score"), 6, "score")


@query("rel_eta_squared", f"SELECT round({eta_sql('part', 'p_brand', 'p_retailprice')}, 6) AS score")
def rel_eta_squared(spark, folder):
    return rounded(rel.eta_squared(table(spark, folder, "part"), "p_brand", "p_retailprice").select("score"), 6, "score")


@query("rel_daily_trend", f"SELECT round({trend_sql('events', 'ts', 'value')}, 6) AS score")
def rel_daily_trend(spark, folder):
    return rounded(rel.trend(table(spark, folder, "events"), "ts", "value").select("score"), 6, "score")


@query(
    "rel_latest_grain",
    """
    SELECT user_id, event_id, ts, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 50 <> 0 THEN ts END DESC NULLS FIRST, event_id DESC) AS rn,
             CASE WHEN event_id % 50 <> 0 THEN ts END AS seen FROM events) WHERE rn = 1
    """,
)
def rel_latest_grain(spark, folder):
    rows = table(spark, folder, "events").withColumn("seen", F.when(F.col("event_id") % 50 != 0, F.col("ts")))
    return rel.latest_grain(rows, "user_id", "seen", ["event_id"]).select("user_id", "event_id", "ts", "value")


@query(
    "rel_mean_grain",
    """
    SELECT user_id, round(avg(value), 6) AS value, arg_min(nullif(event_type, 'view'), (ts, event_id)) FILTER (event_type <> 'view') AS kind
    FROM events GROUP BY 1
    """,
)
def rel_mean_grain(spark, folder):
    rows = table(spark, folder, "events").withColumn("kind", F.nullif("event_type", F.lit("view")))
    merged = rel.mean_grain(rows.select("user_id", "value", "kind", "ts", "event_id"), "user_id", ["ts", "event_id"])
    return rounded(merged.select("user_id", "value", "kind"), 6, "value")


ORDERS = "(SELECT *, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS buyer FROM orders)"
RANKED = f"""
    WITH s AS (
      SELECT 'o_orderkey' AS "column", 'numeric_numeric' AS relation_type, {spearman_sql(ORDERS, 'o_totalprice', 'o_orderkey')} AS score,
             {pearson_sql(ORDERS, 'o_totalprice', 'o_orderkey')} AS pearson, (SELECT count(*) FROM orders) AS sample_size
      UNION ALL SELECT 'buyer', 'numeric_numeric', {spearman_sql(ORDERS, 'o_totalprice', 'buyer')}, {pearson_sql(ORDERS, 'o_totalprice', 'buyer')},
             (SELECT count(buyer) FROM {ORDERS})
      UNION ALL SELECT 'o_orderstatus', 'categorical_numeric', {eta_sql(ORDERS, 'o_orderstatus', 'o_totalprice')}, NULL, (SELECT count(*) FROM orders)
      UNION ALL SELECT 'o_orderpriority', 'categorical_numeric', {eta_sql(ORDERS, 'o_orderpriority', 'o_totalprice')}, NULL, (SELECT count(*) FROM orders)
      UNION ALL SELECT 'o_orderdate', 'datetime_numeric', {trend_sql(ORDERS, 'o_orderdate', 'o_totalprice')}, NULL, (SELECT count(*) FROM orders)
    )
    SELECT "column", relation_type, round(score, 6) AS score, round(pearson, 6) AS pearson, sample_size,
           CASE WHEN relation_type = 'categorical_numeric' THEN 'none' WHEN score > 0 THEN 'positive' ELSE 'negative' END AS direction,
           round(1 - sample_size / (SELECT count(*) FROM orders), 6) AS null_ratio,
           CASE relation_type WHEN 'numeric_numeric' THEN 'Spearman' WHEN 'categorical_numeric' THEN 'Eta squared' ELSE 'Daily trend Spearman' END AS method,
           CASE relation_type WHEN 'numeric_numeric' THEN 'scatter' WHEN 'categorical_numeric' THEN 'boxplot' ELSE 'line' END AS chart_type,
           CASE WHEN relation_type = 'numeric_numeric' THEN 'o_totalprice' ELSE "column" END AS chart_x,
           CASE WHEN relation_type = 'numeric_numeric' THEN "column" ELSE 'o_totalprice' END AS chart_y,
           CASE WHEN relation_type = 'datetime_numeric' THEN 'mean' END AS chart_aggregate,
           CASE WHEN relation_type = 'datetime_numeric' THEN 'day' END AS chart_time_grain,
           5 AS compared_candidates, false AS sampled
    FROM s
"""


def _orders(spark, folder):
    rows = table(spark, folder, "orders")
    buyer = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("buyer")
    return rows.select("o_orderkey", buyer, "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


RANKED_COLUMNS = ["column", "relation_type", "score", "pearson", "sample_size", "direction", "null_ratio", "method"]
RANKED_COLUMNS += ["chart_type", "chart_x", "chart_y", "chart_aggregate", "chart_time_grain", "compared_candidates", "sampled"]


@query("rel_ranked", RANKED)
def rel_ranked(spark, folder):
    return rel.analyze(_orders(spark, folder), rel.Request("o_totalprice")).select(*RANKED_COLUMNS)


@query("rel_recommend", f"SELECT * FROM ({RANKED}) ORDER BY abs(score) DESC, \"column\" LIMIT 1")
def rel_recommend(spark, folder):
    return rel.recommend(_orders(spark, folder), "o_totalprice").select(*RANKED_COLUMNS)


@query(
    "rel_sampled",
    """
    SELECT unnest(['l_quantity', 'l_discount']) AS "column", count(*) > 5000 AS sampled, least(count(*), 5000) AS sample_size, true AS close FROM lineitem
    """,
)
def rel_sampled(spark, folder):
    """Scores over a sample of 5000 rows lie near those over all rows."""
    rows = table(spark, folder, "lineitem").select("l_extendedprice", "l_quantity", "l_discount")
    names = ["column", "score", "sampled", "sample_size"]
    part = rel.analyze(rows, rel.Request("l_extendedprice", sample_limit=5000)).select(*names)
    whole = rel.analyze(rows, rel.Request("l_extendedprice")).select("column", F.col("score").alias("exact"))
    return part.join(whole, "column").select("column", "sampled", "sample_size", (F.abs(F.col("score") - F.col("exact")) < 0.06).alias("close"))


@query(
    "rel_skipped",
    """
    SELECT * FROM (VALUES ('o_orderkey', 'beyond the candidate limit'), ('buyer', 'too many nulls'), ('constant', 'no variation'),
                          ('clerk', 'too many levels'), ('row_id', 'identifier or free text')) v("column", reason)
    """,
)
def rel_skipped(spark, folder):
    """Why columns take no part: every reason once."""
    sparse = F.when(F.col("o_orderkey") % 8 == 1, F.col("buyer")).alias("buyer")
    clerk = F.concat(F.lit("clerk "), F.col("o_orderkey") % 7).alias("clerk")
    names = ["o_totalprice", "o_orderkey", "o_orderstatus", "o_orderpriority"]
    rows = _orders(spark, folder).select(*names, F.lit(1).alias("constant"), F.col("o_orderkey").alias("row_id"), clerk, sparse)
    return rel.skipped_candidates(rows, rel.Request("o_totalprice", candidate_limit=3, max_levels=6))
