"""Structured queries, charts, metrics, dashboards and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sparkbi.operators import charts
from sparkbi.operators.metrics import Metric, Widget, dashboard, metric, metrics
from sparkbi.operators.profile import profile, semantic_types
from sparkbi.operators.query import Filter, Query, query as run
from sparkbi.plans.registry import query, table


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


@query(
    "group_sum_filtered",
    """
    SELECT l_returnflag AS category, round(sum(l_extendedprice), 2) AS value
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 5
    GROUP BY 1 ORDER BY 2 DESC LIMIT 100
    """,
)
def group_sum_filtered(spark, folder):
    filters = (Filter("l_shipdate", "gte", "1998-01-01"), Filter("l_quantity", "gt", 5))
    request = Query("l_returnflag", measure="l_extendedprice", filters=filters)
    return rounded(run(table(spark, folder, "lineitem"), request), 2, "value")


@query(
    "group_mean_series",
    """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS category, l_linestatus AS series, round(avg(l_quantity), 6) AS value
    FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 100
    """,
)
def group_mean_series(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    return rounded(run(rows, Query("ship_year", "l_linestatus", "l_quantity", "mean")), 6, "value")


@query(
    "kpi_scalars",
    """
    WITH d AS (SELECT nullif(l_discount, 0.05) AS x FROM lineitem)
    SELECT 'sum' AS kpi, round(sum(x), 4) AS value FROM d UNION ALL
    SELECT 'mean', round(avg(x), 6) FROM d UNION ALL SELECT 'count', CAST(count(x) AS DOUBLE) FROM d UNION ALL
    SELECT 'min', min(x) FROM d UNION ALL SELECT 'max', max(x) FROM d UNION ALL
    SELECT 'sum of nothing', 0.0
    """,
)
def kpi_scalars(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("x", F.nullif("l_discount", F.lit(0.05)))
    digits = {"sum": 4, "mean": 6, "count": 0, "min": 6, "max": 6}
    parts = [
        run(rows, Query(measure="x", aggregation=name)).select(F.lit(name).alias("kpi"), F.round(F.col("value").cast("double"), places).alias("value"))
        for name, places in digits.items()
    ]
    nothing = run(rows, Query(measure="x", filters=(Filter("l_quantity", "lt", 0),)))
    return reduce(DataFrame.unionByName, [*parts, nothing.select(F.lit("sum of nothing").alias("kpi"), F.col("value").cast("double").alias("value"))])


@query(
    "topn_by_value",
    "SELECT c_name AS category, c_acctbal AS value FROM customer ORDER BY 2 DESC, 1 LIMIT 10",
)
def topn_by_value(spark, folder):
    return run(table(spark, folder, "customer"), Query("c_name", measure="c_acctbal", aggregation="max", limit=10))


@query(
    "count_rows_vs_nonnull",
    """
    SELECT 'rows' AS counted, o_orderpriority AS category, count(*) AS value FROM orders GROUP BY 2 UNION ALL
    SELECT 'present', o_orderpriority, count(nullif(o_orderstatus, 'F')) FROM orders GROUP BY 2
    """,
)
def count_rows_vs_nonnull(spark, folder):
    rows = table(spark, folder, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("F")))
    whole = run(rows, Query("o_orderpriority", aggregation="count")).select(F.lit("rows").alias("counted"), "category", "value")
    present = run(rows, Query("o_orderpriority", measure="status", aggregation="count"))
    return whole.unionByName(present.select(F.lit("present").alias("counted"), "category", "value"))


@query(
    "filter_in_ne_null",
    """
    WITH e AS (SELECT *, nullif(event_type, 'click') AS kind FROM events)
    SELECT kind AS category, count(*) AS value FROM e
    WHERE (kind <> 'error' OR kind IS NULL) AND (user_id IN (1, 2, 3, 5, 8, 13) OR user_id > 20)
      AND user_id <= 120 AND value >= 1.5
    GROUP BY 1 ORDER BY 2 DESC LIMIT 100
    """,
)
def filter_in_ne_null(spark, folder):
    rows = table(spark, folder, "events").withColumn("kind", F.nullif("event_type", F.lit("click")))
    rows = rows.withColumn("cohort", F.when(F.col("user_id") > 20, "late").otherwise(F.col("user_id").cast("string")))
    filters = (
        Filter("kind", "ne", "error"),
        Filter("cohort", "in", ["late", "1", "2", "3", "5", "8", "13"]),
        Filter("user_id", "lte", 120),
        Filter("value", "gte", 1.5),
    )
    return run(rows, Query("kind", aggregation="count", filters=filters))


HISTOGRAM_SQL = """
    WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders),
    b AS (SELECT CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / 20) AS lower,
                 CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 20) END AS upper, n
          FROM s, range(20) t(i))
    SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper,
           printf('%.3g', lower) || '–' || printf('%.3g', upper) AS label,
           count(o_totalprice) AS count, n AS sample_size
    FROM b LEFT JOIN orders ON o_totalprice >= lower AND (o_totalprice < upper OR (bin = 19 AND o_totalprice <= upper))
    GROUP BY ALL
"""


@query("hist_price", HISTOGRAM_SQL)
def hist_price(spark, folder):
    return rounded(charts.histogram(table(spark, folder, "orders"), "o_totalprice", 20), 6, "lower", "upper")


@query(
    "box_quantity_by_mode",
    """
    SELECT l_returnflag AS category, min(l_extendedprice) AS minimum,
           round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
           round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, max(l_extendedprice) AS maximum,
           count(*) AS rows, (SELECT count(*) FROM lineitem) AS sample_size
    FROM lineitem GROUP BY 1
    """,
)
def box_quantity_by_mode(spark, folder):
    return rounded(charts.boxplot(table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice"), 6, *charts.BOX)


@query(
    "box_top_groups",
    """
    WITH t AS (SELECT l_suppkey, count(*) AS rows FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30)
    SELECT CAST(l_suppkey AS VARCHAR) AS category, min(l_quantity) AS minimum, quantile_cont(l_quantity, 0.25) AS q1,
           quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS maximum,
           any_value(rows) AS rows, (SELECT CAST(sum(rows) AS BIGINT) FROM t) AS sample_size
    FROM lineitem JOIN t USING (l_suppkey) GROUP BY 1
    """,
)
def box_top_groups(spark, folder):
    return charts.boxplot(table(spark, folder, "lineitem"), "l_suppkey", "l_quantity")


@query(
    "heat_priority_status",
    """
    WITH p AS (SELECT o_orderpriority AS x, nullif(o_orderstatus, 'P') AS y, o_custkey FROM orders),
    g AS (SELECT DISTINCT a.x, b.y FROM (SELECT DISTINCT x FROM p WHERE y IS NOT NULL) a, (SELECT DISTINCT y FROM p WHERE y IS NOT NULL) b)
    SELECT x, y, count(o_custkey) AS count, (SELECT count(*) FROM p WHERE y IS NOT NULL) AS sample_size
    FROM g LEFT JOIN p USING (x, y) GROUP BY x, y
    """,
)
def heat_priority_status(spark, folder):
    rows = table(spark, folder, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return charts.heatmap(rows, "o_orderpriority", "status")


@query(
    "heat_top_grid",
    """
    WITH p AS (SELECT CAST(user_id AS VARCHAR) AS x, CAST(CAST(ts AS DATE) AS VARCHAR) AS y FROM events),
    tx AS (SELECT x FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 30),
    ty AS (SELECT y FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 30),
    c AS (SELECT x, y, count(*) AS n FROM p GROUP BY 1, 2)
    SELECT x, y, coalesce(n, 0) AS count, (SELECT count(*) FROM p) AS sample_size FROM tx CROSS JOIN ty LEFT JOIN c USING (x, y)
    """,
)
def heat_top_grid(spark, folder):
    return charts.heatmap(table(spark, folder, "events").withColumn("day", F.to_date("ts")), "user_id", "day")


@query("scatter_sample")
def scatter_sample(spark, folder):
    return charts.scatter(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", 2000)


@query(
    "scatter_share",
    """
    SELECT CAST(l_linenumber AS DOUBLE) AS y, true AS within, least((SELECT count(*) FROM lineitem), 2000) AS sample_size FROM lineitem GROUP BY 1
    """,
)
def scatter_share(spark, folder):
    """Each heavy value's share of the sample lies within five standard errors of its share of the rows."""
    rows = table(spark, folder, "lineitem")
    points = charts.scatter(rows, "l_quantity", "l_linenumber", 2000)
    drawn = points.groupBy("y").agg(F.count(F.lit(1)).alias("drawn"), F.max("sample_size").alias("sample_size"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    whole = rows.groupBy(F.col("l_linenumber").cast("double").alias("y")).agg((F.count(F.lit(1)) / F.max(F.lit(1.0))).alias("n")).withColumn("share", F.col("n") / total)
    error = F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("sample_size"))
    return drawn.join(whole, "y").select("y", (F.abs(F.col("drawn") / F.col("sample_size") - F.col("share")) <= 5 * error).alias("within"), "sample_size")


@query(
    "scatter_size",
    """
    SELECT least(count(*), 500) AS points, least(count(*), 500) AS sample_size, CAST(0 AS BIGINT) AS strangers FROM part
    """,
)
def scatter_size(spark, folder):
    """The sample has the exact size and holds only points of the table."""
    rows = table(spark, folder, "part")
    points = charts.scatter(rows, "p_partkey", "p_retailprice", 500)
    real = rows.select(F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(1).alias("known"))
    return points.join(real, ["x", "y"], "left").agg(
        F.count(F.lit(1)).alias("points"), F.max("sample_size").alias("sample_size"), F.count_if(F.col("known").isNull()).alias("strangers")
    )


@query(
    "metrics_all",
    """
    SELECT 'revenue' AS name, 'KRW' AS unit, round(sum(l_extendedprice), 2) AS value FROM lineitem UNION ALL
    SELECT 'average quantity', NULL, round(avg(l_quantity), 6) FROM lineitem UNION ALL
    SELECT 'lines', NULL, CAST(count(*) AS DOUBLE) FROM lineitem UNION ALL
    SELECT 'taxed lines', NULL, CAST(count(nullif(l_tax, 0)) AS DOUBLE) FROM lineitem UNION ALL
    SELECT 'cheapest', NULL, min(l_extendedprice) FROM lineitem UNION ALL
    SELECT 'dearest', NULL, max(l_extendedprice) FROM lineitem UNION ALL
    SELECT 'tax per discount', NULL, round(sum(nullif(l_tax, 0)) / sum(l_discount), 6) FROM lineitem
    """,
)
def metrics_all(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("tax", F.nullif("l_tax", F.lit(0.0)))
    found = metrics(
        rows,
        [
            Metric("revenue", "sum", "l_extendedprice", unit="KRW"),
            Metric("average quantity", "mean", "l_quantity"),
            Metric("lines", "count"),
            Metric("taxed lines", "count", "tax"),
            Metric("cheapest", "min", "l_extendedprice"),
            Metric("dearest", "max", "l_extendedprice"),
            Metric("tax per discount", "ratio", numerator="tax", denominator="l_discount"),
        ],
    )
    places = F.when(F.col("name") == "revenue", F.round("value", 2)).otherwise(F.round("value", 6))
    return found.withColumn("value", places)


@query(
    "metric_ratio",
    """
    SELECT 'priced' AS kind, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) AS value FROM lineitem
    UNION ALL SELECT 'empty denominator', NULL
    """,
)
def metric_ratio(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("given", F.col("l_discount") * F.col("l_extendedprice")).withColumn("zero", F.col("l_tax") * 0)
    priced = metric(rows, Metric("discount rate", "ratio", numerator="given", denominator="l_extendedprice"))
    empty = metric(rows, Metric("undefined", "ratio", numerator="l_tax", denominator="zero"))
    return priced.select(F.lit("priced").alias("kind"), F.round("value", 6).alias("value")).unionByName(
        empty.select(F.lit("empty denominator").alias("kind"), "value")
    )


@query(
    "dashboard_long",
    f"""
    WITH orders AS (SELECT * FROM orders WHERE o_orderpriority = '5-LOW'), h AS ({HISTOGRAM_SQL})
    SELECT 'total' AS widget_id, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS series, round(sum(o_totalprice), 4) AS value FROM orders UNION ALL
    SELECT 'orders', NULL, NULL, CAST(count(*) AS DOUBLE) FROM orders UNION ALL
    SELECT 'by status', o_orderstatus, NULL, round(sum(o_totalprice), 4) FROM orders GROUP BY 2 UNION ALL
    SELECT 'status size', o_orderstatus, NULL, CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2 UNION ALL
    SELECT 'by year', CAST(year(o_orderdate) AS VARCHAR), o_orderstatus, round(avg(o_totalprice), 4) FROM orders GROUP BY 2, 3 UNION ALL
    SELECT 'prices', label, NULL, CAST(count AS DOUBLE) FROM h UNION ALL
    SELECT 'grid', o_orderstatus, o_orderpriority, CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2, 3 UNION ALL
    SELECT 'box', o_orderstatus, unnest(['minimum', 'q1', 'median', 'q3', 'maximum']),
           unnest(list_transform(quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1]), lambda q: round(q, 4))) FROM orders GROUP BY 2
    """,
)
def dashboard_long(spark, folder):
    rows = table(spark, folder, "orders").withColumn("order_year", F.year("o_orderdate"))
    widgets = [
        Widget("total", "kpi", "orders", "o_totalprice"),
        Widget("orders", "kpi", "orders", None, "count"),
        Widget("by status", "bar", "orders", "o_totalprice", dimension="o_orderstatus"),
        Widget("status size", "bar", "orders", None, "count", dimension="o_orderstatus"),
        Widget("by year", "line", "orders", "o_totalprice", "mean", dimension="order_year", series="o_orderstatus"),
        Widget("prices", "histogram", "orders", "o_totalprice"),
        Widget("grid", "heatmap", "orders", "o_orderstatus", secondary="o_orderpriority"),
        Widget("box", "boxplot", "orders", "o_totalprice", dimension="o_orderstatus"),
    ]
    return rounded(dashboard({"orders": rows}, widgets, Filter("o_orderpriority", "eq", "5-LOW")), 4, "value")


def _profile_sql(source: str, columns: dict[str, tuple[str, str]]) -> str:
    """The profile of ``source`` spelled out; ``columns`` maps names to (dtype, semantic type)."""
    parts = []
    for position, (name, (dtype, kind)) in enumerate(columns.items()):
        number = f"CAST(min({name}) AS DOUBLE), CAST(max({name}) AS DOUBLE), round(avg({name}), 4)"
        times = f"CAST(min({name}) AS VARCHAR), CAST(max({name}) AS VARCHAR)"
        parts.append(
            f"SELECT {position} AS position, '{name}' AS name, '{dtype}' AS dtype, '{kind}' AS semantic_type, count(*) AS row_count, "
            f"count(*) - count({name}) AS null_count, round((count(*) - count({name})) / count(*), 6) AS null_ratio, "
            f"count(DISTINCT {name}) AS unique_count, {number if kind == 'numeric' else 'NULL, NULL, NULL'}, "
            f"{times if kind == 'datetime' else 'NULL, NULL'} FROM {source}"
        )
    names = "position, name, dtype, semantic_type, row_count, null_count, null_ratio, unique_count, minimum, maximum, mean, earliest, latest"
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) t({names})"


ORDERS_WITH_NULLS = """
    (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'F') AS o_orderstatus,
            CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders)
"""


@query(
    "profile_orders",
    _profile_sql(
        ORDERS_WITH_NULLS,
        {
            "o_orderkey": ("bigint", "numeric"),
            "o_custkey": ("bigint", "numeric"),
            "o_orderstatus": ("string", "categorical"),
            "o_totalprice": ("double", "numeric"),
            "o_orderdate": ("timestamp_ntz", "datetime"),
            "o_orderpriority": ("string", "categorical"),
        },
    ),
)
def profile_orders(spark, folder):
    rows = table(spark, folder, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F")))
    rows = rows.withColumn("o_totalprice", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")))
    return rounded(profile(rows).drop("sample_values"), 4, "mean")


def _semantic_sql(dataset: str, source: str, columns: dict[str, str]) -> str:
    """The type rules spelled out per column; ``columns`` maps names to number, time or text."""
    parts = []
    for name, kind in columns.items():
        named = "true" if name == "id" or name.endswith("_id") else "false"
        hinted = f"count(DISTINCT {name}) / greatest(count({name}), 1) > 0.98" if "id" in name else "false"
        dated = kind == "text" and any(word in name for word in ("date", "time"))
        parsed = f"avg(CASE WHEN TRY_CAST({name} AS TIMESTAMP) IS NULL THEN 0 ELSE 1 END) >= 0.9" if dated else "false"
        few = f"count(DISTINCT {name}) <= least(50, greatest(10, floor(0.2 * count({name})))) AND avg(length(CAST({name} AS VARCHAR))) < 80"
        parts.append(
            f"SELECT '{dataset}' AS dataset, '{name}' AS name, CASE WHEN {named} OR {hinted} THEN 'identifier' "
            f"WHEN {'true' if kind == 'time' else parsed} THEN 'datetime' WHEN {'true' if kind == 'number' else 'false'} THEN 'numeric' "
            f"WHEN {few} THEN 'categorical' ELSE 'text' END AS semantic_type FROM {source}"
        )
    return " UNION ALL ".join(parts)


TYPED = {
    "documents": {"doc_id": "number", "text": "text", "lang": "text", "source": "text", "n_chars": "number"},
    "customer": {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"},
    "events": {"event_id": "number", "ts": "time", "user_id": "number", "event_type": "text", "value": "number", "props": "text", "time_text": "text"},
}


@query(
    "semantic_types_all",
    " UNION ALL ".join(
        _semantic_sql(name, "(SELECT *, CAST(ts AS VARCHAR) AS time_text FROM events)" if name == "events" else name, columns)
        for name, columns in TYPED.items()
    ),
)
def semantic_types_all(spark, folder):
    tables = {name: table(spark, folder, name) for name in TYPED}
    tables["events"] = tables["events"].withColumn("time_text", F.col("ts").cast("string"))
    parts = [semantic_types(rows).select(F.lit(name).alias("dataset"), "name", "semantic_type") for name, rows in tables.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "dashboard_limits",
    """
    SELECT * FROM (SELECT 'bar' AS widget_id, 3 AS points UNION ALL SELECT 'line', least(5, count(DISTINCT year(l_shipdate))) FROM lineitem
                   UNION ALL SELECT 'bins', 7 UNION ALL SELECT 'dots', least(count(*), 150) FROM lineitem
                   UNION ALL SELECT 'grid', 2 * 2 UNION ALL SELECT 'boxes', 2 * 5)
    """,
)
def dashboard_limits(spark, folder):
    """Every widget kind with a limit of its own: how many points each returns."""
    rows = table(spark, folder, "lineitem").withColumn("year", F.year("l_shipdate"))
    widgets = [
        Widget("bar", "bar", "l", "l_quantity", dimension="l_partkey", limit=3),
        Widget("line", "line", "l", "l_quantity", dimension="year", limit=5),
        Widget("bins", "histogram", "l", "l_quantity", bins=7),
        Widget("dots", "scatter", "l", "l_quantity", secondary="l_linenumber", sample_limit=150, seed=3),
        Widget("grid", "heatmap", "l", "l_returnflag", secondary="l_linenumber", top=2),
        Widget("boxes", "boxplot", "l", "l_quantity", dimension="l_returnflag", top=2),
    ]
    return dashboard({"l": rows}, widgets).groupBy("widget_id").agg(F.count(F.lit(1)).alias("points"))
