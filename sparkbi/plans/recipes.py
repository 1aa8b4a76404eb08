"""Recipe steps on the sample tables, with nulls injected where the tables have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkbi.operators.recipe import Step, build_recipe
from sparkbi.plans.bi import rounded
from sparkbi.plans.registry import query, table


def _parts(spark, folder):
    """``part`` with the sizes divisible by seven missing."""
    rows = table(spark, folder, "part")
    return rows.withColumn("p_size", F.when(F.col("p_size") % 7 != 0, F.col("p_size")))


PARTS = "(SELECT * REPLACE (CASE WHEN p_size % 7 <> 0 THEN p_size END AS p_size) FROM part)"


@query(
    "recipe_select_rename",
    "SELECT o_totalprice AS price, o_orderkey AS order_number FROM orders",
)
def recipe_select_rename(spark, folder):
    steps = [
        Step("select", {"columns": ["o_totalprice", "o_orderkey"]}),
        Step("rename", {"mapping": {"o_totalprice": "price", "o_orderkey": "order_number"}}),
    ]
    return build_recipe(table(spark, folder, "orders"), steps)


@query(
    "recipe_cast",
    """
    SELECT event_id, TRY_CAST(CASE WHEN user_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS amount,
           CASE WHEN user_id % 7 <> 0 THEN ts END AS moment, CAST(user_id AS VARCHAR) AS member
    FROM events
    """,
)
def recipe_cast(spark, folder):
    text_time = F.when(F.col("user_id") % 7 != 0, F.col("ts").cast("string")).otherwise("soon")
    rows = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("user_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("amount"),
        text_time.alias("moment"),
        F.col("user_id").alias("member"),
    )
    steps = [
        Step("cast", {"column": "amount", "dtype": "number"}),
        Step("cast", {"column": "moment", "dtype": "datetime"}),
        Step("cast", {"column": "member", "dtype": "string"}),
    ]
    return build_recipe(rows, steps).withColumn("moment", F.col("moment").cast("timestamp_ntz"))


def _fill(method: str, value=None):
    def build(spark, folder):
        config = {"column": "p_size", "method": method} | ({"value": value} if value is not None else {})
        filled = build_recipe(_parts(spark, folder), [Step("fill_missing", config)])
        return filled.select("p_partkey", F.round(F.col("p_size").cast("double"), 6).alias("p_size"))

    return build


def _fill_sql(stand_in: str) -> str:
    return f"SELECT p_partkey, round(CAST(coalesce(p_size, {stand_in}) AS DOUBLE), 6) AS p_size FROM {PARTS}"


query("recipe_fill_mean", _fill_sql(f"(SELECT avg(p_size) FROM {PARTS})"))(_fill("mean"))
query("recipe_fill_median", _fill_sql(f"(SELECT quantile_cont(p_size, 0.5) FROM {PARTS})"))(_fill("median"))
query(
    "recipe_fill_mode",
    _fill_sql(f"(SELECT p_size FROM {PARTS} WHERE p_size IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
)(_fill("mode"))
query("recipe_fill_value", _fill_sql("-1"))(_fill("value", -1))


@query(
    "recipe_drop_missing",
    f"""
    SELECT 'subset' AS kind, count(*) AS rows FROM {PARTS} WHERE p_size IS NOT NULL UNION ALL
    SELECT 'all columns', count(*) FROM {PARTS} WHERE p_size IS NOT NULL AND nullif(p_brand, 'Brand#1') IS NOT NULL
    """,
)
def recipe_drop_missing(spark, folder):
    rows = _parts(spark, folder).withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#1")))
    subset = build_recipe(rows, [Step("drop_missing", {"columns": ["p_size"]})])
    whole = build_recipe(rows, [Step("drop_missing", {})])
    count = F.count(F.lit(1)).alias("rows")
    return subset.agg(count).select(F.lit("subset").alias("kind"), "rows").unionByName(
        whole.agg(count).select(F.lit("all columns").alias("kind"), "rows")
    )


LINE_COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
OTHERS = "l_partkey, l_suppkey, l_extendedprice"


def _lines(spark, folder):
    names = LINE_COLUMNS.split(", ")
    return table(spark, folder, "lineitem").select(*names)


def _dedup(keep):
    def build(spark, folder):
        steps = [Step("drop_duplicates", {"columns": ["l_orderkey", "l_linenumber"], "keep": keep})]
        return build_recipe(_lines(spark, folder), steps, ["l_shipdate"])

    return build


def _dedup_sql(direction: str) -> str:
    order = ", ".join(f"{name} {direction}" for name in ("l_shipdate", *OTHERS.split(", ")))
    return f"""
    SELECT {LINE_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS rn FROM lineitem)
    WHERE rn = 1
    """


query("recipe_dedup_first", _dedup_sql("ASC"))(_dedup("first"))
query("recipe_dedup_last", _dedup_sql("DESC"))(_dedup("last"))
query(
    "recipe_dedup_none",
    f"SELECT {LINE_COLUMNS} FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1",
)(_dedup("none"))


@query("recipe_dedup_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def recipe_dedup_rows(spark, folder):
    steps = [Step("select", {"columns": ["l_returnflag", "l_linestatus", "l_tax"]}), Step("drop_duplicates", {})]
    return build_recipe(table(spark, folder, "lineitem"), steps)


@query(
    "recipe_filter_cmp",
    f"""
    SELECT p_partkey, p_size, p_retailprice FROM {PARTS}
    WHERE p_size >= 10 AND p_size < 40 AND p_retailprice > 905.5 AND p_retailprice <= 999 AND (p_size <> 20 OR p_size IS NULL) AND p_type = 'PROMO'
    """,
)
def recipe_filter_cmp(spark, folder):
    tests = [
        ("p_size", "gte", 10),
        ("p_size", "lt", 40),
        ("p_retailprice", "gt", 905.5),
        ("p_retailprice", "lte", 999),
        ("p_size", "ne", 20),
        ("p_type", "eq", "PROMO"),
    ]
    steps = [Step("filter", {"column": c, "operator": o, "value": v}) for c, o, v in tests]
    return build_recipe(_parts(spark, folder), [*steps, Step("select", {"columns": ["p_partkey", "p_size", "p_retailprice"]})])


@query("recipe_filter_ne_null", f"SELECT p_partkey, p_size FROM {PARTS} WHERE p_size <> 8 OR p_size IS NULL")
def recipe_filter_ne_null(spark, folder):
    steps = [Step("filter", {"column": "p_size", "operator": "ne", "value": 8}), Step("select", {"columns": ["p_partkey", "p_size"]})]
    return build_recipe(_parts(spark, folder), steps)


@query(
    "recipe_filter_contains",
    "SELECT doc_id, n_chars FROM documents WHERE contains(text, '. The') OR contains(text, 'a.b')",
)
def recipe_filter_contains(spark, folder):
    rows = table(spark, folder, "documents")
    found = build_recipe(rows, [Step("filter", {"column": "text", "operator": "contains", "value": ". The"})])
    dotted = build_recipe(rows, [Step("filter", {"column": "text", "operator": "contains", "value": "a.b"})])
    return found.union(dotted).select("doc_id", "n_chars").dropDuplicates()


@query("recipe_filter_in", f"SELECT p_partkey, p_size FROM {PARTS} WHERE p_size IN (1, 2, 3, 50) OR p_size IS NULL")
def recipe_filter_in(spark, folder):
    steps = [Step("filter", {"column": "p_size", "operator": "in", "value": [1, 2, 3, 50, None]}), Step("select", {"columns": ["p_partkey", "p_size"]})]
    return build_recipe(_parts(spark, folder), steps)


@query(
    "recipe_calculate",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(l_tax, 0), 4) AS per_tax, round(l_extendedprice * l_discount, 4) AS given,
           l_quantity + 1 AS more, l_quantity - l_linenumber AS less, l_returnflag || l_linestatus AS flags
    FROM lineitem
    """,
)
def recipe_calculate(spark, folder):
    made = [
        ("l_extendedprice", "divide", "l_tax", "per_tax"),
        ("l_extendedprice", "multiply", "l_discount", "given"),
        ("l_quantity", "add", 1, "more"),
        ("l_quantity", "subtract", "l_linenumber", "less"),
        ("l_returnflag", "add", "l_linestatus", "flags"),
    ]
    steps = [Step("calculate", {"left": a, "operator": o, "right": b, "target": t}) for a, o, b, t in made]
    names = ["l_orderkey", "l_linenumber", "l_partkey", *[t for *_, t in made]]
    return rounded(build_recipe(table(spark, folder, "lineitem"), [*steps, Step("select", {"columns": names})]), 4, "per_tax", "given")


@query(
    "recipe_aggregate",
    """
    SELECT nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal, count(nullif(c_nationkey, 3)) AS c_nationkey,
           count(DISTINCT c_name) AS c_name, round(median(c_custkey), 4) AS c_custkey
    FROM customer GROUP BY 1
    """,
)
def recipe_aggregate(spark, folder):
    rows = table(spark, folder, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    rows = rows.withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3)))
    metrics = {"c_acctbal": "sum", "c_nationkey": "count", "c_name": "nunique", "c_custkey": "median"}
    return rounded(build_recipe(rows, [Step("aggregate", {"group_by": ["c_mktsegment"], "metrics": metrics})]), 2, "c_acctbal")


@query(
    "recipe_aggregate_spread",
    """
    SELECT p_brand, p_type, round(stddev_samp(p_retailprice), 6) AS p_retailprice, round(var_samp(p_size), 6) AS p_size,
           arg_min(p_name, p_partkey) AS p_name, bool_and(p_size > 1) AS big, max(p_partkey) AS p_partkey
    FROM part GROUP BY 1, 2
    """,
)
def recipe_aggregate_spread(spark, folder):
    rows = table(spark, folder, "part").withColumn("big", F.col("p_size") > 1)
    metrics = {"p_retailprice": "std", "p_size": "var", "p_name": "first", "big": "all", "p_partkey": "max"}
    step = Step("aggregate", {"group_by": ["p_brand", "p_type"], "metrics": metrics})
    return rounded(build_recipe(rows, [step], ["p_partkey"]), 6, "p_retailprice", "p_size")


@query(
    "recipe_pivot",
    """
    SELECT nullif(user_id, 4) AS user_id, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS click,
           round(coalesce(sum(value) FILTER (event_type = 'error'), 0), 4) AS error,
           round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS purchase,
           round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 4) AS view
    FROM events WHERE user_id <> 4 AND event_type <> 'signup' GROUP BY 1
    """,
)
def recipe_pivot(spark, folder):
    rows = table(spark, folder, "events").withColumn("user_id", F.nullif("user_id", F.lit(4)))
    rows = rows.withColumn("event_type", F.nullif("event_type", F.lit("signup")))
    wide = build_recipe(rows, [Step("pivot", {"index": "user_id", "columns": "event_type", "values": "value"})])
    return rounded(wide, 4, "click", "error", "purchase", "view")


CUSTOMERS = "(SELECT nullif(c_custkey % 100, 7) AS k, min(c_name) AS c_name, count(*) AS o_orderstatus FROM customer GROUP BY 1)"


def _join(how: str, **more):
    def build(spark, folder):
        orders = table(spark, folder, "orders").select(
            "o_orderkey", F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey") % 200).alias("k"), "o_orderstatus"
        )
        right = table(spark, folder, "customer").groupBy(F.nullif(F.col("c_custkey") % 100, F.lit(7)).alias("k"))
        right = right.agg(F.min("c_name").alias("c_name"), F.count(F.lit(1)).alias("o_orderstatus"))
        config = {"right_dataset_id": "customers", "left_on": ["k"], "how": how, "validate": "many_to_one", **more}
        return build_recipe(orders, [Step("join", config)], lookup={"customers": right}.__getitem__)

    return build


def _join_sql(kind: str) -> str:
    return f"""
    SELECT o_orderkey, o.k, o.o_orderstatus, c_name, c.o_orderstatus AS o_orderstatus_right
    FROM (SELECT *, CASE WHEN o_custkey % 11 <> 0 THEN o_custkey % 200 END AS k FROM orders) o
    {kind} JOIN {CUSTOMERS} c ON o.k IS NOT DISTINCT FROM c.k
    """


query("recipe_join_left_nullkeys", _join_sql("LEFT"))(_join("left"))
query("recipe_join_inner_nullkeys", _join_sql("INNER"))(_join("inner"))
query("recipe_join_split", _join_sql("LEFT"))(_join("left", split_heavy=True))


@query(
    "recipe_chain",
    f"""
    SELECT p_type, round(sum(p_retailprice * coalesce(p_size, (SELECT quantile_cont(p_size, 0.5) FROM {PARTS}))), 2) AS worth, count(*) AS p_partkey
    FROM {PARTS} WHERE contains(p_name, 'ring') GROUP BY 1
    """,
)
def recipe_chain(spark, folder):
    steps = [
        Step("fill_missing", {"column": "p_size", "method": "median"}),
        Step("filter", {"column": "p_name", "operator": "contains", "value": "ring"}),
        Step("calculate", {"left": "p_retailprice", "operator": "multiply", "right": "p_size", "target": "worth"}),
        Step("aggregate", {"group_by": ["p_type"], "metrics": {"worth": "sum", "p_partkey": "count"}}),
    ]
    return rounded(build_recipe(_parts(spark, folder), steps), 2, "worth")
