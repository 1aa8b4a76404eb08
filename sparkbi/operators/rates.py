"""Normalising an externally obtained table of rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Header spellings, source tags, the preferred column order, required headers, numeric columns and rates.
ALIASES = {
    "version": "patch",
    "patch_version": "patch",
    "champion": "champion_name",
    "champ": "champion_name",
    "championid": "champion_id",
    "item": "item_name",
    "itemid": "item_id",
    "games": "sample_games",
    "game_count": "sample_games",
    "samples": "sample_games",
    "pickrate": "pick_rate",
    "winrate": "win_rate",
    "url": "source_url",
}
BENCHMARK_SOURCE = "lol.ps-manual"
USAGE_SCOPE = "external-benchmark-only"
PREFERRED = (
    "patch", "region", "tier", "role", "champion_id", "champion_name",
    "item_id", "item_name", "build_order", "sample_games", "pick_rate",
    "win_rate", "source_url", "collected_at", "benchmark_source", "usage_scope",
)
NAMED = ({"champion_id", "champion_name"}, {"item_id", "item_name", "build_order"}, {"win_rate", "pick_rate", "sample_games"})
NUMBERS = ("champion_id", "item_id", "sample_games", "win_rate", "pick_rate")
RATES = ("win_rate", "pick_rate")


def normalize_rates(df: DataFrame) -> DataFrame:
    """Canonical headers, numeric rates as fractions, checked ranges and source tags.

    All range checks run in one aggregate over the table; a violation raises.
    """
    headers = {name: ALIASES.get(name.strip().lower(), name.strip().lower()) for name in df.columns}
    table = df.withColumnsRenamed(headers)
    for group in NAMED:
        if not group.intersection(table.columns):
            raise ValueError(f"the table needs at least one of: {', '.join(sorted(group))}")
    for name in NUMBERS:
        if name in table.columns:
            value = F.nanvl(F.col(name).try_cast("double"), F.lit(None))
            # a rate above 1 is a percentage
            table = table.withColumn(name, F.when(F.abs(value) > 1, value / 100).otherwise(value) if name in RATES else value)
    checks = {f"{name} must lie within 0-1 or 0-100": (F.col(name) < 0) | (F.col(name) > 1) for name in RATES if name in table.columns}
    if "sample_games" in table.columns:
        checks["sample_games must not be negative"] = F.col("sample_games") < 0
    found = table.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(bad).alias(f"c{index}") for index, bad in enumerate(checks.values())]
    ).first()
    if not found["rows"]:
        raise ValueError("the table has no rows")
    for index, message in enumerate(checks):
        if found[f"c{index}"]:
            raise ValueError(message)
    table = table.withColumn("benchmark_source", F.lit(BENCHMARK_SOURCE)).withColumn("usage_scope", F.lit(USAGE_SCOPE))
    first = [name for name in PREFERRED if name in table.columns]
    return table.select(*first, *[name for name in table.columns if name not in PREFERRED])
