"""Item, champion and rune documents as flat tables, reference prices and efficiency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkbi.functions.columns import require
from sparkbi.functions.text import text_stat

# Document stat names and the column names they get.
STAT_KEYS = {
    "FlatPhysicalDamageMod": "ad",
    "FlatMagicDamageMod": "ap",
    "FlatHPPoolMod": "hp",
    "FlatArmorMod": "armor",
    "FlatSpellBlockMod": "magic_resist",
    "PercentAttackSpeedMod": "attack_speed",
    "FlatCritChanceMod": "crit_chance",
    "FlatMovementSpeedMod": "move_speed",
    "FlatMPPoolMod": "mana",
}

# The basic item that prices one unit of each stat.
REFERENCE_ITEMS = {
    "ad": "Long Sword",
    "ap": "Amplifying Tome",
    "hp": "Ruby Crystal",
    "armor": "Cloth Armor",
    "magic_resist": "Null-Magic Mantle",
    "ability_haste": "Glowing Mote",
    "attack_speed": "Dagger",
    "crit_chance": "Cloak of Agility",
    "move_speed": "Boots",
    "mana": "Sapphire Crystal",
}

MAP_KEY = "11"  # the map whose items are listed


def lists_patches(items: DataFrame) -> bool:
    """Whether an entry names all patches that it holds for, as a list, instead of one."""
    return isinstance(items.schema["patch"].dataType, T.ArrayType)


def for_each_patch(items: DataFrame) -> DataFrame:
    """One row per entry and patch, however the patches are written."""
    return items.withColumn("patch", F.explode("patch")) if lists_patches(items) else items

# The parts of the documents that are read, in their own spelling.
ITEM_SCHEMA = """
    data map<string, struct<
        name: string, description: string, depth: long, tags: array<string>, into: array<string>,
        gold: struct<purchasable: boolean, total: double>,
        maps: map<string, boolean>, stats: map<string, double>>>
"""
CHAMPION_SCHEMA = "data map<string, struct<key: string, id: string, name: string, tags: array<string>, stats: map<string, double>>>"
RUNE_SCHEMA = """
    id long, name string,
    slots array<struct<runes: array<struct<id: long, key: string, name: string, longDesc: string, shortDesc: string>>>>
"""


def item_catalog(documents: DataFrame) -> DataFrame:
    """Purchasable items of ``patch, data`` documents, one row per patch and item."""
    rows = documents.select("patch", F.explode("data").alias("id", "item"))
    item = F.col("item")
    sold = item["gold"]["purchasable"] & F.coalesce(F.try_element_at(item["maps"], F.lit(MAP_KEY)), F.lit(False))
    description = F.coalesce(item["description"], F.lit(""))
    depth = F.coalesce(item["depth"], F.lit(0))
    stats = [F.coalesce(F.try_element_at(item["stats"], F.lit(key)), F.lit(0.0)).alias(name) for key, name in STAT_KEYS.items()]
    return rows.where(sold).select(
        "patch",
        F.col("id").cast("long").alias("item_id"),
        F.coalesce(item["name"], F.col("id")).alias("item_name"),
        F.coalesce(item["gold"]["total"], F.lit(0.0)).alias("total_gold"),
        description.alias("description"),
        F.coalesce(F.array_join(item["tags"], ","), F.lit("")).alias("tags"),
        F.when(depth == 0, 1).otherwise(depth).cast("int").alias("item_tier"),
        (F.coalesce(F.size(item["into"]), F.lit(0)) <= 0).alias("is_final_item"),
        *stats,
        text_stat(description, "Ability Haste").alias("ability_haste"),
    )


def champion_catalog(documents: DataFrame, stats: Sequence[str] | None = None) -> DataFrame:
    """One row per champion with every stat as ``base_<name>``.

    Stat names are read from the documents when not given.
    """
    rows = documents.select("patch", F.explode("data").alias("_", "c"))
    if stats is None:
        names = rows.select(F.explode(F.map_keys("c.stats")).alias("name")).distinct()
        stats = sorted(row["name"] for row in names.collect())
    c = F.col("c")
    return rows.select(
        "patch",
        c["key"].cast("long").alias("champion_id"),
        c["id"].alias("champion_key"),
        c["name"].alias("champion_name"),
        F.coalesce(F.array_join(c["tags"], ","), F.lit("")).alias("tags"),
        *[F.try_element_at(c["stats"], F.lit(name)).alias(f"base_{name}") for name in stats],
    )


def rune_catalog(trees: DataFrame) -> DataFrame:
    """One row per rune of ``patch, id, name, slots`` rows."""
    slots = trees.select("patch", F.col("id").alias("tree_id"), F.col("name").alias("tree_name"), F.posexplode("slots").alias("slot", "s"))
    rows = slots.select("patch", "tree_id", "tree_name", "slot", F.explode("s.runes").alias("rune"))
    rune = F.col("rune")
    return rows.select(
        "patch",
        "tree_id",
        "tree_name",
        "slot",
        rune["id"].alias("rune_id"),
        rune["key"].alias("rune_key"),
        rune["name"].alias("rune_name"),
        F.coalesce(F.nullif(rune["longDesc"], F.lit("")), rune["shortDesc"]).alias("description"),
    )


def reference_prices(
    items: DataFrame,
    pairs: dict[str, str] = REFERENCE_ITEMS,
    by: Sequence[str] = (),
    name: str = "item_name",
    gold: str = "total_gold",
    item_id: str = "item_id",
) -> DataFrame:
    """Gold per unit of each stat, taken from its basic item: ``stat, reference_gold_per_unit``.

    The first item of that name by id counts; it is skipped when it lacks the stat.
    """
    known = {stat: item for stat, item in pairs.items() if stat in items.columns}
    require(items, [*by, name, gold, item_id])
    cells = [
        F.struct(F.lit(stat).alias("stat"), F.lit(item).alias("wanted"), F.col(stat).cast("double").alias("amount"))
        for stat, item in known.items()
    ]
    rows = items.select(*by, F.col(name).alias("_name"), F.col(gold).alias("_gold"), F.col(item_id).alias("_id"), F.inline(F.array(*cells)))
    first = rows.where(F.col("_name") == F.col("wanted")).groupBy(*by, "stat").agg(
        F.min_by(F.struct("_gold", "amount"), F.struct("_id", "_gold", "amount")).alias("basic")
    )
    return first.where(F.col("basic.amount") > 0).select(
        *by, "stat", (F.col("basic._gold") / F.col("basic.amount")).alias("reference_gold_per_unit")
    )


def efficiency(
    items: DataFrame, prices: DataFrame, stats: Sequence[str] = tuple(REFERENCE_ITEMS), by: Sequence[str] = (), gold: str = "total_gold"
) -> DataFrame:
    """Value of an item's stats at reference prices, as gold, percent and remainder."""
    known = [stat for stat in stats if stat in items.columns]
    # One price per stat name: a row with as many columns as there are stats.
    wide = prices.groupBy(*by).agg(
        *[
            F.coalesce(F.max(F.when(F.col("stat") == stat, F.col("reference_gold_per_unit"))), F.lit(0.0)).alias(f"_price_{stat}")
            for stat in known
        ]
    )
    if by:
        priced = items.join(wide, list(by), "left")
    else:
        row = F.struct(*[F.col(f"_price_{stat}") for stat in known])
        priced = items.withColumn("_prices", wide.select(row.alias("p")).scalar()).select("*", "_prices.*").drop("_prices")
    value: Column = F.lit(0.0)
    for stat in known:
        value = value + F.coalesce(F.col(stat), F.lit(0)) * F.coalesce(F.col(f"_price_{stat}"), F.lit(0.0))
    total = F.col(gold)
    return (
        priced.withColumn("estimated_stat_value", value)
        .withColumn("gold_efficiency_percent", F.when(total > 0, F.col("estimated_stat_value") / total * 100))
        .withColumn("passive_shadow_price", total - F.col("estimated_stat_value"))
        .drop(*[f"_price_{stat}" for stat in known])
    )
