"""From match documents to every mart, for any mix of patches at once."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from sparkbi.operators import marts
from sparkbi.operators.documents import DEFAULT_MINUTES, check_patch, match_item_events, participants, snapshots
from sparkbi.operators.inventory import joined_text
from sparkbi.sources.published import read_current, sync_named

SOURCES = {"participants": "match-documents", "player_states": "timeline-documents", "item_events": "timeline-documents"}
DERIVED = "derived-model"


def flatten_matches(
    matches: DataFrame, timelines: DataFrame, pepper: str, minutes: Sequence[int] = DEFAULT_MINUTES
) -> dict[str, DataFrame]:
    """Participants, player states and item events as flat tables."""
    return {
        "participants": participants(matches, pepper),
        "player_states": snapshots(matches, timelines, minutes),
        "item_events": match_item_events(matches, timelines),
    }


def derive_events(events: DataFrame, items: DataFrame) -> DataFrame:
    return marts.item_event_mart(events, items, by_patch=True)


def derive_context(states: DataFrame, items: DataFrame, catalog_version: str | None = None) -> DataFrame:
    """The context mart of one or many patches; the catalog is joined on patch, without a loop."""
    check_patch(states, items)
    return marts.context_mart(states, items, by_patch=True, catalog_version=catalog_version)


def from_context(context: DataFrame, published: bool = False) -> dict[str, DataFrame]:
    """The marts that are aggregates of the context, which is cheap to read again if it is ``published``."""
    return {
        "observed_win_summary": marts.win_summary(context, published),
        "gold_win_timeseries": marts.bucket_cohorts(context),
        "patch_stat_trend": marts.patch_trend(context),
        "sample_coverage": marts.coverage(context),
    }


def derive_marts(states: DataFrame, events: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """All marts at once, lazily; ``run_workflow`` publishes them without repeating work."""
    context = derive_context(states, items)
    return {"context_mart": context, "item_event_mart": derive_events(events, items), **from_context(context)}


def _as_text(df: DataFrame) -> DataFrame:
    """Inventories in their comma-joined spelling for output."""
    lists = [name for name, kind in df.dtypes if kind == "array<bigint>"]
    return df.withColumns({name: joined_text(F.col(name)) for name in lists}) if lists else df


def with_lists(df: DataFrame, name: str = "inventory") -> DataFrame:
    """A published inventory as a list again."""
    return df.withColumn(name, F.when(F.col(name) == "", F.array().cast("array<bigint>")).otherwise(F.split(name, ",").cast("array<bigint>")))


def publish_marts(tables: dict[str, DataFrame], root: str, with_profile: bool = True) -> dict[str, dict[str, Any]]:
    """Publish each table whose content changed and return the current manifests."""
    return {name: sync_named(_as_text(df), root, name, SOURCES.get(name, DERIVED), with_profile) for name, df in tables.items()}


def run_workflow(
    flat: dict[str, DataFrame], items: DataFrame, root: str, catalog_version: str | None = None, with_profile: bool = True
) -> dict[str, dict[str, Any]]:
    """Publish flat tables, then the context from their files, then all other marts from its files.

    Documents are parsed and inventories folded once, and the context is computed once, however
    many marts stand on it.
    """
    published = publish_marts(flat, root, with_profile)
    spark = items.sparkSession
    current = lambda name: read_current(spark, root, name)
    context = derive_context(with_lists(current("player_states")), items, catalog_version)
    published |= publish_marts({"context_mart": context}, root, with_profile)
    marts_of = from_context(with_lists(current("context_mart")), published=True)
    if "item_events" in flat:
        marts_of["item_event_mart"] = derive_events(current("item_events"), items)
    return published | publish_marts(marts_of, root, with_profile)
