"""Nested match and timeline documents flattened into participants, events and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkbi.functions.hashing import hmac_sha256
from sparkbi.functions.text import patch_key
from sparkbi.operators.catalog import for_each_patch
from sparkbi.operators.inventory import DESTROYED, ITEM_PREFIX, PURCHASED, SOLD, UNDO

MINUTE_MS = 60_000
DEFAULT_MINUTES = (10, 15, 20)

# The parts of the documents that are read, in their own spelling.
MATCH_SCHEMA = """
    metadata struct<matchId: string>,
    info struct<
        gameVersion: string, queueId: long, gameDuration: long,
        participants: array<struct<
            participantId: long, puuid: string, championId: long, championName: string, teamId: long,
            teamPosition: string, individualPosition: string, win: boolean,
            kills: long, deaths: long, assists: long, goldEarned: long>>>
"""
TIMELINE_SCHEMA = """
    info struct<frames: array<struct<
        timestamp: long,
        participantFrames: map<string, struct<
            totalGold: long, currentGold: long, level: long, xp: long,
            minionsKilled: long, jungleMinionsKilled: long, position: struct<x: long, y: long>>>,
        events: array<struct<
            type: string, participantId: long, itemId: long, beforeId: long, afterId: long, timestamp: long>>>>>
"""


def _member_key() -> Column:
    return F.concat_ws(":", F.col("match_id"), F.col("participant_id").cast("string"))


def participants(matches: DataFrame, pepper: str) -> DataFrame:
    """One row per participant; the player id leaves only as a keyed pseudonym."""
    p = F.col("p")
    return (
        matches.select("match_id", "info", F.explode("info.participants").alias("p"))
        .withColumn("participant_id", p["participantId"])
        .select(
            "match_id",
            "participant_id",
            _member_key().alias("match_participant_key"),
            hmac_sha256(F.coalesce(p["puuid"], F.lit("")), pepper).alias("puuid_hash"),
            F.col("info.gameVersion").alias("game_version"),
            F.col("info.queueId").alias("queue_id"),
            p["championId"].alias("champion_id"),
            p["championName"].alias("champion_name"),
            p["teamId"].alias("team_id"),
            F.coalesce(F.nullif(p["teamPosition"], F.lit("")), p["individualPosition"]).alias("role"),
            F.coalesce(p["win"], F.lit(False)).alias("win"),
            p["kills"].alias("kills"),
            p["deaths"].alias("deaths"),
            p["assists"].alias("assists"),
            p["goldEarned"].alias("gold_earned"),
            F.col("info.gameDuration").alias("game_duration_s"),
        )
    )


def flatten_events(timelines: DataFrame) -> DataFrame:
    """All frame events as rows; ``timestamp_ms, frame_pos, event_pos`` is their order."""
    frames = timelines.select("match_id", F.posexplode("info.frames").alias("frame_pos", "f"))
    rows = frames.select("match_id", "frame_pos", F.posexplode("f.events").alias("event_pos", "e"))
    return rows.select(
        "match_id",
        F.col("e.participantId").alias("participant_id"),
        F.coalesce("e.timestamp", F.lit(0)).alias("timestamp_ms"),
        "frame_pos",
        "event_pos",
        F.col("e.type").alias("event_type"),
        F.coalesce("e.itemId", F.lit(0)).alias("item_id"),
        F.coalesce("e.beforeId", F.lit(0)).alias("before_id"),
        F.coalesce("e.afterId", F.lit(0)).alias("after_id"),
    )


def item_events(timelines: DataFrame, matches: DataFrame) -> DataFrame:
    """Item events of participants that the match lists; others are ignored."""
    listed = matches.select("match_id", F.explode("info.participants.participantId").alias("participant_id"))
    rows = flatten_events(timelines).where(F.col("event_type").startswith(ITEM_PREFIX))
    return rows.join(listed.distinct(), ["match_id", "participant_id"], "left_semi")


def _moves() -> Column:
    """The item events of one document in time order, ties in document order."""

    def moves_of(frame: Column, frame_pos: Column) -> Column:
        return F.transform(
            frame["events"],
            lambda e, event_pos: F.struct(
                F.coalesce(e["timestamp"], F.lit(0)).alias("at"),
                frame_pos.alias("frame_pos"),
                event_pos.alias("event_pos"),
                e["participantId"].alias("player"),
                e["type"].alias("kind"),
                F.coalesce(e["itemId"], F.lit(0)).alias("item"),
                F.coalesce(e["beforeId"], F.lit(0)).alias("before"),
                F.coalesce(e["afterId"], F.lit(0)).alias("after"),
            ),
        )

    per_frame = F.filter(F.transform("info.frames", moves_of), lambda moves: moves.isNotNull())
    return F.sort_array(F.filter(F.flatten(per_frame), lambda move: move["kind"].startswith(ITEM_PREFIX)))


def _next_state(held: Column, move: Column) -> Column:
    """The inventory after one event: drop the first copy of one item, append another."""
    kind = move["kind"]
    gone = F.when(kind.isin(SOLD, DESTROYED), move["item"]).when(kind == UNDO, move["before"]).otherwise(0)
    come = F.when(kind == PURCHASED, move["item"]).when(kind == UNDO, move["after"]).otherwise(0)
    place = F.array_position(held, gone)
    rest = F.concat(F.slice(held, 1, F.greatest(place - 1, F.lit(0)).cast("int")), F.slice(held, (place + 1).cast("int"), F.size(held)))
    kept = F.when(place > 0, rest).otherwise(held)
    return F.when(come != 0, F.concat(kept, F.array(come))).otherwise(kept)


def _nothing() -> Column:
    return F.array().cast("array<bigint>")


def _paired(matches: DataFrame, timelines: DataFrame) -> DataFrame:
    """One row per match with its frames, its moves and its participants' attributes."""
    players = F.transform(
        "info.participants",
        lambda p: F.struct(
            p["participantId"].alias("id"), p["teamId"].alias("team"), p["championId"].alias("champion"), p["teamPosition"].alias("role"), p["win"].alias("win")
        ),
    )
    known = matches.select("match_id", F.col("info.gameVersion").alias("game_version"), F.coalesce(players, F.array()).alias("players"))
    return timelines.select("match_id", "info.frames", _moves().alias("moves")).join(known, "match_id", "left")


def match_item_events(matches: DataFrame, timelines: DataFrame) -> DataFrame:
    """Item events with the inventory before and after, folded inside each document row.

    A document is one input record, so its fold needs no shuffle. For a flat event table of
    any size use ``fold_inventory``, which gives the same result.
    """

    def history(player: Column) -> Column:
        def step(state: Column, move: Column) -> Column:
            after = _next_state(state["held"], move)
            entry = F.struct(move.alias("move"), state["held"].alias("earlier"), after.alias("later"))
            return F.struct(after.alias("held"), F.concat(state["log"], F.array(entry)).alias("log"))

        move_type = "struct<at:bigint,frame_pos:int,event_pos:int,player:bigint,kind:string,item:bigint,before:bigint,after:bigint>"
        empty_log = F.array().cast(f"array<struct<move:{move_type},earlier:array<bigint>,later:array<bigint>>>")
        start = F.struct(_nothing().alias("held"), empty_log.alias("log"))
        own = F.filter("moves", lambda move: move["player"] == player["id"])
        return F.aggregate(own, start, step, lambda state: state["log"])

    logs = F.flatten(F.transform("players", history))
    rows = _paired(matches, timelines).select("match_id", "game_version", F.explode(logs).alias("e"))
    return rows.select(
        "match_id",
        "game_version",
        F.col("e.move.player").alias("participant_id"),
        F.col("e.move.at").alias("timestamp_ms"),
        F.col("e.move.frame_pos").alias("frame_pos"),
        F.col("e.move.event_pos").alias("event_pos"),
        F.col("e.move.kind").alias("event_type"),
        F.col("e.move.item").alias("item_id"),
        F.col("e.earlier").alias("inventory_before"),
        F.col("e.later").alias("inventory_after"),
    )


def snapshots(matches: DataFrame, timelines: DataFrame, minutes: Sequence[int] = DEFAULT_MINUTES) -> DataFrame:
    """Player states at the requested minutes, with attributes and the inventory held then.

    Per minute the last frame at or before it counts, and a minute before the first frame
    yields nothing. Match and timeline rows meet in one join on the match id; the rest
    happens inside each row.
    """
    wanted = F.array(*[F.lit(int(minute)) for minute in sorted(set(minutes))])
    limit = F.col("minute") * MINUTE_MS
    usable = F.filter("frames", lambda frame: F.coalesce(frame["timestamp"], F.lit(0)) <= limit)
    # get() with a size of zero asks for position -1 and gives null
    per_minute = (
        _paired(matches, timelines)
        .withColumn("minute", F.explode(wanted))
        .withColumn("frame", F.get(usable, F.size(usable) - 1))
        .where(F.col("frame").isNotNull())
    )

    def player_state(entry: Column) -> Column:
        number = entry["key"].cast("long")
        known = F.get(F.filter("players", lambda p: p["id"] == number), F.lit(0))
        own = F.filter("moves", lambda move: (move["player"] == number) & (move["at"] <= limit))
        held = F.when(known.isNotNull(), F.aggregate(own, _nothing(), _next_state)).otherwise(_nothing())
        return F.struct(number.alias("participant_id"), entry["value"].alias("s"), known.alias("p"), held.alias("inventory"))

    states = F.transform(F.map_entries("frame.participantFrames"), player_state)
    s, p = F.col("s"), F.col("p")
    return per_minute.select("match_id", "game_version", "minute", F.inline(states)).select(
        "match_id",
        "participant_id",
        "minute",
        _member_key().alias("match_participant_key"),
        "game_version",
        p["team"].alias("team_id"),
        p["champion"].alias("champion_id"),
        p["role"].alias("role"),
        F.coalesce(p["win"], F.lit(False)).alias("win"),
        s["totalGold"].alias("total_gold"),
        s["currentGold"].alias("current_gold"),
        s["level"].alias("level"),
        s["xp"].alias("xp"),
        s["minionsKilled"].alias("cs"),
        s["jungleMinionsKilled"].alias("jungle_cs"),
        s["position"]["x"].alias("position_x"),
        s["position"]["y"].alias("position_y"),
        "inventory",
    )


def lacking_patches(states: DataFrame, items: DataFrame) -> DataFrame:
    """The patches (``patch``) of played matches that an item catalog lacks."""
    played = states.where(F.col("game_version").isNotNull()).select(patch_key(F.col("game_version")).alias("patch"))
    known = for_each_patch(items.select("patch").distinct()).select(patch_key(F.col("patch")).alias("patch")).distinct()
    return played.distinct().join(known, "patch", "left_anti")


def check_patch(states: DataFrame, items: DataFrame) -> None:
    """Refuse a catalog that lacks the patch of some match."""
    lacking = [row["patch"] for row in lacking_patches(states, items).limit(20).collect()]
    if lacking:
        raise ValueError(f"no item catalog for patches: {', '.join(sorted(lacking))}")
