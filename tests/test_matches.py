from __future__ import annotations

import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkbi.functions.hashing import hmac_sha256
from sparkbi.operators.catalog import champion_catalog, item_catalog, rune_catalog
from sparkbi.operators.documents import MATCH_SCHEMA, TIMELINE_SCHEMA, check_patch, flatten_events, item_events, match_item_events, participants, snapshots
from sparkbi.operators.inventory import final_inventory, fold_inventory, inventory_at, life_spans, number_events
from sparkbi.sources.catalogs import read_champions, read_items, read_runes
from sparkbi.sources.matches import read_matches

EVENTS = "match_id string, participant_id long, timestamp_ms long, frame_pos int, event_pos int, event_type string, item_id long, before_id long, after_id long"


def replay(rows):
    """The fold spelled out one event at a time."""
    states, steps = {}, {}
    for m, p, t, f, e, kind, item, before, after in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        if not kind.startswith("ITEM_"):
            continue
        held = states.setdefault((m, p), [])
        earlier = list(held)
        if kind == "ITEM_PURCHASED" and item:
            held.append(item)
        elif kind in ("ITEM_SOLD", "ITEM_DESTROYED") and item in held:
            held.remove(item)
        elif kind == "ITEM_UNDO":
            if before in held:
                held.remove(before)
            if after:
                held.append(after)
        steps[m, p, t, f, e] = (earlier, list(held))
    return steps, states


def moves(seed, count):
    rnd = random.Random(seed)
    kinds = ["ITEM_PURCHASED", "ITEM_PURCHASED", "ITEM_SOLD", "ITEM_DESTROYED", "ITEM_UNDO", "ITEM_TRANSFORM", "WARD_PLACED"]
    rows = []
    for i in range(count):
        player = 0 if i % 3 == 0 else rnd.randint(1, 9)  # one player holds a third of all events
        rows.append(("m", player, rnd.randint(0, count // 4), i // 10, i % 10, rnd.choice(kinds), rnd.randint(0, 4), rnd.randint(0, 4), rnd.randint(0, 2)))
    rnd.shuffle(rows)
    return rows


def test_fold_equals_replay(spark, partitions):
    rows = moves(8, 2400)
    steps, states = replay(rows)
    events = spark.createDataFrame(rows, EVENTS)
    got = {(r.match_id, r.participant_id, r.timestamp_ms, r.frame_pos, r.event_pos): (r.inventory_before, r.inventory_after) for r in fold_inventory(events).collect()}
    assert got == steps
    spans = life_spans(number_events(events.where("event_type LIKE 'ITEM%'")))
    final = {(r.match_id, r.participant_id): r.inventory for r in final_inventory(spans).collect()}
    assert final == {key: held for key, held in states.items() if held}
    for mark in (0, 77, 300):
        _, then = replay([row for row in rows if row[2] <= mark])
        at = {(r.match_id, r.participant_id): r.inventory for r in inventory_at(spans, [mark]).collect()}
        assert at == {key: held for key, held in then.items() if held}


@pytest.mark.parametrize(
    "history, left",
    [
        ([("ITEM_PURCHASED", 5), ("ITEM_PURCHASED", 6), ("ITEM_PURCHASED", 5), ("ITEM_SOLD", 5)], [6, 5]),
        ([("ITEM_SOLD", 5), ("ITEM_PURCHASED", 5)], [5]),
        ([("ITEM_PURCHASED", 5), ("ITEM_SOLD", 5), ("ITEM_SOLD", 5), ("ITEM_PURCHASED", 5)], [5]),
        ([("ITEM_PURCHASED", 5), ("ITEM_DESTROYED", 5), ("ITEM_PURCHASED", 7)], [7]),
        ([("ITEM_PURCHASED", 5), ("ITEM_UNDO", 0, 5, 0)], None),
        ([("ITEM_PURCHASED", 5), ("ITEM_UNDO", 0, 5, 9)], [9]),
        ([("ITEM_PURCHASED", 5), ("ITEM_UNDO", 0, 5, 5)], [5]),
        ([("ITEM_PURCHASED", 0), ("ITEM_OTHER", 5)], None),
    ],
)
def test_special_histories(spark, history, left):
    rows = [("m", 1, 100, 0, i, kind, item, *(rest or (0, 0))) for i, (kind, item, *rest) in enumerate(history)]
    spans = life_spans(number_events(spark.createDataFrame(rows, EVENTS)))
    got = final_inventory(spans).collect()
    assert (got[0]["inventory"] if got else None) == left


MATCH = {
    "metadata": {"matchId": "KR_1"},
    "info": {
        "gameVersion": "16.18.1",
        "queueId": 420,
        "gameDuration": 1800,
        "participants": [
            {"participantId": 1, "puuid": "secret", "championId": 7, "championName": "A", "teamId": 100, "teamPosition": "", "individualPosition": "TOP", "win": True, "kills": 1, "deaths": 2, "assists": 3, "goldEarned": 9000},
            {"participantId": 2, "championId": 8, "championName": "B", "teamId": 200, "teamPosition": "JUNGLE", "individualPosition": "X", "win": False},
        ],
    },
}


def frame(at, gold, *events, players=("1",)):
    state = {"totalGold": gold, "currentGold": 1, "level": 2, "xp": 3, "minionsKilled": 4, "jungleMinionsKilled": 5, "position": {"x": 6, "y": 7}}
    return {"timestamp": at, "participantFrames": {player: state for player in players}, "events": list(events)}


def happened(kind, player, at, item=None, **more):
    return {"type": kind, "participantId": player, "timestamp": at, **({} if item is None else {"itemId": item}), **more}


TIMELINE = {
    "info": {
        "frames": [
            frame(300_000, 500, happened("ITEM_PURCHASED", 1, 1000, 1001), happened("LEVEL_UP", 1, 900)),
            frame(600_000, 800, happened("ITEM_PURCHASED", 1, 500_000, 1002), happened("ITEM_PURCHASED", 9, 500_000, 1002), players=("1", "9")),
            frame(900_001, 900, happened("ITEM_SOLD", 1, 800_000, 1001)),
        ]
    }
}


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("matches")
    (root / "KR_1").mkdir()
    (root / "KR_1" / "match.json").write_text(json.dumps(MATCH, indent=1))
    (root / "KR_1" / "timeline.json").write_text(json.dumps(TIMELINE, indent=1))
    return root


def test_participants(spark, documents):
    matches, _ = read_matches(spark, str(documents), ["KR_1"])
    one, two = participants(matches, "pepper").orderBy("participant_id").collect()
    assert one["match_participant_key"] == "KR_1:1" and one["role"] == "TOP" and two["role"] == "JUNGLE"
    assert one["puuid_hash"] == hmac.new(b"pepper", b"secret", hashlib.sha256).hexdigest()
    assert two["puuid_hash"] == hmac.new(b"pepper", b"", hashlib.sha256).hexdigest()
    assert (one["win"], two["win"], one["gold_earned"], two["kills"]) == (True, False, 9000, None)


def test_long_peppers(spark):
    key = "k" * 100
    got = spark.range(1).select(hmac_sha256(F.lit("msg"), key)).first()[0]
    assert got == hmac.new(key.encode(), b"msg", hashlib.sha256).hexdigest()


def test_missing_match_is_an_error(spark, documents):
    with pytest.raises(FileNotFoundError, match="KR_2"):
        read_matches(spark, str(documents), ["KR_1", "KR_2"])
    matches, timelines = read_matches(spark, str(documents))
    assert matches.count() == timelines.count() == 1


def test_events_and_snapshots(spark, documents):
    matches, timelines = read_matches(spark, str(documents))
    assert flatten_events(timelines).count() == 5
    assert item_events(timelines, matches).count() == 3  # player 9 is not in the match
    folded = fold_inventory(item_events(timelines, matches)).orderBy("timestamp_ms").collect()
    assert [row["event_type"] for row in folded][0] == "ITEM_PURCHASED"
    assert [row["inventory_after"] for row in folded] == [[1001], [1001, 1002], [1002]]
    inside = match_item_events(matches, timelines).orderBy("timestamp_ms").collect()
    assert [(row["event_type"], row["inventory_before"], row["inventory_after"]) for row in inside] == [
        (row["event_type"], row["inventory_before"], row["inventory_after"]) for row in folded
    ]
    got = {(row["minute"], row["participant_id"]): row for row in snapshots(matches, timelines, [4, 5, 10, 15, 15]).collect()}
    assert set(got) == {(5, 1), (10, 1), (10, 9), (15, 1), (15, 9)}  # minute 4 lies before the first frame
    assert got[5, 1]["inventory"] == [1001] and got[10, 1]["inventory"] == [1001, 1002] and got[15, 1]["inventory"] == [1002]
    assert got[15, 1]["total_gold"] == 800  # the frame at 900001 ms is too late
    assert got[10, 1]["role"] == "" and got[10, 1]["team_id"] == 100
    stranger = got[10, 9]
    assert stranger["team_id"] is None and stranger["win"] is False and stranger["inventory"] == []
    assert stranger["game_version"] == "16.18.1" and stranger["match_participant_key"] == "KR_1:9"


def test_document_fold_equals_the_table_fold(spark):
    rows = [row for row in moves(21, 400) if row[1] < 8]
    frames = {}
    for m, player, at, f, e, kind, item, before, after in sorted(rows, key=lambda r: (r[3], r[4])):
        frames.setdefault(f, []).append(happened(kind, player, at, item, beforeId=before, afterId=after))
    timeline = {"info": {"frames": [frame(i, 0, *events) for i, events in frames.items()] + [{"timestamp": 9}]}}
    match = {"info": {"participants": [{"participantId": i} for i in range(8)]}}
    read = lambda document, schema: spark.createDataFrame([(json.dumps(document),)], "j string").select(F.from_json("j", schema).alias("d")).select(F.lit("m").alias("match_id"), "d.*")
    matches, timelines = read(match, MATCH_SCHEMA), read(timeline, TIMELINE_SCHEMA)
    names = ["participant_id", "timestamp_ms", "event_type", "item_id", "inventory_before", "inventory_after"]
    inside = sorted(map(tuple, match_item_events(matches, timelines).select(names).collect()))
    assert inside == sorted(map(tuple, fold_inventory(item_events(timelines, matches)).select(names).collect()))
    assert len(inside) > 200


def test_patch_check(spark):
    states = spark.createDataFrame([("16.18.1",), ("16.17.3",), (None,)], "game_version string")
    check_patch(states, spark.createDataFrame([("16.18.1",), ("16.17.1",)], "patch string"))
    with pytest.raises(ValueError, match="16.17"):
        check_patch(states, spark.createDataFrame([("16.18",)], "patch string"))


def test_catalogs(spark, tmp_path):
    sword = {
        "name": "Long Sword",
        "gold": {"purchasable": True, "total": 350},
        "maps": {"11": True},
        "stats": {"FlatPhysicalDamageMod": 10},
        "description": "<stats>20 Ability Haste</stats>",
        "tags": ["Damage", "Lane"],
        "into": ["1"],
    }
    items = {"data": {"1036": sword, "1": {**sword, "maps": {"12": True}}, "2": {**sword, "gold": {"purchasable": False}}, "3": {"gold": {"purchasable": True}, "maps": {"11": True}, "depth": 3}}}
    (tmp_path / "items.json").write_text(json.dumps(items, indent=1))
    got = {row["item_id"]: row for row in item_catalog(read_items(spark, str(tmp_path / "items.json"), "16.18.1")).collect()}
    assert set(got) == {1036, 3}
    row = got[1036]
    assert (row["ad"], row["hp"], row["ability_haste"], row["tags"], row["item_tier"], row["is_final_item"]) == (10.0, 0.0, 20.0, "Damage,Lane", 1, False)
    assert (got[3]["item_name"], got[3]["total_gold"], got[3]["item_tier"], got[3]["is_final_item"], got[3]["description"]) == ("3", 0.0, 3, True, "")

    champions = {"data": {"Ahri": {"key": "103", "id": "Ahri", "name": "Ahri", "tags": ["Mage"], "stats": {"hp": 590, "armor": 21}}}}
    (tmp_path / "champions.json").write_text(json.dumps(champions))
    row = champion_catalog(read_champions(spark, str(tmp_path / "champions.json"), "16.18.1")).first()
    assert (row["patch"], row["champion_id"], row["base_hp"], row["base_armor"], row["tags"]) == ("16.18.1", 103, 590.0, 21.0, "Mage")

    runes = [{"id": 8000, "name": "Precision", "slots": [{"runes": [{"id": 8005, "key": "a", "name": "A", "longDesc": "long", "shortDesc": "short"}]}, {"runes": [{"id": 9111, "key": "b", "name": "B", "longDesc": "", "shortDesc": "short"}]}]}]
    (tmp_path / "runes.json").write_text(json.dumps(runes))
    got = rune_catalog(read_runes(spark, str(tmp_path / "runes.json"), "16.18.1")).orderBy("rune_id").collect()
    assert [(row["slot"], row["rune_id"], row["description"]) for row in got] == [(0, 8005, "long"), (1, 9111, "short")]
