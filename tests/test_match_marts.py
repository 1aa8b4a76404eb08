from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkbi.operators.catalog import item_catalog
from sparkbi.plans.match_marts import derive_marts, flatten_matches, publish_marts, run_workflow
from sparkbi.sources.catalogs import read_items
from sparkbi.sources.matches import read_matches
from sparkbi.sources.published import read_current


def item(name, gold, attack, into):
    return {"name": name, "gold": {"purchasable": True, "total": gold}, "maps": {"11": True}, "stats": {"FlatPhysicalDamageMod": attack}, "into": into, "description": "", "tags": []}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two matches of two patches in which the same item has two prices."""
    root = tmp_path_factory.mktemp("mixed")
    catalogs = []
    for number, (version, gold) in enumerate([("16.17.4", 300), ("16.18.1", 350)]):
        (root / f"KR_{number}").mkdir()
        players = [
            {"participantId": pid, "puuid": f"p{pid}", "championId": pid, "teamId": team, "teamPosition": "TOP", "win": team == 100}
            for pid, team in ((1, 100), (2, 200))
        ]
        (root / f"KR_{number}" / "match.json").write_text(json.dumps({"info": {"gameVersion": version, "participants": players}}))
        state = {"totalGold": 1000 + number, "position": {}}
        events = [{"type": "ITEM_PURCHASED", "participantId": 1, "itemId": 1036, "timestamp": 30_000}]
        frames = [{"timestamp": 60_000, "participantFrames": {"1": state, "2": {**state, "totalGold": 900}}, "events": events}]
        (root / f"KR_{number}" / "timeline.json").write_text(json.dumps({"info": {"frames": frames}}))
        path = root / f"items{number}.json"
        path.write_text(json.dumps({"data": {"1036": item("Long Sword", gold, 10, [] if number else ["1"])}}))
        catalogs.append(item_catalog(read_items(spark, str(path), version)))
    matches, timelines = read_matches(spark, str(root), ["KR_0", "KR_1"])
    flat = flatten_matches(matches, timelines, "pepper", [10])
    return flat, catalogs[0].unionByName(catalogs[1])


def test_each_patch_is_priced_by_its_own_catalog(tables):
    flat, items = tables
    made = derive_marts(flat["player_states"], flat["item_events"], items)
    context = {(row["match_id"], row["team_id"]): row for row in made["context_mart"].collect()}
    assert [context[match, 100]["inventory_cost"] for match in ("KR_0", "KR_1")] == [300.0, 350.0]
    assert [context[match, 100]["lane_gold_diff"] for match in ("KR_0", "KR_1")] == [100, 101]
    events = {row["match_id"]: (row["total_gold"], row["is_completion_event"], row["minute"]) for row in made["item_event_mart"].collect()}
    assert events == {"KR_0": (300.0, False, 0.5), "KR_1": (350.0, True, 0.5)}
    assert sorted(row["patch"] for row in made["patch_stat_trend"].collect()) == ["16.17", "16.18"]
    assert sum(row["sample_players"] for row in made["sample_coverage"].collect()) == 4


def test_a_missing_catalog_is_refused(tables):
    flat, items = tables
    with pytest.raises(ValueError, match="16.17"):
        derive_marts(flat["player_states"], flat["item_events"], items.where("patch = '16.18.1'"))


def test_publishing_twice_makes_no_new_version(spark, tables, tmp_path):
    flat, _ = tables
    first = publish_marts(flat, str(tmp_path))
    again = publish_marts(flat, str(tmp_path))
    assert {name: sealed["version_number"] for name, sealed in again.items()} == {"participants": 1, "player_states": 1, "item_events": 1}
    assert first["participants"]["row_count"] == 4
    states = read_current(spark, str(tmp_path), "player_states")
    assert dict(states.dtypes)["inventory"] == "string"
    assert sorted(row["inventory"] for row in states.where(F.col("participant_id") == 1).collect()) == ["1036", "1036"]


def test_workflow_publishes_once_and_derives_from_files(spark, tables, tmp_path):
    flat, items = tables
    first = run_workflow(flat, items, str(tmp_path), "catalogs 1")
    again = run_workflow(flat, items, str(tmp_path), "catalogs 1")
    assert len(first) == 9 and {name: sealed["version_number"] for name, sealed in again.items()} == dict.fromkeys(first, 1)
    lazy = derive_marts(flat["player_states"], flat["item_events"], items)
    for name, table in lazy.items():
        published = read_current(spark, str(tmp_path), name)
        shared = [column for column in table.columns if column not in ("inventory", "inventory_before", "inventory_after")]
        assert sorted(map(str, published.select(*shared).collect())) == sorted(map(str, table.select(*shared).collect()))
    assert {row["catalog_version"] for row in read_current(spark, str(tmp_path), "context_mart").collect()} == {"catalogs 1"}
