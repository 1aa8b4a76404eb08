from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkbi.operators.recipe import Step
from sparkbi.operators.query import Filter, apply_filters
from sparkbi.sources.differences import merged_profile, sync_changed
from sparkbi.sources.files import coerce_datetimes, preview, read_csv, read_file, read_parquet, union_all
from sparkbi.sources.published import fingerprint, manifest, publish, publish_version, read_current, run_recipe, sync_named
from sparkbi.streaming.compaction import compact_batch, compact_into, compact_stream, first_wins, read_compacted
from sparkbi.streaming.envelope import accepted, file_stream, validate
from sparkbi.streaming.landing import write_bronze, write_quarantine
from sparkbi.streaming.newest import latest, newest_wins, rocksdb_state


def test_csv_encodings(spark, tmp_path):
    text = "이름,값\n가나다,1\n라마,2.5\n"
    for name, data in {"bom": text.encode("utf-8-sig"), "plain": text.encode("utf-8"), "old": text.encode("cp949")}.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(data)
        got = read_file(spark, str(path))
        assert got.columns == ["이름", "값"]
        assert sorted(map(tuple, got.collect())) == [("가나다", 1.0), ("라마", 2.5)]


def test_csv_quotes_and_schema(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"x, ""y""\nz",2\n')
    assert read_csv(spark, str(tmp_path / "q.csv"), schema="a string, b int", multi_line=True).collect() == [('x, "y"\nz', 2)]
    with pytest.raises(ValueError):
        read_file(spark, "table.xlsx")


def test_parquet_read_turns_nan_into_null(spark, tmp_path):
    spark.createDataFrame([(1.0,), (float("nan"),)], "v double").write.parquet(str(tmp_path / "p"))
    assert read_parquet(spark, str(tmp_path / "p")).where("v IS NULL").count() == 1


def test_filters_reach_the_scan(spark, tmp_path):
    rows = [(float(v), str(v)) for v in range(10)] + [(float("nan"), "n"), (None, "m")]
    df = spark.createDataFrame(rows, "v double, k string")
    df.write.parquet(str(tmp_path / "p"))

    def plan(made):
        return made._jdf.queryExecution().executedPlan().toString()

    above = read_parquet(spark, str(tmp_path / "p"), filters=[Filter("v", "gt", 5)])
    assert "GreaterThan(v,5.0)" in plan(above) and sorted(row["k"] for row in above.collect()) == ["6", "7", "8", "9"]
    assert sorted(row["k"] for row in read_parquet(spark, str(tmp_path / "p"), filters=[Filter("v", "eq", None)]).collect()) == ["m", "n"]
    assert read_parquet(spark, str(tmp_path / "p"), filters=[Filter("v", "ne", 3)]).count() == 11
    publish(df, str(tmp_path), "d")
    current = read_current(spark, str(tmp_path), "d")
    assert current.where("v is null").count() == 2
    assert "GreaterThan(v,5.0)" in plan(apply_filters(current, [Filter("v", "gt", 5)]))


def test_preview_and_union(spark):
    df = spark.sql("SELECT id, timestamp_ntz'2024-01-02 03:04:05' AS t, date'2024-01-02' AS d FROM range(2000)")
    with pytest.raises(ValueError):
        preview(df, 1001)
    got = preview(df, 1000)
    assert got.count() == 1000 and got.first()["t"].startswith("2024-01-02T03:04:05") and got.first()["d"] == "2024-01-02"
    both = union_all([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")])
    assert sorted(map(tuple, both.collect())) == [(1, None), (2, "x")]
    with pytest.raises(ValueError):
        union_all([])


def test_datetimes_are_coerced_by_verdict(spark):
    rows = [(f"2024-01-{1 + i % 28:02d}" if i else "bad", "later") for i in range(50)]
    got = coerce_datetimes(spark.createDataFrame(rows, "order_date string, due_date string"))
    assert dict(got.dtypes) == {"order_date": "timestamp", "due_date": "string"}
    assert got.where("order_date IS NULL").count() == 1
    with pytest.raises(ValueError):
        coerce_datetimes(got, max_columns=1)


def test_fingerprint_depends_on_content_only(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("b", "c")], "x string, y string")
    assert fingerprint(df) == fingerprint(df.orderBy("y").repartition(3))
    assert fingerprint(df) != fingerprint(spark.createDataFrame([("a", None), ("a", None), ("b", "c")], df.schema))
    assert fingerprint(df) != fingerprint(df.withColumnRenamed("x", "z"))
    assert fingerprint(spark.range(3)) == fingerprint(spark.range(3).select(F.col("id").cast("int")))


def test_publish_and_versions(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1,), (2,)], "x int")
    one = publish(df, root, "numbers")
    assert (one["version_number"], one["row_count"], one["column_count"], one["fingerprint"]) == (1, 2, 1, fingerprint(df))
    assert one["profile"][0]["name"] == "x" and one["columns"][0]["name"] == "x"
    with pytest.raises(ValueError):
        publish(df, root, "numbers")
    two = publish_version(df.where("x > 1"), root, "numbers", "later", [{"operation": "filter"}])
    assert two["version_number"] == 2 and manifest(spark, root, "numbers")["recipe"]["name"] == "later"
    assert read_current(spark, root, "numbers").collect() == [(2,)]
    assert read_current(spark, root, "numbers", 1).count() == 2
    with pytest.raises(KeyError):
        read_current(spark, root, "nothing")
    with pytest.raises(ValueError):
        publish(df, root, "../outside")


def test_clustered_versions_leave_files_out(spark, tmp_path):
    root = str(tmp_path)
    moment = F.timestamp_micros(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**15)))
    df = spark.range(20_000).select(
        F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(1000)).cast("int")).alias("x"),
        moment.alias("t"),
        F.concat(F.lit("k"), F.lpad(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10_000)).cast("string"), 4, "0")).alias("s"),
        (F.col("id") / 7).alias("v"),
    )
    sealed = publish(df, root, "d", with_profile=False, cluster_by=["x", "t", "s"], files=64)
    assert len(sealed["files"]) > 40 and all(set(item["ranges"]) == {"x", "t", "s"} for item in sealed["files"])
    cases = {
        0.8: [[Filter("x", "gt", 900)], [Filter("x", "lt", 50.5)], [Filter("t", "gte", "2001-01-01T00:00:00")], [Filter("s", "eq", "k0100")], [Filter("x", "in", [3, 990])], [Filter("x", "eq", None)]],
        0.35: [[Filter("x", "gt", 900), Filter("t", "lt", "1972-01-01"), Filter("s", "in", ["k0007", "k0008"])]],
        1.0: [[Filter("v", "lt", 100)], [Filter("x", "ne", 5)]],
        0.0: [[Filter("x", "gt", 5000)], [Filter("x", "eq", "no number")]],
    }
    for most, groups in cases.items():
        for filters in groups:
            got = read_current(spark, root, "d", filters=filters)
            assert len(got.inputFiles()) <= most * len(sealed["files"])
            assert sorted(map(str, got.collect())) == sorted(map(str, apply_filters(df, filters).collect()))
    # the next version keeps the layout; a frame without rows and a column of nulls are no trouble
    assert publish_version(df.where("x > 500"), root, "d", "later", with_profile=False)["cluster_by"] == ["x", "t", "s"]
    nothing = publish(df.where("false"), root, "e", with_profile=False, cluster_by=["x"])
    assert nothing["row_count"] == 0 and read_current(spark, root, "e", filters=[Filter("x", "gt", 1)]).count() == 0
    publish(df.withColumn("x", F.lit(None).cast("int")), root, "n", with_profile=False, cluster_by=["x", "s"], files=4)
    assert read_current(spark, root, "n", filters=[Filter("x", "eq", None)]).count() == 20_000
    with pytest.raises(ValueError):
        publish(df, root, "f", cluster_by=["lost"])


def test_sync_writes_only_changed_buckets(spark, tmp_path):
    root = str(tmp_path)
    rows = [(f"k{number}" if number else None, number % 7, float(number)) for number in range(300)] + [("k1", 1, 1.0)]

    def frame(rows):
        return spark.createDataFrame(rows, "k string, g int, v double").repartition(3)

    def sync(rows, **more):
        made = sync_changed(frame(rows), root, "d", more.pop("key", ["k"]), "api", buckets=more.pop("buckets", 16))
        got = read_current(spark, root, "d")
        assert got.columns == ["k", "g", "v"] and sorted(map(str, got.collect())) == sorted(map(str, frame(rows).collect()))
        assert made["fingerprint"] == fingerprint(frame(rows)) and made["row_count"] == len(rows)
        return made

    first = sync(rows)
    assert len(first["buckets_written"]) == 16 and first["version_number"] == 1
    assert sync(rows[::-1])["version_number"] == 1  # the order of rows does not matter
    changed = sync([(k, g, v + 1 if k == "k7" else v) for k, g, v in rows])
    assert len(changed["buckets_written"]) == 1 and changed["version_number"] == 2
    assert [name for name in os.listdir(tmp_path / "d" / changed["data"]) if "=" in name] == [f"_bucket={changed['buckets_written'][0]}"]
    assert len(sync([row for row in rows if row[0] != "k9"])["buckets_written"]) in (1, 2)  # k7 goes back, k9 goes
    assert len(sync(rows + [rows[20]])["buckets_written"]) in (1, 2)  # a repeated row counts
    assert sync([row for row in rows if row[0] is None or row[0] == "k3"])["row_count"] == 2
    assert sync([])["files"] == []
    assert len(sync(rows, buckets=4)["buckets_written"]) == 4 and len(sync(rows, key=["g"], buckets=4)["buckets_written"]) <= 4
    publish_version(frame(rows), root, "d", "other", with_profile=False)
    assert len(sync_changed(frame(rows), root, "d", ["k"], "api", buckets=4)["buckets_written"]) == 4


def test_profiles_are_merged_from_the_sketches_of_buckets(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(30_000).select("id", (F.col("id") % 700).alias("few"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("t"), F.col("id") % 90)).alias("s"), F.lit(None).cast("double").alias("none"))
    sync_changed(df, root, "d", ["id"], "api", buckets=8)
    changed = sync_changed(df.where("id <> 77"), root, "d", ["id"], "api", buckets=8)
    assert len(changed["buckets_written"]) == 1 and len(set(changed["sketched"].values())) == 2
    got = {row["column"]: row for row in merged_profile(spark, root, "d").collect()}
    assert {name: (row["rows"], row["nulls"], row["low"], row["high"]) for name, row in got.items()} == {
        "id": (29_999, 0, 0.0, 29_999.0), "few": (29_999, 0, 0.0, 699.0), "s": (29_999, 7500, None, None), "none": (29_999, 29_999, None, None)
    }
    for name, exact in {"id": 29_999, "few": 700, "s": 90, "none": 0}.items():
        assert abs(got[name]["distinct"] - exact) <= 0.065 * exact
    assert abs(got["id"]["median"] - 15_000) < 600 and abs(got["few"]["q3"] - 525) < 15 and got["s"]["median"] is None
    sync_changed(df.where("false"), root, "d", ["id"], "api", buckets=8)
    assert merged_profile(spark, root, "d").count() == 0


def test_a_claimed_number_is_not_reused(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(1)
    publish(df, root, "d", with_profile=False)
    (tmp_path / "d" / "manifests" / "v000002.claim").touch()  # another writer is at work
    assert publish_version(df, root, "d", "r", with_profile=False)["version_number"] == 3


def test_missing_files_are_refused(spark, tmp_path):
    root = str(tmp_path)
    sealed = publish(spark.range(5), root, "d", with_profile=False)
    os.remove(tmp_path / "d" / sealed["data"] / sealed["files"][0]["path"])
    with pytest.raises(FileNotFoundError):
        read_current(spark, root, "d")


def test_sync_and_recipe(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sync_named(df, root, "d", "api")["version_number"] == 1
    assert sync_named(df.repartition(2), root, "d", "api")["version_number"] == 1
    changed = sync_named(df.union(df), root, "d", "api")
    assert (changed["version_number"], changed["source_type"]) == (2, "api")
    publish(spark.createDataFrame([("a", "x")], "k string, w string"), root, "other", with_profile=False)
    steps = [Step("drop_duplicates", {}), Step("join", {"right_dataset_id": "other", "left_on": ["k"], "how": "inner", "validate": "one_to_one"})]
    made = run_recipe(spark, root, "d", "joined", steps)
    assert made["version_number"] == 3 and made["recipe"]["steps"][1]["operation"] == "join"
    assert read_current(spark, root, "d").collect() == [("a", 1, "x")]


def event(name, at="2024-01-02T03:04:05", value=1, **more):
    return {"event_id": name, "domain": "d", "dataset": "s", "schema_version": "1.0", "event_time": at, "payload": {"v": value}, **more}


def lines(events):
    return [(e if isinstance(e, str) else json.dumps(e),) for e in events]


def test_validation(spark):
    lacking = event("b")
    del lacking["payload"], lacking["domain"]
    cases = [event("a"), lacking, event("c", schema_version="2.0"), event("d", schema_version=None), event("e", domain=None), "not json", event("f", schema_version="1"), event("g", schema_version="10.0")]
    got = [row["reason"] for row in validate(spark.createDataFrame(lines(cases), "value string")).collect()]
    assert got == [None, "missing fields: domain, payload", "unsupported schema version: 2.0", "unsupported schema version: null", None, "not a JSON object", None, "unsupported schema version: 10.0"]
    with pytest.raises(Exception, match="unsupported schema version"):
        validate(spark.createDataFrame(lines(cases[2:3]), "value string"), strict=True).collect()
    good = accepted(validate(spark.createDataFrame(lines(cases), "value string"))).first()
    assert (good["dt"], good["hour"], json.loads(good["payload"])) == ("2024-01-02", "03", {"v": 1})


def drop(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(value for value, in lines(events)) + "\n")


def test_landing_and_compaction(spark, tmp_path):
    inbox, bronze, silver = tmp_path / "in", str(tmp_path / "bronze"), str(tmp_path / "silver")
    drop(inbox, "one.json", [event("same", value=1), event("same", at="2024-01-02T05:00:00", value=3), event("other", value=2), "broken"])

    def land():
        write_bronze(file_stream(spark, str(inbox)), bronze, str(tmp_path / "c1"), once=True).awaitTermination()
        write_quarantine(file_stream(spark, str(inbox)), str(tmp_path / "bad"), str(tmp_path / "c2"), once=True).awaitTermination()

    def compact():
        compact_stream(spark, bronze, silver, str(tmp_path / "c3")).awaitTermination()

    def values():
        return {row["event_id"]: json.loads(row["payload"])["v"] for row in read_compacted(spark, silver).collect()}

    land()
    assert sorted(os.listdir(f"{bronze}/dt=2024-01-02"))[-2:] == ["hour=03", "hour=05"]
    assert spark.read.json(str(tmp_path / "bad")).first()["reason"] == "not a JSON object"
    compact()
    assert values() == {"same": 3, "other": 2}
    land(), compact()  # a restart finds nothing new
    assert spark.read.json(bronze).count() == 3 and values() == {"same": 3, "other": 2}
    drop(inbox, "two.json", [event("other", at="2024-01-09T00:00:00", value=9), event("same", at="2024-01-01T00:00:00", value=0)])
    land(), compact()  # a later copy of an old event wins, an older one does not
    assert values() == {"same": 3, "other": 9}


def test_newest_goes_by_moment_and_bad_times_are_quarantined(spark):
    rows = [("a", "2024-01-01T09:00:00+09:00", 1), ("a", "2024-01-01T05:00:00Z", 2), ("a", "not a time", 3), ("b", None, 4), ("b", "2024/01/02", 5)]
    got = {row["event_id"]: row["v"] for row in compact_batch(spark.createDataFrame(rows, "event_id string, event_time string, v int")).collect()}
    assert got == {"a": 2, "b": 5}
    cases = [event("x", at="yesterday"), event("y", at=None), event("z", at="2024-01-01T00:00:00+09:00")]
    checked = validate(spark.createDataFrame(lines(cases), "value string"))
    assert [row["reason"] for row in checked.collect()] == ["unreadable event time: yesterday", "unreadable event time: null", None]
    assert [(row["dt"], row["hour"]) for row in accepted(checked).collect()] == [("2023-12-31", "15")]


def test_silver_is_plain_files_and_only_touched_hours_are_rewritten(spark, tmp_path):
    silver = str(tmp_path / "silver")

    def batch(*events):
        rows = [(name, "d", "s", "1.0", at, str(v), at[:10], at[11:13]) for name, at, v in events]
        return spark.createDataFrame(rows, "event_id string, domain string, dataset string, schema_version string, event_time string, payload string, dt string, hour string")

    def folders():
        newest = sorted((tmp_path / "silver" / "manifests").glob("v*.json"))[-1]
        return json.loads(newest.read_text())["partitions"]

    first = batch(("a", "2024-01-01T01:00:00", 1), ("b", "2024-01-01T02:00:00", 2), ("c", "2024-01-02T03:00:00", 3))
    compact_into(first, silver, "q-0")
    compact_into(first, silver, "q-0")  # the same batch again
    before = folders()
    compact_into(batch(("a", "2024-01-03T00:00:00", 9), ("b", "2023-12-31T00:00:00", 0)), silver, "q-1")
    after = folders()
    assert {row["event_id"]: row["payload"] for row in read_compacted(spark, silver).collect()} == {"a": "9", "b": "2", "c": "3"}
    assert "dt=2024-01-01/hour=01" not in after and after["dt=2024-01-02/hour=03"] == before["dt=2024-01-02/hour=03"]
    assert {row["event_id"] for row in read_compacted(spark, silver, since="2024-01-02").collect()} == {"a", "c"}
    plan = read_compacted(spark, silver)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    assert read_compacted(spark, str(tmp_path / "none")).count() == 0


def silver_batch(spark, *events):
    rows = [(name, "d", "s", "1.0", at, str(v), at[:10], at[11:13]) for name, at, v in events]
    return spark.createDataFrame(rows, "event_id string, domain string, dataset string, schema_version string, event_time string, payload string, dt string, hour string")


def test_compaction_opens_only_hours_that_may_hold_its_events(spark, tmp_path):
    silver = str(tmp_path / "silver")
    hours = [f"2024-01-{day:02d}T{hour:02d}:00:00" for day in (1, 2, 3) for hour in range(0, 24, 3)]
    first = [(f"{at}-{number}", at, number) for at in hours for number in range(40)]
    assert compact_into(silver_batch(spark, *first), silver, "q-0")["opened"] == []
    # hours that no filter names are not read: their files may even be away
    away = tmp_path / "silver" / "data" / "q-0" / "_dt=2024-01-03"
    away.rename(tmp_path / "elsewhere")
    did = compact_into(silver_batch(spark, ("2024-01-01T03:00:00-7", "2024-01-04T01:00:00", "later"), ("new", "2024-01-04T02:00:00", "new")), silver, "q-1")
    assert did == {"opened": ["dt=2024-01-01/hour=03"], "written": ["dt=2024-01-01/hour=03", "dt=2024-01-04/hour=01", "dt=2024-01-04/hour=02"]}
    # the moved event is known in its new hour and no longer in its old one
    did = compact_into(silver_batch(spark, ("2024-01-01T03:00:00-7", "2024-01-05T00:00:00", "last")), silver, "q-2")
    assert did["opened"] == ["dt=2024-01-04/hour=01"] and "dt=2024-01-01/hour=03" not in did["written"]
    (tmp_path / "elsewhere").rename(away)
    got = {row["event_id"]: row["payload"] for row in read_compacted(spark, silver).collect()}
    assert got == {name: str(v) for name, _, v in first} | {"2024-01-01T03:00:00-7": "last", "new": "new"}
    assert list((tmp_path / "silver" / "incoming").iterdir()) == []


def test_filters_of_many_runs_are_joined_and_false_hits_do_no_harm(spark, tmp_path, monkeypatch):
    from sparkbi.streaming import compaction, key_index

    monkeypatch.setattr(compaction, "MOST_FILTER_RUNS", 2)
    monkeypatch.setattr(key_index, "BITS_PER_KEY", 1)  # nearly every filter says yes
    silver, want, opened = str(tmp_path / "silver"), {}, 0
    for run in range(6):
        events = [(f"e{(run * 17 + step) % 60}", f"2024-01-0{1 + (run * step) % 9}T{step % 24:02d}:{run:02d}:00", f"{run}-{step}") for step in range(25)]
        did = compact_into(silver_batch(spark, *events), silver, f"q-{run}")
        opened += len(did["opened"])
        for name, at, v in events:
            want[name] = max(want.get(name, ("", "")), (at, v))
        assert {row["event_id"]: (row["event_time"], row["payload"]) for row in read_compacted(spark, silver).collect()} == want
    sealed = json.loads(sorted((tmp_path / "silver" / "manifests").glob("v*.json"))[-1].read_text())
    assert set(sealed["filters"]) == set(sealed["partitions"]) and len({run for run, _ in sealed["filters"].values()}) <= 3 and opened


def test_silver_written_before_there_were_filters(spark, tmp_path):
    silver = str(tmp_path / "silver")
    compact_into(silver_batch(spark, ("a", "2024-01-01T01:00:00", 1), ("b", "2024-01-02T01:00:00", 2)), silver, "q-0")
    old = next((tmp_path / "silver" / "manifests").glob("v*.json"))
    sealed = json.loads(old.read_text())
    del sealed["filters"]
    old.write_text(json.dumps(sealed))
    (old.parent / f".{old.name}.crc").unlink()
    did = compact_into(silver_batch(spark, ("b", "2024-01-03T01:00:00", 3)), silver, "q-1")
    assert did["opened"] == ["dt=2024-01-01/hour=01", "dt=2024-01-02/hour=01"]
    assert {row["event_id"]: row["payload"] for row in read_compacted(spark, silver).collect()} == {"a": "1", "b": "3"}


def test_filters_miss_nothing_and_name_little_in_vain(spark):
    from sparkbi.streaming.key_index import build_filters, may_hold, sizes

    events = spark.range(60_000).select(F.concat(F.lit("event-"), "id").alias("event_id"), F.lit("2024-01-01").alias("dt"), (F.col("id") % 7 * F.col("id") % 5).cast("string").alias("hour"))
    chosen = sizes(events.groupBy("dt", "hour").agg(F.count(F.lit(1)).alias("events")))
    size = F.element_at(F.create_map(*[F.lit(x) for (_, hour), n in chosen.items() for x in (hour, n)]), F.col("hour"))
    filters = build_filters(events, size)
    assert may_hold(events, filters, sorted(set(chosen.values()))).join(events, ["event_id", "dt", "hour"]).count() == 60_000
    others = spark.range(60_000, 160_000).select(F.concat(F.lit("event-"), "id").alias("event_id"))
    assert may_hold(others, filters, sorted(set(chosen.values()))).count() < 20


def test_current_version_is_what_the_manifest_lists(spark, tmp_path):
    root = str(tmp_path)
    sealed = publish(spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "k string, v double"), root, "d")
    folder = tmp_path / "d" / sealed["data"]
    spark.createDataFrame([("stray", 2.0)], "k string, v double").coalesce(1).write.parquet(str(tmp_path / "stray"))
    (next((tmp_path / "stray").glob("part-*.parquet"))).rename(folder / "part-stray.parquet")
    assert sorted(row["k"] for row in read_current(spark, root, "d").collect()) == ["a", "b"]
    runs = len(list((tmp_path / "d" / "data").iterdir()))
    assert sync_named(read_current(spark, root, "d"), root, "d", "api")["version_number"] == 1
    assert len(list((tmp_path / "d" / "data").iterdir())) == runs


def test_compaction_does_not_depend_on_order(spark, partitions):
    rows = [(f"e{i % 5}" if i % 3 else "hot", f"2024-01-{1 + i % 9:02d}", i) for i in range(300)]
    forward = spark.createDataFrame(rows, "event_id string, event_time string, v int")
    backward = spark.createDataFrame(rows[::-1], forward.schema).repartition(7)
    assert sorted(compact_batch(forward).collect()) == sorted(compact_batch(backward).collect())
    assert compact_batch(forward).count() == 6


def test_newest_copy_wins_in_a_stream(spark, tmp_path):
    told = str(tmp_path / "told")

    def run(name, *events):
        """One run from the checkpoint; what it told and how many events are in its state."""
        before = {tuple(row) for row in spark.read.parquet(told).collect()} if os.path.isdir(told) else set()
        drop(tmp_path / "in", name, [event(*e[:2], value=e[2]) for e in events])
        stream = newest_wins(accepted(validate(spark.readStream.text(str(tmp_path / "in")))), delay="1 day")
        with rocksdb_state(spark):
            query = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(told)
            query.awaitTermination()
        new = [row for row in spark.read.parquet(told).collect() if tuple(row) not in before]
        return {row["event_id"]: (json.loads(row["payload"])["v"], row["revision"]) for row in new}, query.lastProgress["stateOperators"][0]["numRowsTotal"]

    at = "2024-01-{:02d}T{:02d}:00:00".format
    assert run("a.json", ("x", at(1, 3), 1), ("x", at(1, 5), 2), ("x", at(1, 4), 3), ("y", at(1, 9), 4))[0] == {"x": (2, 1), "y": (4, 1)}
    # a restart: an older copy says nothing, a newer one corrects
    assert run("b.json", ("x", at(1, 2), 5), ("y", at(1, 10), 6), ("z", at(1, 11), 7))[0] == {"y": (6, 2), "z": (7, 1)}
    full = run("c.json", ("w", at(9, 0), 8))
    assert full[0] == {"w": (8, 1)}
    # the watermark has passed x, y and z: their state is gone, a newer copy still corrects and an old one is dropped
    again = run("d.json", ("x", at(9, 1), 9), ("y", at(1, 8), 10))
    assert again[0] == {"x": (9, 1)} and again[1] <= 2 * 4
    got = {row["event_id"]: json.loads(row["payload"])["v"] for row in latest(spark.read.parquet(told)).collect()}
    assert got == {"x": 9, "y": 6, "z": 7, "w": 8}


def test_first_copy_wins_in_a_stream(spark, tmp_path):
    drop(tmp_path / "in", "a.json", [event("x", value=1)])
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    stream = first_wins(accepted(validate(raw)).withColumn("t", F.col("event_time").cast("timestamp")), "t")

    def run():
        query = stream.writeStream.format("json").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        query.start(str(tmp_path / "out")).awaitTermination()

    run()
    drop(tmp_path / "in", "b.json", [event("x", value=2), event("y", value=5)])
    run()
    got = {row["event_id"]: json.loads(row["payload"])["v"] for row in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {"x": 1, "y": 5}


def test_newest_copy_takes_few_calls_for_a_key():
    """Each call on the state or the timers is a round trip, so a new key takes three and a newer copy four."""
    from unittest.mock import MagicMock

    from sparkbi.streaming.newest import NewestCopy

    handle, taken = MagicMock(), NewestCopy(["v"])
    taken.init(handle)
    state = handle.getValueState.return_value
    row = lambda micros, v: {"_micros": micros, "_written": "w", "_content": 1, "v": v}
    state.get.return_value = None
    assert [(r.v, r.revision) for r in taken.handleInputRows(1, iter([row(5000, 1), row(7000, 2)]), None)] == [(2, 1)]
    assert len(state.method_calls) == 2 and [call[0] for call in handle.method_calls[1:] if "getValueState" not in call[0]] == ["registerTimer"]
    state.reset_mock(), handle.reset_mock()
    state.get.return_value = (7000, "w", 1, 1)
    assert [(r.v, r.revision) for r in taken.handleInputRows(1, iter([row(9000, 3)]), None)] == [(3, 2)]
    assert [(call[0], call[1]) for call in handle.method_calls if "Timer" in call[0]] == [("deleteTimer", (8,)), ("registerTimer", (10,))]
    assert not list(taken.handleInputRows(1, iter([row(6000, 4)]), None))


def test_a_bucket_takes_as_few_calls_as_an_event():
    """All events of a bucket are read, told and kept together, and go when the watermark has passed their minute."""
    from unittest.mock import MagicMock

    from sparkbi.streaming.newest import NewestCopies

    handle, taken = MagicMock(), NewestCopies(["id", "v"], "id")
    taken.init(handle)
    state, kept = handle.getValueState.return_value, []
    state.update.side_effect = kept.append
    state.get.side_effect = lambda: kept[-1] if kept else None
    minute = 60_000_000
    row = lambda event, micros, v: {"id": event, "_micros": micros, "_written": "w", "_content": 1, "v": v}
    calls = lambda: [call[0] for call in state.method_calls] + [call[0] for call in handle.method_calls if "Timer" in call[0]]
    first = [row(event, (event + 1) * minute + copy, copy) for copy in (1, 0) for event in range(1000)]
    assert [(r.id, r.v, r.revision) for r in taken.handleInputRows(1, iter(first), None)] == [(event, 1, 1) for event in range(1000)]
    assert calls() == ["get", "update", "registerTimer"] and handle.registerTimer.call_args[0] == (2 * 60_000,)
    state.reset_mock(), handle.reset_mock()
    second = [row(3, 0, 7), row(5, 9 * minute, 8), row(1000, minute // 2, 9), row(7, 8 * minute + 1, 1)]
    assert [(r.id, r.v, r.revision) for r in taken.handleInputRows(1, iter(second), None)] == [(5, 8, 2), (1000, 9, 1)]
    assert calls() == ["get", "update", "deleteTimer", "registerTimer"] and handle.registerTimer.call_args[0] == (60_000,)
    timers = MagicMock()
    timers.getCurrentWatermarkInMs.return_value = 999 * 60_000
    assert not list(taken.handleExpiredTimer(1, timers, None)) and handle.registerTimer.call_args[0] == (1000 * 60_000,)
    assert not list(taken.handleInputRows(1, iter([row(998, 999 * minute, 2)]), None))
    assert [r.revision for r in taken.handleInputRows(1, iter([row(998, 999 * minute + 5, 2), row(0, 1000 * minute, 2)]), None)] == [2, 1]
    timers.getCurrentWatermarkInMs.return_value = 2000 * 60_000
    assert not list(taken.handleExpiredTimer(1, timers, None)) and state.clear.called
