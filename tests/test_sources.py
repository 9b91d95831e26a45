import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rungs.sources import ingest, schemas, tables
from rungs.streaming import incremental, streams

NOW = dt.datetime(2024, 1, 10)


def landed(spark, tmp_path, name, payloads, schema):
    p = tmp_path / name
    p.mkdir()
    (p / "a.json").write_text("\n".join(json.dumps(x) for x in payloads))
    return ingest.read_json(spark, str(p), schema)


def player(i, rank, rating, faction="HORDE", realm="area-52"):
    return {"character": {"id": i, "name": f"P{i}", "realm": {"slug": realm}}, "faction": {"type": faction}, "rank": rank, "rating": rating, "season_match_statistics": {"won": 3, "lost": 1}}


def ladder(bracket, entries, at="2024-01-10T00:00:00Z", region="us"):
    return {"season_id": 40, "bracket": bracket, "region": region, "fetched_at": at, "entries": entries}


def test_leaderboard(spark, tmp_path):
    many = [player(i, i, 3000 - i) for i in range(1, 503)]
    p = landed(spark, tmp_path, "l", [ladder("shuffle-death-knight-frost", many), ladder("2v2", [player(1, 2, 3000), player(1, 1, 3100), player(2, 3, None, "NEUTRAL")])], schemas.LADDER)
    rows = ingest.leaderboard(p).collect()
    solo = [r for r in rows if r.bracket != "2v2"]
    assert len(solo) == 500 and {(r.class_slug, r.spec_slug, r.faction) for r in solo} == {("death_knight", "frost", 1)}
    assert sorted((r.character_id, r["rank"], r.wins, r.losses, r.faction) for r in rows if r.bracket == "2v2") == [(1, 1, 3, 1, 1), (2, 3, 3, 1, None)]


def item(slot, i, level, **more):
    return {"item": {"id": i}, "slot": {"type": slot}, "level": {"value": level}, "item_class": {"name": "Armor"}, "inventory_type": {"type": slot}, "quality": {"type": "EPIC"}} | more


GEAR = {
    "character_id": 1, "spec_id": 71,
    "equipped_items": [
        item("HEAD", 10, 601, context="12", bonus_list=[3, 1], enchantments=[{"display_string": "temp", "enchantment_id": 5, "enchantment_slot": {"type": "TEMPORARY"}}, {"display_string": "Enchanted: Chant |A:x:20|a", "enchantment_id": 7, "enchantment_slot": {"type": "PERMANENT"}, "source_item": {"id": 99}}],
             sockets=[{"socket_type": {"type": "RED"}, "item": {"id": 55, "name": "Ruby"}, "display_string": "+5"}, {"socket_type": {"type": "RED"}}], modified_crafting_stat=[{"type": "HASTE"}],
             stats=[{"type": {"type": "HASTE_RATING"}, "value": 50}, {"type": {"type": "STAMINA"}, "value": 9}, {"type": {"type": "CRIT_RATING"}, "value": 7, "is_negated": True}],
             set={"item_set": {"id": 3, "name": "Tier"}, "items": [{"is_equipped": True}] * 4 + [{"is_equipped": False}], "effects": [{"required_count": 2, "is_active": True}, {"required_count": 4, "is_active": True}]}),
        item("NECK", 11, 600, context="odd"), item("TABARD", 12, 1), item("FEET", 13, 0),
    ],
}


def test_equipment(spark, tmp_path):
    p = landed(spark, tmp_path, "e", [GEAR, {"character_id": 2, "spec_id": 71, "equipped_items": []}, {"character_id": 3, "spec_id": None, "equipped_items": None}], schemas.EQUIPMENT)
    rows = {r.slot: r for r in ingest.equipment(p).collect()}
    assert set(rows) == {"HEAD", "NECK"}
    h = rows["HEAD"]
    assert (h.item_id, h.item_level, h.context, h.bonus_list, h.enchantment_id, h.enchant_name, h.enchant_source, h.crafting_stats, h.stats) == (10, 601, 12, [1, 3], 7, "Chant", 99, ["HASTE"], {"haste": 50})
    assert [tuple(s) for s in h.sockets] == [("RED", 55, "+5"), ("RED", None, None)]
    assert (rows["NECK"].context, rows["NECK"].sockets, rows["NECK"].stats) == (None, [], {})
    dims, enchants = ingest.item_dims(p)
    assert sorted((r.item_id, r.quality) for r in dims.collect()) == [(10, "epic"), (11, "epic"), (55, None), (99, None)]
    assert sorted(tuple(r) for r in enchants.collect()) == [(5, "temp", None), (7, "Chant", 99)]
    gear = {r.character_id: tuple(r)[1:] for r in ingest.gear_summary(p).collect()}
    assert gear[1] == (600, 3, "Tier", 4, True)  # (601 + 600) / 2, cut
    assert gear[2] == (None, None, None, None, None)


def pick(i, rank=1):
    return {"rank": rank, "tooltip": {"talent": {"id": i, "name": f"t{i}"}}}


def test_specializations(spark, tmp_path):
    spec = {"specialization": {"id": 71}, "loadouts": [{"is_active": False, "talent_loadout_code": "no"}, {"is_active": True, "talent_loadout_code": "yes", "selected_class_talents": [pick(1, 2)], "selected_spec_talents": [pick(2)], "selected_hero_talents": [{"rank": 1}], "selected_hero_talent_tree": {"id": 8, "name": "H"}}],
            "pvp_talent_slots": [{"selected": {"talent": {"id": 20}}}, {"selected": {"talent": {"id": 21}}}]}
    other = {"specialization": {"id": 72}, "loadouts": [{"is_active": False}]}
    talents, loadouts = ingest.specializations(landed(spark, tmp_path, "s", [{"character_id": 1, "specializations": [spec, other]}, {"character_id": 2, "specializations": None}], schemas.SPECIALIZATIONS))
    assert sorted((r.talent_type, r.talent_id, r["rank"], r.slot_number) for r in talents.collect()) == [("class", 1, 2, None), ("pvp", 20, 1, 2), ("pvp", 21, 1, 3), ("spec", 2, 1, None)]
    assert [tuple(r) for r in loadouts.collect()] == [(1, 71, "yes", 8, "H")]


def test_trees(spark, tmp_path):
    tip = lambda i: {"talent": {"id": i, "name": f"t{i}"}, "spell_tooltip": {"spell": {"id": i + 100}}}
    tree = {"spec_id": 71, "class_talent_nodes": [{"id": 1, "display_row": 2, "display_col": 3, "ranks": [{"tooltip": tip(5)}]}], "spec_talent_nodes": [{"id": 2, "locked_by": [1, 9], "ranks": [{"choice_of_tooltips": [tip(6), tip(7)]}]}],
            "hero_talent_trees": [{"id": 1, "nodes": [{"id": 3, "locked_by": [{"id": 2}], "ranks": [{"tooltip": tip(8)}]}]}]}
    talents, edges = ingest.trees(landed(spark, tmp_path, "t", [tree], schemas.TREES))
    assert sorted((r.talent_type, r.node_id, r.talent_id, r.spell_id) for r in talents.collect()) == [("class", 1, 5, 105), ("hero", 3, 8, 108), ("spec", 2, 6, 106), ("spec", 2, 7, 107)]
    assert sorted(tuple(r) for r in edges.collect()) == [(2, 1), (2, 9), (3, 2)]


def test_seasons_media_profiles(spark, tmp_path):
    s = landed(spark, tmp_path, "s", [{"season_id": 39, "season_name": "a", "season_start_timestamp": 1700000000999, "season_end_timestamp": None}, {"season_id": 40, "season_name": "b"}], schemas.SEASON)
    got = {r.season_id: (r.is_current, r.starts_at) for r in ingest.seasons(s).collect()}
    assert got == {39: (False, dt.datetime(2023, 11, 14, 22, 13, 20)), 40: (True, None)}
    m = landed(spark, tmp_path, "m", [{"id": 1, "assets": [{"key": "avatar", "value": "u"}, {"key": "main-raw", "value": "v"}, {"key": "avatar", "value": "w"}]}, {"id": 2}], schemas.MEDIA)
    assert sorted((r.id, r.avatar, r.main_raw, r.icon) for r in ingest.media(m).collect()) == [(1, "u", "v", None), (2, None, None, None)]
    p = landed(spark, tmp_path, "p", [{"id": 1, "name": "A", "realm": {"slug": "r"}, "character_class": {"id": 6, "name": "Death Knight"}, "faction": {"type": "ALLIANCE"}}], schemas.PROFILE)
    assert tuple(ingest.profiles(p).first())[-2:] == ("death_knight", 0)


def test_upserts_and_slices(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, v string, n int")
    u = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert sorted(map(tuple, tables.upsert(t, u, ["k"]).collect())) == [(1, "a", 1), (2, None, 2), (3, "c", None)]
    assert sorted(map(tuple, tables.upsert(t, u, ["k"], []).collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", None)]
    nulls = spark.createDataFrame([(None, "n", 5)], t.schema)
    once = tables.upsert(t, nulls, ["k"])
    assert sorted(map(str, tables.upsert(once, nulls, ["k"]).collect())) == sorted(map(str, once.collect())) and once.count() == 3
    assert tables.insert_ignore(once, nulls, ["k"]).count() == 3 and tables.replace_slice(once, nulls.select("k"), nulls).count() == 3
    assert sorted(r.v for r in tables.insert_ignore(t, spark.createDataFrame([(2, "x"), (4, "y")], "k long, v string"), ["k"]).collect()) == ["a", "b", "y"]
    assert sorted(map(tuple, tables.replace_slice(t, t.where("k = 1").select("k"), spark.createDataFrame([(1, "z", 9)], t.schema)).collect())) == [(1, "z", 9), (2, "b", 2)]
    got = {r.k: (r.v, r.changed) for r in tables.update_from(t, u, "k").collect()}
    assert got == {1: ("a", False), 2: (None, True)}
    g = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "g string, k long")
    assert sorted(map(tuple, tables.replace_groups(g, spark.createDataFrame([("x", 5)], g.schema), ["g"], ["k"]).collect())) == [("x", 5), ("y", 3)]
    assert tables.replace_groups(g, g.limit(0), ["g"], ["k"]).count() == 3


def test_publishing_moves_the_pointer_last(spark, tmp_path):
    path = str(tmp_path / "meta")
    good = spark.createDataFrame([(1,)], "v int")
    assert tables.live_cycle(spark, path) is None and tables.published(spark, path, "items") is None
    assert tables.publish({"items": good, "gems": good}, path, 1) is None
    broken = good.select(F.raise_error(F.lit("no")).cast("int").alias("v"))
    with pytest.raises(Exception, match="no"):
        tables.publish({"items": good, "gems": broken}, path, 2)
    assert tables.live_cycle(spark, path) == 1 and spark.read.parquet(f"{path}/items/cycle_id=2").count() == 0
    assert tables.publish({"items": good, "gems": good}, path, 3, keep_old=True) == 1
    assert tables.published(spark, path, "items").first().cycle_id == 3
    tables.rollback(spark, path, 1)
    assert tables.published(spark, path, "gems").first().cycle_id == 1
    tables.publish({"items": good, "gems": good}, path, 4)
    for gone in (1, 2, 9):  # purged, never whole, never there
        with pytest.raises(ValueError, match=f"cycle {gone}"):
            tables.rollback(spark, path, gone)
    with pytest.raises(ValueError, match="live"):
        tables.purge(spark, path, ["items"], 4)
    assert tables.live_cycle(spark, path) == 4 and tables.published(spark, path, "items").count() == 1
    tables.write_report(spark.createDataFrame([("EU/r/n",)], "line string"), f"{path}/report")
    assert spark.read.text(f"{path}/report").first().value == "EU/r/n"


ITEMS = "character_id long, spec_id int, slot string, item_id long, item_level int, enchantment_id long, crafting_stats array<string>"


def test_changes(spark):
    new = spark.createDataFrame([(1, 71, "HEAD", 5, 600, None, ["B", "A"]), (1, 71, "NECK", 6, 600, 7, []), (2, 71, "HEAD", 5, 601, None, [])], ITEMS)
    prints = incremental.item_fingerprints(new)
    assert prints.where("character_id = 1").first().fingerprint == "HEAD:5:600::A+B,NECK:6:600:7:"
    stored = spark.createDataFrame([(1, 71, "HEAD", 5, 600, None, []), (2, 71, "HEAD", 4, 500, None, []), (3, 71, "HEAD", 1, 1, None, [])], ITEMS)
    old = prints.where("character_id = 1").unionByName(spark.createDataFrame([(2, 71, "x")], prints.schema))
    rows, changed = incremental.changed_items(new, old, stored)
    assert sorted((r.character_id, r.item_level) for r in rows.collect()) == [(1, 600), (2, 601), (3, 1)]
    assert [r.character_id for r in changed.collect()] == [2]
    loadouts = spark.createDataFrame([(1, 71, "a"), (2, 71, "b"), (3, 71, "c")], "character_id long, spec_id int, loadout_code string")
    talents = spark.createDataFrame([(1, 71, 9), (2, 71, 9)], "character_id long, spec_id int, talent_id long")
    before = spark.createDataFrame([(1, 71, "a"), (2, 71, "old"), (3, 71, "old")], loadouts.schema)
    rows, codes = incremental.changed_loadouts(loadouts, talents, before, spark.createDataFrame([(2, 71, 1), (3, 71, 2)], talents.schema))
    assert sorted(map(tuple, rows.collect())) == [(2, 71, 9), (3, 71, 2)]
    assert [tuple(r) for r in codes.collect()] == [(2, 71, "b")]


def test_fetch_state_and_spec_updates(spark):
    e = spark.createDataFrame([(1, 10, NOW, 600), (2, 10, None, 700), (3, 11, None, 1)], "entry_id long, character_id long, equipment_at timestamp, item_level int")
    p = spark.createDataFrame([(10, True, None), (11, False, 650), (12, True, None)], "character_id long, not_modified boolean, item_level int")
    assert {r.character_id: r.item_level for r in incremental.fetched(p, e, "equipment_at", ["item_level"]).collect()} == {10: 600, 11: 650, 12: None}
    rows = spark.createDataFrame([(1, 10, 71, 5, "old", 1), (2, 10, 72, 5, "old", 2), (3, 10, None, None, None, None), (4, 11, 71, 5, "old", 1)], "entry_id long, character_id long, spec_id int, item_level int, code string, hero_tree_id long")
    u = spark.createDataFrame([(10, 71, {"71": 8, "72": 9}, 660, "new")], "character_id long, active_spec int, hero_trees map<string,long>, item_level int, code string")
    got = {r.entry_id: tuple(r)[2:] for r in incremental.spec_aware_update(rows, u, ["item_level"], ["code"]).collect()}
    assert got == {1: (71, 660, "new", 8), 2: (72, 5, "new", 9), 3: (71, 660, "new", 8), 4: (71, 5, "old", 1)}


def test_retries_retention_resets(spark):
    e = spark.createDataFrame([(1, None, NOW, 2), (2, NOW, None, 3), (3, NOW, NOW, 0), (4, None, None, None)], "entry_id long, equipment_at timestamp, talents_at timestamp, sync_retry_count int")
    assert {r.entry_id: (r.outcome, r.sync_retry_count) for r in incremental.split_retries(e).collect()} == {1: ("requeue", 3), 2: ("exhausted", 3), 4: ("requeue", 1)}
    old = spark.createDataFrame([(1, NOW - dt.timedelta(days=40), "done"), (2, NOW - dt.timedelta(days=40), "open"), (3, NOW, "done"), (4, None, "done")], "id long, at timestamp, status string")
    assert sorted(r.id for r in incremental.retain(old, "at", F.lit(NOW), 30, F.col("status") == "done").collect()) == [2, 3, 4]
    assert [r.equipment_at for r in incremental.reset(e, ["equipment_at"], F.col("entry_id") == 2).orderBy("entry_id").collect()] == [None, None, NOW, None]


def test_ladder_stream_keeps_the_newest_ladder(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    (src / "1.json").write_text(json.dumps(ladder("2v2", [player(1, 1, 3000), player(2, 2, 2900)])) + "\n" + json.dumps(ladder("3v3", [player(9, 1, 2000)])))
    streams.ladder_sink(streams.ladder_stream(spark, str(src)), out, cp).awaitTermination()
    (src / "2.json").write_text(json.dumps(ladder("2v2", [player(2, 1, 3050), player(3, 2, 2950)], "2024-01-10T06:00:00Z")))
    streams.ladder_sink(streams.ladder_stream(spark, str(src)), out, cp).awaitTermination()
    (src / "3.json").write_text(json.dumps(ladder("3v3", [player(9, 2, 1990), player(8, 1, 2010)], "2024-01-10T07:00:00Z")))
    # a new checkpoint begins to count anew: what is stored is kept
    streams.ladder_sink(streams.ladder_stream(spark, str(src)), out, str(tmp_path / "cp2")).awaitTermination()
    got = sorted((r.bracket, r.character_id, r["rank"]) for r in streams.stored_ladders(spark, out).collect())
    assert got == [("2v2", 2, 1), ("2v2", 3, 2), ("3v3", 8, 1), ("3v3", 9, 2)]


def test_metric_stream(spark, tmp_path):
    rows = [(i, "a", NOW + dt.timedelta(minutes=20 * i), float(i), i % 2 == 0, None) for i in range(9)]
    spark.createDataFrame(rows, schemas.METRICS).coalesce(1).write.parquet(str(tmp_path / "m"))
    spark.createDataFrame([(99, "a", NOW + dt.timedelta(hours=9), 1.0, True, None)], schemas.METRICS).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    s = spark.readStream.schema(schemas.METRICS).parquet(str(tmp_path / "m"))
    streams.run_once(streams.job_windows(s), str(tmp_path / "w"), str(tmp_path / "wc")).awaitTermination()
    got = sorted((r.hour.hour, r.total, r.failed) for r in spark.read.parquet(str(tmp_path / "w")).collect())
    assert got == [(0, 3, 1), (1, 3, 2), (2, 3, 1)]


def test_milestone_stream_forgets_finished_cycles(spark, tmp_path):
    schema, at = "cycle_id long, at timestamp, done long, expected long", lambda h: NOW + dt.timedelta(hours=h)
    batches = [
        [(1, at(0), 10, 100), (1, at(0), 60, 100), (2, at(0), 80, 100), (3, at(0), 1, 0), (4, at(0), None, 9)],
        [(1, at(1), 55, 100), (1, at(1), 100, 100), (5, at(1), 30, 100)],
        [(5, at(30), 50, 100)],
        [(1, at(1), 100, 100), (2, at(31), 90, 100)],  # late: cycle 1 doesn't begin again
    ]
    found, states = [], []
    with streams.rocksdb_state(spark):
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
            q = streams.run_once(streams.milestone_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "p"))), str(tmp_path / "ms"), str(tmp_path / "msc"))
            q.awaitTermination()
            states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
            found.append(sorted(map(tuple, spark.read.parquet(str(tmp_path / "ms")).collect())))
    assert found[0] == [(1, 25), (1, 50), (2, 25), (2, 50), (2, 75)]
    assert found[1] == sorted(found[0] + [(1, 75), (5, 25)])
    assert found[2] == found[3] == sorted(found[1] + [(5, 50)])
    assert states == [4, 5, 4, 4]  # cycle 1 has gone


def test_upsert_leaves_untouched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.stored(spark, path) is None
    tables.upsert_stored(path, spark.createDataFrame([(i, i, "a") for i in range(200)] + [(None, -1, "n")], "k long, v long, w string"), ["k"], buckets=8)
    files = lambda: {f.parent.name: f.name for f in (tmp_path / "t").glob("*/part-*")}
    before = files()
    assert len(before) == 8
    tables.upsert_stored(path, spark.createDataFrame([(7, 70), (None, 5)], "k long, v long"), ["k"], buckets=99)
    after = files()
    assert sorted(after) == sorted(before) and sum(before[b] != after[b] for b in before) <= 2
    tables.upsert_stored(path, spark.createDataFrame([(1000, 1, "z"), (7, 71, "z")], "k long, v long, w string"), ["k"], ["v"])
    got = {r.k: (r.v, r.w) for r in tables.stored(spark, path).collect()}
    assert len(got) == 202 and got[7] == (71, "a") and got[None] == (5, "n") and got[1000] == (1, "z") and got[8] == (8, "a")


def test_null_groups_are_replaced(spark):
    schema = "g string, k int, v int"
    old = spark.createDataFrame([("a", 1, 1), (None, 1, 1), (None, None, 1), ("b", 1, 1)], schema)
    new = spark.createDataFrame([(None, 1, 2), ("a", None, 2)], schema)
    once = tables.replace_groups(old, new, ["g"], ["k"])
    want = [("a", None, 2), ("b", 1, 1), (None, 1, 2)]
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, tables.replace_groups(once, new, ["g"], ["k"]).collect()), key=repr) == sorted(want, key=repr)
    changed = tables.update_from(old.select("g", "v"), spark.createDataFrame([(None, 9)], "g string, v int"), "g")
    assert sorted(map(tuple, changed.collect()), key=repr) == sorted([("a", 1, False), ("b", 1, False), (None, 9, True), (None, 9, True)], key=repr)


def test_two_publishers_come_one_after_the_other(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    seen = tables._log(spark, path)
    tables._note(spark, path, 9, "live")
    real = tables._log
    monkeypatch.setattr(tables, "_log", lambda *a: seen)  # the second has looked before the first wrote
    tables._note(spark, path, 5, "live")
    monkeypatch.setattr(tables, "_log", real)
    assert real(spark, path) == [(1, 9, "live"), (2, 5, "live")] and tables.live_cycle(spark, path) == 5


def test_frame_that_fails_half_written_is_emptied(spark, tmp_path):
    path = str(tmp_path / "p")
    good = spark.range(3)
    bad = spark.range(3).selectExpr("id", "raise_error('no') AS x")
    with pytest.raises(Exception, match="no"):
        tables.publish({"good": good, "bad": bad}, path, 1)
    assert spark.read.parquet(f"{path}/good/cycle_id=1").count() == 0 and tables.live_cycle(spark, path) is None
    tables.publish({"good": good}, path, 1)
    assert tables.published(spark, path, "good").count() == 3
