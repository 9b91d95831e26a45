"""Stored ladders and name pieces, medians by spans, components in one pass, and rejected payloads."""

import json
import random
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rungs.operators import dims, ladder, ladder_store, name_index, spec_stats, tiers
from rungs.sources import ingest, schemas

ENTRY = "entry_id long, bracket string, region string, spec_id int, name string, rank int, rating double, wins long, losses long"


def ladders(spark, n=60):
    rows = [(b * 1000 + i, f"b{b}", ("us", "eu")[i % 2], i % 3, f"P{i}", i // 2 + 1, 3000.0 - i, i % 7, i % 5) for b in (1, 2) for i in range(n)]
    return spark.createDataFrame(rows + [(5000, "b1", "us", None, None, None, None, 0, 0)], ENTRY)


@pytest.mark.parametrize("filters", [{}, {"region": "us"}, {"spec_id": 1, "region": ["us", "eu"]}, {"rating_min": 2960, "name": "p1"}, {"min_winrate": 0.5}, {"region": "nowhere"}])
def test_stored_pages_are_the_pages(spark, tmp_path, filters):
    e, path = ladders(spark), str(tmp_path)
    ladder_store.store_ladders(e, path, width=4)
    for page in (1, 2, 3, 9, 50):
        want = ladder.ladder_page(e, "b1", page, 7, **filters).collect()
        got = ladder_store.stored_page(spark, path, "b1", page, 7, **filters)
        assert [r.asDict() for r in got.collect()] == [r.asDict() for r in want], (filters, page)


def test_only_the_ranges_of_a_page_are_read(spark, tmp_path):
    ladder_store.store_ladders(ladders(spark), str(tmp_path), width=4)
    want = [r.entry_id for r in ladder.ladder_page(ladders(spark), "b2", 3, 10).collect()]
    for f in Path(tmp_path, "rows").rglob("*.parquet"):  # ranks 11 to 15 are in ranges 2 and 3
        if not ("bracket=b2" in str(f) and f.parent.name in ("rank_range=2", "rank_range=3")):
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
            f.write_bytes(b"")
    assert [r.entry_id for r in ladder_store.stored_page(spark, str(tmp_path), "b2", 3, 10).collect()] == want


def test_ranges_are_bounded_and_empty_ladders_have_no_pages(spark, tmp_path):
    deep = ladders(spark).withColumn("rank", F.col("rank") * 1_000_000)
    ladder_store.store_ladders(deep, f"{tmp_path}/deep")
    assert ladder_store.stored_ladders(spark, f"{tmp_path}/deep").select("rank_range").distinct().count() <= ladder_store.RANGES
    ladder_store.store_ladders(ladders(spark).limit(0), f"{tmp_path}/none")
    assert ladder_store.stored_page(spark, f"{tmp_path}/none", "b1").collect() == []


NAMES = ["Anna", "anna", "ANNABEL", "Hannah", "a", "an", "aaa", "a_b", "a%b", "a\\b", "İlker", "ΣΑΣ", "naïve", "", None, "日本語テスト", "x" * 5000 + "anna"]


@pytest.mark.parametrize("text", ["anna", "AN", "a", "_", "%", "\\", "a_b", "aaaa", "aaa", "nab", "lker", "σα", "語テス", "語", "xxxxx", "", "\x00", "zzz"])
def test_names_by_their_pieces_are_those_of_ilike(spark, tmp_path, text):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES + NAMES[:3])], "id int, name string")
    name_index.store_names(rows, str(tmp_path), buckets=5)
    want = sorted(r.id for r in ladder.name_contains(rows, text).collect())
    assert sorted(r.id for r in name_index.search(spark, str(tmp_path), text).collect()) == want


def test_names_of_an_empty_table_and_of_nulls(spark, tmp_path):
    for k, rows in enumerate(([], [(1, None), (2, "")])):
        name_index.store_names(spark.createDataFrame(rows, "id int, name string"), f"{tmp_path}/{k}")
        assert [[r.id for r in name_index.search(spark, f"{tmp_path}/{k}", x).collect()] for x in ("anna", "a", "")] == [[], [], [r[0] for r in rows if r[1] == ""]]


@pytest.mark.parametrize("parts", [2, 3, 4096])
def test_medians_are_exact(spark, parts):
    r = random.Random(3)
    groups = {"ints": [r.randint(-9, 9) for _ in range(41)], "even": [1, 2, 3, 100], "same": [5] * 6, "one": [7], "wide": [-1.7e308, 1.7e308, 1.6e308, -1.6e308], "tiny": [5e-324, 1e-323, 0.0], "many": [r.gauss(0, 1e6) for _ in range(300)], None: [3, 4], "skewed": [0] * 3 + [10**15 + i for i in range(5)]}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("void", None), ("one", None)], "g string, v double")
    got = {x.g: x.median for x in spec_stats.medians(rows, ["g"], "v", parts).collect()}
    halved = lambda vs: sorted(vs)[(len(vs) - 1) // 2] / 2 + sorted(vs)[len(vs) // 2] / 2
    assert got == {g: statistics.median(vs) if g != "wide" else halved(vs) for g, vs in groups.items() if g != "tiny"} | {"tiny": halved(groups["tiny"])}


def test_components_in_one_pass_and_by_rounds_agree(spark, monkeypatch):
    r = random.Random(5)
    nodes = [(g, i) for g in ("a", "b", None) for i in range(40)]
    links = [(g, r.randrange(40), r.randrange(40)) for g in ("a", "b", None) for _ in range(25)] + [("b", i, i + 1) for i in range(20)]
    n, e = spark.createDataFrame(nodes, "g string, node_id long"), spark.createDataFrame(links, "g string, a long, b long")
    rows_of = lambda df: sorted((str(x.g), x.node_id, x.component) for x in df.collect())
    once = rows_of(tiers.components(n, e, ["g"], few=True))
    reach = {(g, i): {i} for g, i in nodes}
    for _ in range(40):
        for g, a, b in links:
            reach[g, a] = reach[g, b] = reach[g, a] | reach[g, b]
            for i in list(reach[g, a]):
                reach[g, i] |= reach[g, a]
    assert once == sorted((str(g), i, min(reach[g, i])) for g, i in nodes)
    for few in (30, 0):  # the group of 45 links by rounds, and then all
        monkeypatch.setattr(tiers, "FEW", few)
        assert rows_of(tiers.components(n, e, ["g"])) == once


def test_payloads_are_read_or_rejected(spark, tmp_path):
    lines = ['{"season_id": 1, "season_name": "s", "new": {"x": 1}}', '{"season_id": 2', '{"season_id": "two"}', '{"season_name": "s"}', '{"season_id": null}', "[1]", "7", "null", "", "   ", "\t", '{"season_id": 3}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    good, bad = ingest.read_payloads(spark, str(tmp_path), schemas.SEASON, ("season_id",))
    assert good.columns == spark.createDataFrame([], schemas.SEASON).columns and sorted(r.season_id for r in good.collect()) == [1, 3]
    assert sorted((r.reason, r.payload) for r in bad.collect()) == sorted([("no JSON object", x) for x in (lines[1], "[1]", "7", "null")] + [("wrong type", lines[2]), ("without season_id", lines[3]), ("without season_id", lines[4])])
    assert {r.file.rsplit("/")[-1] for r in bad.collect()} == {"a.json"}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "b.json").write_text("")
    assert [x.count() for x in ingest.read_payloads(spark, str(tmp_path / "none"), schemas.SEASON)] == [0, 0]
    whole = json.dumps({"season_id": 9, "season_name": "x" * 3_000_000})
    (tmp_path / "none" / "c.json").write_text(whole)
    assert [x.count() for x in ingest.read_payloads(spark, str(tmp_path / "none"), schemas.SEASON, ("season_id",))] == [1, 0]


def test_rows_without_a_node_keep_what_they_have(spark):
    t = spark.createDataFrame([(i, None, "spec", 2) for i in range(5)] + [(10, 1, "hero", 1), (11, 1, "spec", 1)], "talent_id long, node_id long, talent_type string, max_rank int")
    assert {r.talent_id: r.talent_type for r in dims.gateway_repair(t).collect()} == dict.fromkeys(range(5), "spec") | {10: "hero", 11: "hero"}
    assert {r.talent_id: r.max_rank for r in dims.variant_max_rank(t).collect()} == dict.fromkeys(range(7 - 2), 2) | {10: 2, 11: 2}
