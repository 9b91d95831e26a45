import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungs.functions import exprs as X
from rungs.functions.catalog import catalog
from rungs.operators import builds, cohort, dims, health, ladder, popularity, read_models, spec_stats, strength, talents, tiers

ENTRY = "entry_id long, character_id long, bracket string, region string, spec_id int, rating double, wins int, losses int, equipment_at timestamp, talents_at timestamp, snapshot_at timestamp"
NOW = dt.datetime(2024, 1, 10)


def entry(i, c, bracket="2v2", region="us", spec=71, rating=2000.0, wins=10, losses=5, eq=NOW, ta=NOW, at=NOW):
    return (i, c, bracket, region, spec, rating, wins, losses, eq, ta, at)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_scalars(spark):
    L = F.lit
    r = one(
        spark, half=X.pct(L(1), L(8), 1), none=X.pct(L(1), L(0)), full=X.pct(L(0), L(0), 1, 100.0), up=X.trend(L(2.1), L(1.0)), edge=X.trend(L(2.0), L(1.0)), down=X.trend(L(1.0), L(2.0)), new=X.trend(L(2.0), L(None).cast("double")),
        c1=X.confidence(L(100), L(0)), c2=X.confidence(L(30), L(5)), c3=X.confidence(L(29), L(0)), c4=X.confidence(L(100), L(6)), wr=X.winrate_pct(L(0), L(0)), s=X.player_score(L(2000.0), L(70), L(30)), s0=X.player_score(L(2000.0), L(0), L(0)),
        stat=X.parse_stat(L("|A +12 Critical Strike"), "crit"), nostat=X.parse_stat(L("x"), "crit"), en=X.clean_enchant_name(L("Enchanted: Chant of Wind |A:Professions-Icon:20:20|a")), html=X.strip_html(L("<p>a</p><br/>\n\n\n<b>b</b> ")), empty=X.strip_html(L("<p></p>")),
        url=X.host_rewrite(L("https://a.example/x/y?z=1"), "a.example", "https://cdn"), other=X.host_rewrite(L("https://b.example/x"), "a.example", "https://cdn"), i=X.normalise_id(L("12")), i0=X.normalise_id(L("1x")), bc=X.bracket_class(L("shuffle-death-knight-frost")),
        bs=X.bracket_spec(L("shuffle-death-knight-frost")), b0=X.bracket_class(L("2v2")), slug=X.slug(L(" Demon  Hunter ")), tree=X.tree_ids(L("https://x/data/talent-tree/786/playable-specialization/262?ns")), f=X.faction_code(L("HORDE")), p=X.progress_pct(L(1), L(0)), eta=X.eta_seconds(L(50), L(100), L(10)),
        eta0=X.eta_seconds(L(0), L(100), L(10)), e1=X.format_elapsed(L(59)), e2=X.format_elapsed(L(61)), e3=X.format_elapsed(L(3720)), n=X.display_name(L("bob"), L("area-52")), d=X.http_date(L("Wed, 01 Jan 2026 12:00:00 GMT")), d0=X.http_date(L(" ")),
        best=X.best_description(F.array(F.struct(L(1).alias("rank"), L("a").alias("description")), F.struct(L(3).alias("rank"), L(None).cast("string").alias("description")), F.struct(L(2).alias("rank"), L("b").alias("description")))),
    )
    assert (r.half, r.none, r.full) == (12.5, None, 100.0)
    assert (r.up, r.edge, r.down, r.new) == ("up", "stable", "stable", "new")
    assert (r.c1, r.c2, r.c3, r.c4) == ("high", "medium", "low", "low")
    assert (r.wr, r.s) == (0.0, 2060.0)
    assert r.s0 == 2000.0  # no games: least and greatest pass nulls over
    assert (r.stat, r.nostat, r.en) == (12, None, "Chant of Wind")
    assert (r.html, r.empty) == ("a\n\nb", None)
    assert (r.url, r.other, r.i, r.i0) == ("https://cdn/x/y", "https://b.example/x", 12, None)
    assert (r.bc, r.bs, r.b0, r.slug, tuple(r.tree), r.f) == ("death_knight", "frost", None, "demon_hunter", (786, 262), 1)
    assert (r.p, r.eta, r.eta0, r.e1, r.e2, r.e3) == (0, 10, None, "59s", "1m 1s", "1h 2m")
    assert (r.n, r.d, r.d0, r.best) == ("Bob-Area 52", dt.datetime(2026, 1, 1, 12), None, "b")


def test_best_entry_null_rating_ties_and_regions(spark):
    e = spark.createDataFrame([entry(1, 1), entry(2, 1, region="eu"), entry(3, 1, rating=None), entry(4, 2), entry(5, 2, rating=2000.0), entry(6, 3, spec=None), entry(7, 4, eq=None)], ENTRY)
    assert sorted(r.entry_id for r in cohort.best_entry(e, "equipment_at").collect()) == [3, 4]


def test_cohort_keeps_ties_at_the_cut_and_weighs_by_whole_size(spark):
    e = spark.createDataFrame([entry(i, i, rating=3000.0 - 100 * min(i, 3), wins=90, losses=10) for i in range(1, 6)] + [entry(9, 9, spec=72, wins=0, losses=0)], ENTRY)
    rows = {r.entry_id: r for r in cohort.top_cohort(e, None, 3, weighted=True).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 9}  # three share rank 3
    assert (rows[1].spec_total, rows[1].weight, rows[9].weight) == (5, 2, 1)  # 1 of 5 isn't within 15 %; no games, and alone: over half
    assert cohort.top_cohort(spark.createDataFrame([], ENTRY), None, 3, weighted=True).count() == 0


def test_gate_falls_back(spark):
    e = spark.createDataFrame([entry(i, i, wins=i, losses=0) for i in range(1, 13)], ENTRY)
    assert cohort.gated(e, F.col("wins") >= 3, 10).count() == 10
    assert cohort.gated(e, F.col("wins") >= 4, 10).count() == 12


def test_popularity_denominators(spark):
    c = cohort.top_cohort(spark.createDataFrame([entry(i, i) for i in (1, 2, 3)], ENTRY))
    sockets = spark.createDataFrame([(1, 71, "HEAD", "RED", 5), (1, 71, "HEAD", "RED", 5), (2, 71, "HEAD", "RED", None), (3, 71, "HEAD", "RED", 6), (3, 71, "NECK", "RED", 6)], "character_id long, spec_id int, slot string, socket_type string, gem_id long")
    got = {(r.slot, r.gem_id): (r.usage_count, r.total, r.usage_pct) for r in popularity.popularity(c, sockets, popularity.GEMS).collect()}
    assert got == {("HEAD", 5): (1, 3, 33.33), ("HEAD", 6): (1, 3, 33.33), ("NECK", 6): (1, 1, 100.0)}
    items = spark.createDataFrame([(1, 71, "HEAD", 7, [("a", None)]), (2, 71, "HEAD", None, [])], "character_id long, spec_id int, slot string, enchantment_id long, sockets array<struct<type:string,item_id:long>>")
    assert [tuple(r) for r in popularity.popularity(c, items, popularity.ENCHANTS).collect()] == [("2v2", 71, "HEAD", 7, 1, 1, 100.0)]
    assert [tuple(r) for r in popularity.socket_rows(items).collect()] == [(1, 71, "HEAD", "a", None)]


def test_previous_values_and_variants(spark):
    keys = ["slot", "item_id"]
    now = spark.createDataFrame([("HEAD", 1, 55.0), ("HEAD", 2, 10.0)], "slot string, item_id long, usage_pct double")
    was = spark.createDataFrame([("HEAD", 1, 42.0)], "slot string, item_id long, usage_pct double")
    assert sorted((r.item_id, r.prev_usage_pct, r.trend) for r in popularity.with_previous(now, was, keys).collect()) == [(1, 42.0, "up"), (2, None, "new")]
    rows = spark.createDataFrame([("HEAD", "a", 1, 3, 30.0, None), ("HEAD", "a", 2, 5, 50.0, 20.0), ("HEAD", "b", 3, 1, 5.0, None)], "slot string, name string, item_id long, usage_count long, usage_pct double, prev_usage_pct double")
    got = sorted(map(tuple, popularity.merge_variants(rows, ["slot", "name"], ["item_id"]).collect()))
    assert got == [("HEAD", "a", 2, 8, 80.0, 20.0, "up"), ("HEAD", "b", 3, 1, 5.0, None, "new")]


DIM = "talent_id long, node_id long, name string, max_rank int, icon string, talent_type string"
USE = "bracket string, spec_id int, talent_id long, talent_type string, default_points int, usage_count long, usage_pct double, in_top_build boolean, top_build_rank int, tier string"


def use(t, pct, kind="spec", built=True, rank=1, points=0):
    return ("2v2", 71, t, kind, points, int(pct), float(pct), built, rank, "common")


def tier_of(spark, uses, dim, budgets):
    return {r.talent_id: r.tier for r in tiers.budget_tiers(spark.createDataFrame(uses, USE), spark.createDataFrame(dim, DIM), budgets).collect()}


def test_budget_and_choice_nodes(spark):
    two = [(1, 10, "a", 1, "i", "spec"), (2, 11, "b", 1, "i", "spec")]
    assert tier_of(spark, [use(1, 90), use(2, 30)], two, {"spec": 1}) == {1: "bis", 2: "common"}
    assert tier_of(spark, [use(1, 90), use(2, 70)], two, {"spec": 1}) == {1: "bis", 2: "situational"}
    assert tier_of(spark, [use(1, 90), use(2, 50)], two, {"spec": 0}) == {1: "situational", 2: "situational"}
    same = [(1, 10, "a", 1, "i", "spec"), (2, 10, "b", 1, "i", "spec")]
    assert tier_of(spark, [use(1, 54), use(2, 42)], same, {"spec": 9}) == {1: "situational", 2: "situational"}
    assert tier_of(spark, [use(1, 90), use(2, 10)], same, {"spec": 9}) == {1: "bis", 2: "common"}
    assert tier_of(spark, [use(1, 90), use(2, 60)], same, {"spec": 9}) == {1: "situational", 2: "situational"}  # 30 points is contested
    assert tier_of(spark, [use(1, 90), use(2, 10)], [(1, 10, "a", 1, "i", "spec"), (2, 10, "a", 1, "i", "spec")], {"spec": 9}) == {1: "bis", 2: "bis"}


def brute_budget(nodes, budget):
    got, left, least = set(), budget, None
    for node, pct, cost in sorted(nodes, key=lambda n: (-n[1], n[0])):
        if cost <= left:
            got.add(node)
            left -= cost
            least = pct
    start = 50.0 if least is None else least * 0.5
    return {n: "bis" if n in got else "situational" if p >= start else "common" for n, p, _ in nodes}


def test_budget_by_brute_force(spark):
    r = random.Random(5)
    for _ in range(3):
        nodes = [(n, float(r.randrange(1, 100)), r.randrange(1, 4)) for n in range(12)]
        got = tier_of(spark, [use(n, p) for n, p, _ in nodes], [(n, n, f"n{n}", c, "i", "spec") for n, _, c in nodes], {"spec": 11})
        assert got == brute_budget(nodes, 11)


def brute_breaks(values, k):
    v = sorted(values)
    cost = lambda a: sum((x - sum(a) / len(a)) ** 2 for x in a)
    best = min(itertools.combinations(range(1, len(v)), k - 1), key=lambda cut: sum(cost(v[a:b]) for a, b in zip((0, *cut), (*cut, len(v)), strict=True)))
    return [v[c] for c in best]


def test_natural_breaks_by_brute_force():
    r = np.random.default_rng(3)
    assert tiers.natural_breaks(np.array([1.0, 2.0, 3.0])) == []
    for n in (4, 6, 9):
        v = r.random(n) * 100
        assert tiers.natural_breaks(v) == pytest.approx(brute_breaks(v, 3))


def test_jenks_small_groups_use_fixed_steps(spark):
    got = {r.talent_id: r.tier for r in tiers.jenks_tiers(spark.createDataFrame([use(1, 80, "pvp"), use(2, 60, "pvp"), use(3, 10, "pvp")], USE)).collect()}
    assert got == {1: "bis", 2: "situational", 3: "common"}


def test_hero_parts(spark):
    dim = [(i, i, f"n{i}", 1, "i", "hero") for i in range(1, 7)]
    edges = spark.createDataFrame([(2, 1), (4, 3), (6, 99)], "node_id long, prerequisite_id long")
    uses = [use(1, 80, "hero"), use(2, 70, "hero"), use(3, 40, "hero"), use(4, 30, "hero"), use(5, 10, "hero"), use(6, 20, "hero")]
    got = {r.talent_id: (r.component, r.tier) for r in tiers.hero_tiers(spark.createDataFrame(uses, USE), spark.createDataFrame(dim, DIM), edges).collect()}
    assert got == {1: (1, "bis"), 2: (1, "bis"), 3: (3, "situational"), 4: (3, "situational"), 5: (5, "common"), 6: (6, "common")}


def test_rank_variants_and_stale_ones(spark):
    dim = spark.createDataFrame([(1, 10, "a", 1, None, "spec"), (2, 10, "a", 1, "i", "spec"), (3, None, "c", 1, None, "spec"), (4, 11, None, 1, None, "spec"), (5, 12, None, 1, None, "spec")], DIM)
    rows = spark.createDataFrame([use(1, 30, rank=2), use(2, 70, rank=4, built=False, points=1), use(3, 5), use(4, 5), use(5, 6)], USE)
    got = {r.talent_id: (r.top_build_rank, r.in_top_build, r.default_points) for r in talents.merge_rank_variants(rows, dim).collect()}
    assert got == {2: (4, True, 1), 3: (1, True, 0), 4: (1, True, 0), 5: (1, True, 0)}
    given = spark.createDataFrame([(1, 71, 0)], "talent_id long, spec_id int, default_points int")
    assert sorted(r.talent_id for r in talents.merge_stale_variants(rows, dim, given).collect()) == [1, 3, 4, 5]  # nameless ones stay apart
    moved = talents.merge_stale_variants(rows.where("talent_id = 2"), dim, given).collect()
    assert [(r.talent_id, r.usage_pct) for r in moved] == [(1, 70.0)]
    assert sorted(r.talent_id for r in talents.drop_unresolvable(rows, dim, given).collect()) == [1, 2]
    assert talents.integrity_check(rows).count() == 1


def test_section_types_and_assignments(spark):
    rows = spark.createDataFrame([(1, "class"), (1, "hero"), (2, "spec"), (2, "class"), (3, "class")], "talent_id long, talent_type string")
    now = spark.createDataFrame([(3, "hero")], "talent_id long, talent_type string")
    assert {r.talent_id: r.talent_type for r in talents.section_type(rows, now).collect()} == {1: "hero", 2: "spec", 3: "hero"}
    cols = "talent_id long, spec_id int, talent_type string, default_points int"
    cur = spark.createDataFrame([(1, 71, "spec", 0), (2, 71, "hero", 0), (3, 72, "spec", 0)], cols)
    new = spark.createDataFrame([(4, 71, "spec", 1), (5, 72, "spec", 0)], cols)
    done = spark.createDataFrame([(71,)], "spec_id int")
    assert sorted(r.talent_id for r in talents.apply_assignments(cur, new, done).collect()) == [2, 3, 4]


def test_strength_degenerate_and_order(spark):
    e = spark.createDataFrame([entry(i, i, spec=71 + i % 2, rating=2000.0, wins=0, losses=0) for i in range(12)], ENTRY)
    rows = strength.spec_strength(e, catalog(spark), "2v2").collect()
    assert {(r.spec_id, r.wr_hat, r.b_k) for r in rows} == {(71, 0.5, 0.0), (72, 0.5, 0.0)}
    better = spark.createDataFrame([entry(i, i, spec=71, rating=2500.0 + i, wins=20, losses=10) for i in range(10)] + [entry(50 + i, 50 + i, spec=72, rating=1500.0 + i, wins=10, losses=20) for i in range(10)], ENTRY)
    got = {r.spec_id: r for r in strength.spec_strength(better, catalog(spark), "2v2").collect()}
    assert got[71].score > got[72].score and got[71]["count"] == 5
    assert strength.spec_strength(better, catalog(spark), "2v2", role="healer").count() == 0
    few = strength.top_half(spark.createDataFrame([entry(i, i) for i in range(4)], ENTRY), ["spec_id"])
    assert few.count() == 0
    change = strength.rank_change(spark.createDataFrame([(71, 0.9), (72, 0.5), (73, 0.1)], "spec_id int, score double").withColumn("b", F.lit(1)), spark.createDataFrame([(71, 0.1), (72, 0.5)], "spec_id int, score double").withColumn("b", F.lit(1)), ["b"])
    assert {r.spec_id: r.change for r in change.collect()} == {71: 1, 72: -1, 73: None}


def test_ladder_reads(spark):
    e = spark.createDataFrame([entry(i, i, rating=3000.0 - i, wins=i, losses=0) for i in range(1, 31)], ENTRY).withColumns({"rank": F.col("entry_id").cast("int"), "name": F.concat(F.lit("A_"), F.col("entry_id").cast("string")), "realm": F.lit("r")})
    page = ladder.ladder_page(e, "2v2", 2, 10, name="a_1").collect()
    assert len(page) == 1 and page[0].total_rows == 11 and page[0].total_pages == 2
    assert ladder.filtered(e, name="a%").count() == 0
    with pytest.raises(ValueError):
        ladder.top_of_ladder(e, "us", "shuffle", 5)
    assert ladder.same_identity(e, "US", "R", "a_3").count() == 1
    top = ladder.top_players(e, "2v2", F.lit(NOW), min_games=25).collect()
    assert len(top) == 10  # too few with 25 games: all count
    seasons = spark.createDataFrame([(1, False), (2, True), (3, False)], "season_id long, is_current boolean")
    assert ladder.current_season(seasons).first().season_id == 2
    assert ladder.season_with_rows(seasons, spark.createDataFrame([(1,), (3,)], "season_id long")).first().season_id == 3
    rows = spark.createDataFrame([(1, None), (1, 7), (2, None)], "season_id long, cycle_id long")
    assert sorted((r.season_id, r.cycle_id or 0) for r in ladder.live_rows(rows, 7).collect()) == [(1, 7), (2, 0)]


def test_incomplete_talents_and_last_cycles(spark):
    t = spark.createDataFrame([(1, "i"), (2, None), (3, "i")], "talent_id long, icon string")
    tr = spark.createDataFrame([(1, "en_US", "description"), (2, "en_US", "description"), (3, "en_US", "name")], "id long, locale string, key string")
    assert sorted(r.talent_id for r in ladder.incomplete_talents(t, tr, "en_US").collect()) == [2, 3]
    c = spark.createDataFrame([(i, "completed" if i != 3 else "failed", NOW, NOW + dt.timedelta(minutes=i)) for i in range(1, 9)], "cycle_id long, status string, snapshot_at timestamp, completed_at timestamp")
    assert [(r.cycle_id, r.seconds) for r in ladder.last_cycles(c).collect()] == [(8, 480), (7, 420), (6, 360), (5, 300), (4, 240)]


def test_sockets_profiles_and_trees(spark):
    items = spark.createDataFrame([(1, 71, "HEAD", 5, 600, [("RED", 9, None), ("RED", None, "+5"), ("RED", None, None)])], "character_id long, spec_id int, slot string, item_id long, item_level int, sockets array<struct<type:string,item_id:long,display_string:string>>")
    gems = spark.createDataFrame([(9, "Ruby")], "gem_id long, name string")
    assert [[s[1] for s in r.sockets] for r in read_models.shown_sockets(items, gems).collect()] == [["Ruby", "+5"]]
    e = spark.createDataFrame([entry(1, 1, rating=None, spec=72), entry(2, 1, rating=1.0, spec=71)], ENTRY).withColumn("rank", F.lit(1))
    own = spark.createDataFrame([(1, 71, 3, 2)], "character_id long, spec_id int, talent_id long, rank int")
    p = read_models.profiles(spark.createDataFrame([(1,), (2,)], "character_id long"), e, items, own)
    got = {r.character_id: (r.primary_spec_id, r.equipment and len(r.equipment)) for r in p.collect()}
    assert got == {1: (71, 1), 2: (None, None)}
    dim = spark.createDataFrame([(3, 10), (4, 11)], "talent_id long, node_id long")
    tree = read_models.tree_of(p, dim, spark.createDataFrame([(3, 71), (4, 71)], "talent_id long, spec_id int")).first().tree
    assert [(x.talent_id, x.selected, x["rank"]) for x in tree] == [(3, True, 2), (4, False, 0)]


def test_band_join_by_brute_force(spark):
    r = random.Random(2)
    pts = [(r.randrange(0, 200), r.random() < 0.5) for _ in range(150)]
    heroes = [n for n, h in pts if h]
    want = {n: c for n in {n for n, _ in pts} if (c := sum(abs(n - h) <= 5 for h in heroes)) >= 4}
    got = {x.node_id: x.n for x in dims.crowded_nodes(spark.createDataFrame(pts, "node_id long, is_hero boolean"), 5, 4).collect()}
    assert got == want
    t = spark.createDataFrame([(1, 10, "hero"), (2, 10, "spec"), (3, 50, "spec"), (4, None, "spec")], "talent_id long, node_id long, talent_type string")
    assert {x.talent_id: x.talent_type for x in dims.gateway_repair(t).collect()} == {1: "hero", 2: "hero", 3: "spec", 4: "spec"}


def test_small_repairs(spark):
    a = spark.createDataFrame([(1, 71, 0), (2, 71, 5)], "talent_id long, spec_id int, default_points int")
    t = spark.createDataFrame([(1, 3), (2, 0)], "talent_id long, default_points int")
    assert {x.talent_id: x.default_points for x in dims.copy_points(a, t).collect()} == {1: 3, 2: 5}
    rows, dim = spark.createDataFrame([(7, "x"), (8, "y"), (9, "z"), (None, "n")], "vendor long, v string"), spark.createDataFrame([(7, 4, "name")], "vendor long, key long, name string")
    whole = dims.with_stubs(dim, rows, "vendor", "key")
    assert sorted((r.vendor, r.name) for r in whole.collect() if r.vendor != 7) == [(8, None), (9, None)]
    assert sorted(r.key for r in whole.collect()) == [4, 5, 6] and dims.with_stubs(whole, rows, "vendor", "key").count() == 3
    assert sorted(r.v for r in dims.repoint(rows, whole, "vendor", "key").collect()) == ["x", "y", "z"]
    e = spark.createDataFrame([(1, 9), (1, 4), (2, None)], "enchantment_id long, source_item_id long")
    assert [tuple(x) for x in dims.source_items(e).collect()] == [(1, 4)]


def test_empty_health(spark):
    none = spark.createDataFrame([], ENTRY)
    assert health.processing_health(none).count() == 0
    assert health.sync_report(none).first().total == 0
    assert spec_stats.spec_distribution(none).count() == 0
    m = spark.createDataFrame([], "job_id long, job_class string, at timestamp, duration double, success boolean, error_class string")
    assert health.job_summary(m, F.lit(NOW)).first().success_pct is None


def test_modal_build_ties(spark):
    c = spark.createDataFrame([("2v2", i, 71, 1) for i in (1, 2, 3, 4)], "bracket string, character_id long, spec_id int, weight int")
    t = spark.createDataFrame([(1, 71, 5, 1), (1, 71, 3, 2), (2, 71, 3, 1), (2, 71, 5, 1), (3, 71, 2, 1), (4, 71, 2, 3), (4, 71, 9, 0)], "character_id long, spec_id int, talent_id long, rank int")
    assert builds.modal_build(c, t).first().build == [2]  # as heavy as [3, 5]
    assert {r.talent_id: r.top_build_rank for r in builds.modal_rank(c, t).collect()} == {2: 1, 3: 1, 5: 1}


def test_long_hero_paths_are_one_part(spark):
    n = 100
    order = [(i * 37) % n for i in range(n)]  # the path visits the nodes in no order of their ids
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501)], "node_id long, prerequisite_id long")
    uses = [("2v2", 71, k, "hero", 0, 1, 10.0, False) for k in [*range(n), 500, 501, 600]]
    dim = [(k, k, f"t{k}", 1) for k in [*range(n), 500, 501, 600]]
    rows = tiers.hero_tiers(spark.createDataFrame(uses, "bracket string, spec_id int, talent_id long, talent_type string, default_points int, usage_count int, usage_pct double, in_top_build boolean"), spark.createDataFrame(dim, "talent_id long, node_id long, name string, max_rank int"), edges)
    assert {r.node_id: r.component for r in rows.collect()} == {k: 0 for k in range(n)} | {500: 500, 501: 500, 600: 600}


def test_strip_html_ends_lines_where_cells_and_rows_end(spark):
    html = "<table><tr><td>1</td><TD>2</TD></tr><tr><td>3</td></tr></table><h1>head</h1><brand>x</brand><pre>y</pre>a<br>b<br/>c<BR />d<ul><li>e</li></ul><p>f</p>"
    want = "1\n2\n\n3\n\nheadxya\nb\nc\nde\nf"
    assert spark.createDataFrame([(html,)], "h string").select(X.strip_html(F.col("h")).alias("t")).first().t == want
