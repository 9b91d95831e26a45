from pyspark.sql import functions as F

from rungs.plans.build_all import LadderTables, build_all, counted, recounted, snapshot
from rungs.plans.testdata import Ladder
from rungs.sources import tables


def test_two_cycles_are_published(spark, data, tmp_path):
    t = Ladder(spark, data)
    ladder = LadderTables(t.entries, t.items, t.sockets, t.talents, t.talent_dim, t.assignments, t.edges)
    path = str(tmp_path / "meta")
    assert build_all(ladder, path, 1, top_n=10).columns == ["bracket", "spec_id"]
    first = {n: tables.published(spark, path, n).count() for n in ("items", "enchants", "gems", "talents")}
    assert all(first.values())
    assert tables.published(spark, path, "items").where("trend <> 'new'").count() == 0
    build_all(ladder, path, 2, top_n=10)
    assert tables.live_cycle(spark, path) == 2
    items = tables.published(spark, path, "items")
    assert items.count() == first["items"] and items.where("trend <> 'stable' or prev_usage_pct <> usage_pct").count() == 0
    assert tables.published(spark, path, "talents").where("tier is null").count() == 0
    assert spark.read.parquet(f"{path}/gems/cycle_id=1").count() == 0


def test_changed_characters_are_counted_anew(spark, data):
    t = Ladder(spark, data)
    of = lambda entries, items, talents: LadderTables(entries, items, t.sockets, talents, t.talent_dim, t.assignments, t.edges)
    hit = F.col("character_id") % 3 == 0
    old = snapshot(of(t.entries.where("entry_id % 5 <> 0"), t.items, t.talents), 4)
    new = snapshot(of(t.entries.where("entry_id % 7 <> 0"), t.items.withColumn("item_id", F.when(hit, F.lit("x")).otherwise(F.col("item_id"))), t.talents.where(~hit | (F.col("talent_id") > 9))), 4)
    changed = t.items.where(hit).select("character_id", "spec_id").union(t.talents.where(hit).select("character_id", "spec_id")).distinct()
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    before, want = counted(old), counted(new)
    got = recounted(before, old, new, changed)
    same = recounted(before, old, old, changed)
    for name in want:
        assert rows(got[name]) == rows(want[name]) != rows(before[name]) == rows(same[name])
