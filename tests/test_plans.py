"""Plans of the queries that read the large tables: how often each is scanned, and what is shuffled."""

import re

import pytest

from rungs.operators import builds, cohort, popularity
from rungs.plans import queries
from rungs.plans.testdata import Ladder
from rungs.sources.buckets import bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, table):
    return len(re.findall(rf"FileScan[^\n]*/{table}\.parquet", plan(df)))


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name, most", [("weighted_usage", 10), ("drop_stale", 14)])
def test_usage_reads_each_large_table_once(spark, data, name, most):
    df = getattr(queries, name)(Ladder(spark, data))
    assert [scans(df, t) for t in ("orders", "customer", "lineitem")] == [1, 1, 1]
    assert plan(df).count("Exchange hashpartitioning") <= most


def test_tiers_read_what_is_stored(spark, data):
    df = queries.budget_tiers(Ladder(spark, data))
    assert [scans(df, t) for t in ("orders", "customer", "lineitem")] == [0, 0, 0]


def test_trend_reads_items_once(spark, data):
    df = queries.popularity_trend(Ladder(spark, data))
    assert scans(df, "lineitem") == 1 and scans(df, "orders") <= 3 and plan(df).count("Exchange hashpartitioning") <= 10


def test_stored_tables_join_without_a_shuffle(spark, data):
    t, keys = Ladder(spark, data), ["character_id", "spec_id"]
    top = cohort.top_cohort(t.entries, "equipment_at", 10)
    stored = [bucketed(x, keys, "stored") for x in (top, t.items)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        worn = stored[0].join(stored[1], keys)
        assert "Exchange" not in plan(worn)
        # the only shuffle is that of the counts
        counted = popularity.popularity(*stored, popularity.ITEMS)
        assert not re.search(r"Exchange hashpartitioning\(character_id", plan(counted))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows(counted) == rows(popularity.popularity(top, t.items, popularity.ITEMS))


def test_one_pass_gives_what_the_parts_give(spark, data):
    t = Ladder(spark, data)
    for top_n in (3, 1000):
        w = cohort.top_cohort(t.entries, "talents_at", top_n, weighted=True)
        parts = builds.with_build(builds.weighted_usage(w, t.talents, t.talent_dim, t.assignments), builds.modal_build(w, t.talents), builds.modal_rank(w, t.talents))
        whole = builds.full_usage(builds.with_talents(w, t.talents), t.talent_dim, t.assignments)
        assert sorted(whole.columns) == sorted(parts.columns) and rows(whole) == rows(parts)


def test_group_sizes_are_counted_in_parts(spark):
    entries = [(i, i % 40, "2v2", 1 if i % 3 else 2, float(i % 17) if i % 11 else None, 1, 1) for i in range(500)]
    df = spark.createDataFrame(entries, "entry_id long, character_id long, bracket string, spec_id int, rating double, wins long, losses long")
    got = cohort.top_cohort(df, None, 5, weighted=True)
    best = cohort.best_entry(df).collect()
    for r in got.collect():
        group = [b for b in best if b.spec_id == r.spec_id]
        higher = [b for b in group if r.rating is not None and (b.rating is None or b.rating > r.rating)]
        assert (r.spec_rank, r.spec_total) == (len(higher) + 1, len(group)) and r.spec_rank <= 5
    assert got.count() == cohort.top_cohort(df, None, 5).count()


def test_talents_without_rank_and_characters_without_talents(spark):
    w = spark.createDataFrame([("b", 1, 7, 3), ("b", 2, 7, 2), ("b", 3, 7, 1)], "bracket string, character_id long, spec_id int, weight int")
    talents = spark.createDataFrame([(1, 7, 10, 0), (1, 7, 11, 2), (2, 7, 11, 1), (2, 7, 12, 2)], "character_id long, spec_id int, talent_id long, rank int")
    dim = spark.createDataFrame([(10, "class"), (11, "spec"), (12, "pvp")], "talent_id long, talent_type string")
    assignments = spark.createDataFrame([(12, 7, 1)], "talent_id long, spec_id int, default_points int")
    got = {r.talent_id: (r.usage_count, r.usage_pct, r.in_top_build, r.top_build_rank, r.tier) for r in builds.full_usage(builds.with_talents(w, talents), dim, assignments).collect()}
    assert got == {10: (3, 50.0, False, 0, "common"), 11: (5, 83.3333, True, 2, "bis"), 12: (2, 33.3333, False, 2, "bis")}
