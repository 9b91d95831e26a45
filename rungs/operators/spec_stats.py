"""Distributions within a spec: loadouts, hero trees, tier sets, stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.scratch import written


def shares(entries: DataFrame, group: list[str], of: list[str], known: str | None = None) -> DataFrame:
    """group, of, count, pct: share of each value of `of` among the entries of the group, all of them; values where
    `known` is null are counted in the whole only."""
    c = entries.groupBy(*group, *of).agg(F.count("*").alias("count"))
    c = c.withColumn("pct", X.pct(F.col("count"), F.sum("count").over(W.partitionBy(*group) if group else W.partitionBy(F.lit(0)))))
    return c.where(F.col(known).isNotNull()) if known else c


def spec_distribution(entries: DataFrame, group: list[str] | None = None) -> DataFrame:
    return shares(entries.where("spec_id is not null"), group or ["bracket"], ["spec_id"])


def hero_distribution(entries: DataFrame, group: list[str] | None = None) -> DataFrame:
    return shares(entries, group or ["bracket", "spec_id"], ["hero_tree_id"], "hero_tree_id")


def tier_distribution(entries: DataFrame, group: list[str] | None = None) -> DataFrame:
    return shares(entries, group or ["bracket", "spec_id"], ["tier_set_id", "tier_set_name", "tier_set_pieces", "tier_4p_active"], "tier_set_id")


def loadout_distribution(entries: DataFrame, group: list[str] | None = None, limit: int = 20) -> DataFrame:
    """The `limit` commonest loadout codes of each group: each entry's code for its own spec. limit: 1 to 100."""
    group, limit = group or ["bracket", "spec_id"], min(100, max(1, limit))
    code = F.try_element_at("loadout_codes", F.col("spec_id").cast("string"))
    c = shares(entries.withColumn("loadout_code", code).where("loadout_code is not null"), group, ["loadout_code"])
    by = W.partitionBy(*group).orderBy(F.desc("count"), "loadout_code")
    return c.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit)


def stat_priority(entries: DataFrame, characters: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Interpolated median of each stat over the entries of a group, to one decimal; a character with two entries counts twice.

    characters: character_id, and stat and value a row, or the map stat_totals.
    """
    group = group or ["bracket", "spec_id"]
    if "stat_totals" in characters.columns:
        characters = characters.select("character_id", F.explode("stat_totals").alias("stat", "value"))
    rows = entries.select("character_id", *group).join(characters.select("character_id", "stat", "value"), "character_id")
    m = medians(rows, [*group, "stat"], "value")
    return m.select(*group, "stat", X.half_up(F.col("median"), 1).alias("median"))


def medians(rows: DataFrame, group: list[str], value: str, parts: int = 4096) -> DataFrame:
    """group and median of `value` (finite numbers, as doubles; nulls don't count) in each group, exact; between two middle
    values their mean. Groups of nulls alone are left out; null is a group like any other.

    Rows are counted by value once. Then the span of values that holds a middle is divided into parts of equal width, until
    it is one value: parts are counted, and the one that holds the middle is the next span, from its least value to its
    greatest. So no task holds the values of a group, and a group has a window of `parts` rows. Whole numbers that span no
    more than `parts` need one round, each further round a part of the span; rounds are written out.
    """
    key = [f"_g{i}" for i in range(len(group))]
    named = rows.select(*[F.col(g).alias(k) for g, k in zip(group, key)], F.col(value).cast("double").alias("_v")).where("_v is not null")
    counts = written(named.groupBy(*key, "_v").agg(F.count("*").alias("_n")), "values")
    ends = counts.groupBy(*key).agg(F.sum("_n").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # the places of the two middle values among the group's rows in order, from 0 on: one place for odd counts
    places = F.array_distinct(F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)))
    spans = written(ends.select(*key, F.explode(places).alias("_at"), "_lo", "_hi", F.lit(0).cast("long").alias("_before")), "spans")
    while True:
        open_ = spans.where("_lo < _hi")
        if open_.isEmpty():
            break
        marks = open_.select(*[F.col(k).alias(f"_s{k}") for k in key], "_at", "_lo", "_hi", "_before")
        same = [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in key]
        within = counts.join(marks, [*same, F.col("_v").between(F.col("_lo"), F.col("_hi"))])
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        halves = (v / 2 - lo / 2) / (hi / 2 - lo / 2)  # of spans that are too wide for a double
        part = F.floor(F.when(F.greatest(F.abs(lo), F.abs(hi)) < 1e300, (v - lo) / (hi - lo)).otherwise(halves) * parts)
        each = within.groupBy(*key, "_at", "_before", part.alias("_part")).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*key, "_at").orderBy("_part"))
        found = each.withColumn("_upto", upto).where("_upto > _at and _upto - _n <= _at")
        spans = written(spans.where("_lo = _hi").unionByName(found.select(*key, "_at", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_before"))), "spans")
    return spans.groupBy(*key).agg((F.min("_lo") / 2 + F.max("_lo") / 2).alias("median")).select(*[F.col(k).alias(g) for g, k in zip(group, key)], "median")


def cohort_stats(cohort: DataFrame, items: DataFrame) -> DataFrame:
    """bracket, spec_id, players, avg item level, and the mean of each summed stat over characters, as whole numbers."""
    rows = cohort.select("bracket", "character_id", "spec_id").join(items, ["character_id", "spec_id"])
    each = ["haste", "crit", "mastery", "versatility"]
    per = rows.groupBy("bracket", "spec_id", "character_id").agg(F.avg("item_level").alias("level"), *[F.coalesce(F.sum(F.try_element_at("stats", F.lit(s))), F.lit(0)).alias(s) for s in each])
    whole = lambda c: F.floor(F.avg(c) + F.lit(0.5)).cast("int")
    return per.groupBy("bracket", "spec_id").agg(F.count("*").alias("players"), whole("level").alias("avg_item_level"), *[whole(s).alias(s) for s in each])


def stat_totals(items: DataFrame, gems: DataFrame, enchants: DataFrame) -> DataFrame:
    """character_id, spec_id, stat, value: stats of items, of gem texts and of enchant names, summed; zeros are left out.

    items: character_id, spec_id, stats (map); gems, enchants: character_id, spec_id, text.
    """
    long = items.select("character_id", "spec_id", F.explode("stats").alias("stat", "value")).withColumn("value", F.col("value").cast("int"))
    said = gems.select("character_id", "spec_id", "text").unionByName(enchants.select("character_id", "spec_id", "text"))
    stats = F.array(*[F.struct(F.lit(s).alias("stat"), X.parse_stat(F.col("text"), s).alias("value")) for s in X.STAT_WORDS])
    texts = said.select("character_id", "spec_id", F.explode(stats).alias("s")).select("character_id", "spec_id", "s.stat", "s.value").where("value is not null")
    total = long.unionByName(texts).groupBy("character_id", "spec_id", "stat").agg(F.sum("value").alias("value"))
    return total.where("value <> 0")


def as_map(totals: DataFrame) -> DataFrame:
    """character_id, spec_id, stat_totals: the map of what stat_totals() gives."""
    return totals.groupBy("character_id", "spec_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stat", "value")))).alias("stat_totals"))


def distinct_players(entries: DataFrame) -> DataFrame:
    """bracket, spec_id, total_players: characters whose talents are processed."""
    return entries.where("talents_at is not null").groupBy("bracket", "spec_id").agg(F.countDistinct("character_id").alias("total_players"))


def coverage_pairs(cohort: DataFrame, items: DataFrame) -> DataFrame:
    """spec_id, bracket of the cohort that have items."""
    return cohort.join(items.select("character_id", "spec_id").distinct(), ["character_id", "spec_id"], "left_semi").select("spec_id", "bracket").distinct()
