"""Full and incremental refreshes: all aggregates of a cycle from the ladder tables, checked and published together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import builds, cohort, popularity, talents, tiers
from ..sources import tables
from ..sources.buckets import bucketed
from ..sources.scratch import cut_lineage, written

OWNER = ["character_id", "spec_id"]
#: What is counted, by frame; talents are counted as builds.usage_facts().
SPECS = {"items": popularity.ITEMS, "enchants": popularity.ENCHANTS, "gems": popularity.GEMS}
_FACT = ["kind", "talent_id", "rank", "build"]


@dataclass
class LadderTables:
    """entries, items, sockets, talents (character talents), dim (talents), assignments, edges."""

    entries: DataFrame
    items: DataFrame
    sockets: DataFrame
    talents: DataFrame
    dim: DataFrame
    assignments: DataFrame
    edges: DataFrame


@dataclass
class Snapshot:
    """Both cohorts of a refresh, and what characters have, in buckets of character and spec: joined without a shuffle."""

    top: DataFrame
    weighted: DataFrame
    items: DataFrame
    sockets: DataFrame
    talents: DataFrame


def snapshot(t: LadderTables, top_n: int = 1000) -> Snapshot:
    """Each table is read and dealt once. A character has few items, sockets, talents and brackets, so that no bucket grows with one."""
    top = cohort.top_cohort(t.entries, "equipment_at", top_n).select("bracket", *OWNER)
    weighted = cohort.top_cohort(t.entries, "talents_at", top_n, weighted=True).select("bracket", *OWNER, "weight")
    frames = {"top": top, "weighted": weighted, "items": t.items.select(*OWNER, "slot", "item_id", "enchantment_id"), "sockets": t.sockets, "talents": t.talents}
    return Snapshot(**{name: bucketed(df, OWNER, name) for name, df in frames.items()})


def counted(s: Snapshot, keys: DataFrame | None = None) -> dict[str, DataFrame]:
    """Counts of each frame, of the characters and specs in keys or of all."""
    of = lambda df: df if keys is None else df.join(keys, OWNER, "left_semi")
    out = {name: popularity.counts(of(s.top), s.sockets if name == "gems" else s.items, spec) for name, spec in SPECS.items()}
    return out | {"talents": builds.usage_facts(builds.with_talents(of(s.weighted), of(s.talents)))}


def recounted(before: dict[str, DataFrame], old: Snapshot, new: Snapshot, changed: DataFrame) -> dict[str, DataFrame]:
    """counted(new) out of counted(old): what the changed characters had added is taken off, and what they add now is put on.

    changed: the characters and specs (any number of times) whose items, sockets or talents a sync has rewritten. To
    these come those that are in one of the cohorts only, or with another weight. Only what these have is counted.
    """
    moved = changed.select(*OWNER)
    for a, b in ((old.top, new.top), (old.weighted, new.weighted)):
        sides = a.withColumn("_s", F.lit(-1)).unionByName(b.withColumn("_s", F.lit(1)))
        moved = moved.union(sides.groupBy(*a.columns).agg(F.sum("_s").alias("_s")).where("_s <> 0").select(*OWNER))
    moved = bucketed(moved.where("character_id is not null and spec_id is not null").distinct(), OWNER, "moved")
    off, on = counted(old, moved), counted(new, moved)
    out = {}
    for name, df in before.items():
        keys = [c for c in df.columns if c != "n"]
        rows = df.unionByName(off[name].withColumn("n", -F.col("n"))).unionByName(on[name])
        out[name] = rows.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
    return out


def talent_frame(t: LadderTables, facts: DataFrame) -> DataFrame:
    """Talent popularity after all steps: usage, builds, rank variants, stale variants, unresolvable rows, tiers."""
    usage = talents.merge_rank_variants(builds.usage_of(facts, t.dim, t.assignments), t.dim)
    usage = cut_lineage(talents.drop_unresolvable(talents.merge_stale_variants(usage, t.dim, t.assignments), t.dim, t.assignments))
    keys = ["bracket", "spec_id", "talent_type", "talent_id"]
    by_type = tiers.budget_tiers(usage, t.dim).select(*keys, "tier")
    by_type = by_type.union(tiers.hero_tiers(usage, t.dim, t.edges).select(*keys, "tier")).union(tiers.jenks_tiers(usage).withColumn("talent_type", F.lit("pvp")).select(*keys, "tier"))
    # rows without a node keep the tier of their share
    return usage.withColumnRenamed("tier", "_share").join(by_type, keys, "left").withColumn("tier", F.coalesce("tier", "_share")).drop("_share")


def frames_of(t: LadderTables, counts: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, list[str]]]:
    """Each frame of a cycle, and its keys."""
    out = {name: (popularity.shares(counts[name], spec), ["bracket", "spec_id", *spec.dims, spec.item]) for name, spec in SPECS.items()}
    return out | {"talents": (talent_frame(t, counts["talents"]), ["bracket", "spec_id", "talent_id"])}


def publish_counts(t: LadderTables, counts: dict[str, DataFrame], path: str, cycle: int) -> DataFrame:
    """Publishes the frames of counts with their trends against the live version; either all are published or none.
    Returns the (bracket, spec) pairs without a hero row."""
    spark, out = t.entries.sparkSession, {}
    for name, (frame, keys) in frames_of(t, counts).items():
        before = tables.published(spark, path, name)
        none = frame.select(*keys, "usage_pct").limit(0)
        out[name] = popularity.with_previous(frame, none if before is None else before.select(*keys, "usage_pct"), keys)
    tables.publish(out, path, cycle)
    return talents.integrity_check(tables.published(spark, path, "talents"))


def build_all(t: LadderTables, path: str, cycle: int, top_n: int = 1000) -> DataFrame:
    """Builds item, enchant, gem and talent popularity with their trends against the live version, and publishes them as
    a cycle; either all are published or none. Returns the (bracket, spec) pairs without a hero row.

    The cohorts and what characters have are written once, in buckets; the counts are small.
    """
    return publish_counts(t, {name: written(df, name) for name, df in counted(snapshot(t, top_n)).items()}, path, cycle)


def build_changed(t: LadderTables, before: dict[str, DataFrame], old: Snapshot, changed: DataFrame, path: str, cycle: int, top_n: int = 1000) -> tuple[DataFrame, dict[str, DataFrame], Snapshot]:
    """build_all() by recounted(): the pairs without a hero row, and the counts and the snapshot for the next one."""
    new = snapshot(t, top_n)
    counts = {name: written(df, name) for name, df in recounted(before, old, new, changed).items()}
    return publish_counts(t, counts, path, cycle), counts, new
