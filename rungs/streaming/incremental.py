"""Incremental batches: what changed, what to try again, what is stale, what may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.tables import replace_slice


def item_fingerprints(items: DataFrame) -> DataFrame:
    """character_id, spec_id, fingerprint of all items worn. items: slot, item_id, item_level, enchantment_id, crafting_stats."""
    crafts = F.array_join(F.array_sort("crafting_stats"), "+")
    one = F.struct(F.col("slot").alias("slot"), F.col("item_id").alias("item"), F.col("item_level").alias("level"), F.col("enchantment_id").alias("enchant"), crafts.alias("crafts"))
    return items.groupBy("character_id", "spec_id").agg(X.fingerprint(F.collect_list(one)).alias("fingerprint"))


def changed_only(new: DataFrame, old: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of new whose value differs from the old one of their keys, or that have none."""
    o = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_had"))
    return new.join(o, keys, "left").where(F.col("_had").isNull() | ~F.col(value).eqNullSafe(F.col("_old"))).drop("_old", "_had")


def changed_items(items: DataFrame, old_fingerprints: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored items after a sync that rewrites only characters and specs whose fingerprint changed, and these with the new fingerprint."""
    changed = changed_only(item_fingerprints(items), old_fingerprints, ["character_id", "spec_id"], "fingerprint")
    keys = changed.select("character_id", "spec_id")
    return replace_slice(stored, keys, items.join(keys, ["character_id", "spec_id"], "left_semi").select(*stored.columns)), changed


def changed_loadouts(loadouts: DataFrame, talents: DataFrame, old: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored talents after a sync by loadout code, and the codes to store: those that changed and came with talents.
    A code without any talent is passed over, and not stored."""
    keys = ["character_id", "spec_id"]
    changed = changed_only(loadouts, old, keys, "loadout_code").join(talents.select(*keys).distinct(), keys, "left_semi")
    ids = changed.select(*keys)
    return replace_slice(stored, ids, talents.join(ids, keys, "left_semi").select(*stored.columns)), changed


def latest_processed(entries: DataFrame, gate: str, columns: list[str]) -> DataFrame:
    """character_id and columns of the entry that passed the gate last (then the highest entry_id)."""
    last = entries.where(F.col(gate).isNotNull()).groupBy("character_id").agg(F.max_by(F.struct(gate, *columns), F.struct(gate, "entry_id")).alias("_e"))
    return last.select("character_id", "_e.*")


def fetched(payloads: DataFrame, entries: DataFrame, gate: str, columns: list[str]) -> DataFrame:
    """character_id and columns: from the payload, or where it says not_modified, from the latest processed entry."""
    last = latest_processed(entries, gate, columns).select("character_id", *[F.col(c).alias(f"_{c}") for c in columns])
    rows = payloads.join(last, "character_id", "left")
    return rows.select("character_id", *[F.when(F.col("not_modified"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def spec_aware_update(entries: DataFrame, updates: DataFrame, equipment: list[str], talents: list[str]) -> DataFrame:
    """entries with updates (character_id, active_spec, all columns, hero_trees: map of spec id as text to tree). Entries
    of the active spec, or of none, take everything and the spec; others the talent columns alone, their own spec's
    hero tree, and keep their spec."""
    cols = [*equipment, *talents]
    rows = entries.join(updates.select("character_id", "active_spec", "hero_trees", *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_u")), "character_id", "left")
    has = F.coalesce("_u", F.lit(False))
    fits = has & (F.col("spec_id").isNull() | (F.col("spec_id") == F.col("active_spec")))
    out = {c: F.when(fits, F.col(f"_{c}")).otherwise(F.col(c)) for c in equipment}
    out |= {c: F.when(has, F.col(f"_{c}")).otherwise(F.col(c)) for c in talents}
    own = F.try_element_at("hero_trees", F.coalesce("spec_id", "active_spec").cast("string"))
    out |= {"hero_tree_id": F.when(has, own).otherwise(F.col("hero_tree_id")), "spec_id": F.when(fits, F.col("active_spec")).otherwise(F.col("spec_id"))}
    return rows.withColumns(out).select(*entries.columns)


def split_retries(entries: DataFrame, most: int = 3) -> DataFrame:
    """Unsynced entries with what happens to them: `requeue` with the count one higher, or `exhausted`."""
    e = entries.where("equipment_at is null or talents_at is null").withColumn("sync_retry_count", F.coalesce("sync_retry_count", F.lit(0)))
    again = F.col("sync_retry_count") < most
    return e.withColumn("outcome", F.when(again, "requeue").otherwise("exhausted")).withColumn("sync_retry_count", F.when(again, F.col("sync_retry_count") + 1).otherwise(F.col("sync_retry_count")))


def stale_runs(runs: DataFrame, as_of: Column, minutes: int = 120, hours: int = 24) -> DataFrame:
    """Runs under way (status not completed, failed or aborted) that haven't moved for `minutes`: recover, or abort if older than `hours`."""
    r = runs.where(~F.col("status").isin("completed", "failed", "aborted") & (F.col("updated_at") < as_of - F.make_interval(mins=F.lit(minutes))))
    return r.withColumn("action", F.when(F.col("created_at") < as_of - F.make_interval(hours=F.lit(hours)), "abort").otherwise("recover"))


def retain(rows: DataFrame, at: str, as_of: Column, days: int, only: Column | None = None) -> DataFrame:
    """Rows without those older than `days` (of those for which `only` holds)."""
    old = F.col(at) < as_of - F.make_interval(days=F.lit(days))
    return rows.where(~F.coalesce(old if only is None else old & only, F.lit(False)))


def milestones(progress: DataFrame, steps: tuple[int, ...] = (25, 50, 75)) -> DataFrame:
    """progress (cycle_id, seq, done, expected) with pct and the milestones that this batch is the first to reach."""
    by = W.partitionBy("cycle_id").orderBy("seq")
    p = progress.withColumn("pct", X.progress_pct(F.col("done"), F.col("expected")))
    p = p.withColumn("before", F.coalesce(F.lag("pct").over(by), F.lit(0)))
    crossed = F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: (F.col("before") < s) & (F.col("pct") >= s))
    return p.withColumn("milestones", crossed)


def reset(rows: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """rows with the columns cleared (where the predicate holds), so that the next sync computes them anew."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return rows.withColumns({c: F.when(~hit, F.col(c)) for c in columns})
