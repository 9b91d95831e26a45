"""Reads of ladders: pages, top players, and the filters they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.catalog import SKIPPED_BRACKETS
from .cohort import bracket_scope, gated, recent


def filtered(entries: DataFrame, region: str | list[str] | None = None, spec_id: int | None = None, class_slug: str | None = None, name: str | None = None, rating_min: float | None = None, rating_max: float | None = None, min_winrate: float | None = None, min_item_level: int | None = None) -> DataFrame:
    """Entries that meet all of the filters given; name is a prefix in any case, min_winrate a fraction that entries without games never reach."""
    e = entries
    if region is not None:
        e = e.where(F.col("region").isin([region] if isinstance(region, str) else region))
    if spec_id is not None:
        e = e.where(F.col("spec_id") == spec_id)
    if class_slug is not None:
        e = e.where(F.col("class_slug") == class_slug)
    if name:
        e = e.where(F.col("name").ilike(X.escape_like(name) + "%"))
    if rating_min is not None:
        e = e.where(F.col("rating") >= rating_min)
    if rating_max is not None:
        e = e.where(F.col("rating") <= rating_max)
    if min_winrate is not None:
        e = e.where(F.try_divide(F.col("wins").cast("double"), F.col("wins") + F.col("losses")) >= min_winrate)
    if min_item_level is not None:
        e = e.where(F.col("item_level") >= min_item_level)
    return e


def name_contains(rows: DataFrame, text: str, column: str = "name") -> DataFrame:
    return rows.where(F.col(column).ilike("%" + X.escape_like(text) + "%"))


def same_identity(rows: DataFrame, region: str, realm: str, name: str) -> DataFrame:
    """Rows of one character, whatever the case."""
    return rows.where((F.lower("region") == region.lower()) & (F.lower("realm") == realm.lower()) & (F.lower("name") == name.lower()))


def ladder_page(entries: DataFrame, bracket: str, page: int = 1, per_page: int = 50, **filters) -> DataFrame:
    """A page of a bracket by rank (then entry_id), with the total of rows and pages on each row. per_page: 1 to 500."""
    per_page = min(500, max(1, per_page))
    e = filtered(bracket_scope(entries, bracket), **filters)
    total = e.agg(F.count("*").alias("total_rows"))
    rows = e.orderBy("rank", "entry_id").offset((max(1, page) - 1) * per_page).limit(per_page)
    rows = rows.withColumn("winrate", X.half_up(X.winrate_pct(F.col("wins"), F.col("losses")), 1))
    # one row, of the same ladder
    return rows.crossJoin(F.broadcast(total)).withColumn("total_pages", F.ceil(F.col("total_rows") / per_page))


def top_players(entries: DataFrame, bracket: str, as_of: Column, spec_id: int | None = None, regions: list[str] | None = None, limit: int = 10, min_games: int = 50, days: int = 60, gate: str = "equipment_at") -> DataFrame:
    """The `limit` best by score, then entry_id, among entries processed within `days`; those of min_games games only, unless fewer than `limit` have them."""
    e = filtered(entries.where(F.col("bracket") == bracket), region=regions, spec_id=spec_id)
    e = gated(recent(e, gate, as_of, days), F.col("wins") + F.col("losses") >= min_games, limit)
    return e.withColumn("score", X.half_up(X.player_score(F.col("rating"), F.col("wins"), F.col("losses")), 2)).orderBy(F.desc("score"), "entry_id").limit(limit)


def top_of_ladder(entries: DataFrame, region: str, bracket: str, n: int, spec_id: int | None = None) -> DataFrame:
    """First n of a ladder by rank; brackets that mix specs (`shuffle`, `blitz`) need the spec."""
    if bracket in ("shuffle", "blitz") and spec_id is None:
        raise ValueError(f"{bracket} holds a ladder a spec: name the spec")
    return filtered(bracket_scope(entries, bracket), region=region, spec_id=spec_id).orderBy("rank", "entry_id").limit(n)


def player_view(rows: DataFrame) -> DataFrame:
    """What is shown of a player: realm and region as titles, class with hyphens, null for empty."""
    return rows.withColumns({"realm": X.realm_title(F.col("realm")), "region": F.upper("region"), "class_slug": X.class_title(F.col("class_slug"))})


def current_season(seasons: DataFrame) -> DataFrame:
    """The current season, else that with the highest id."""
    return seasons.orderBy(F.coalesce("is_current", F.lit(False)).desc(), F.desc("season_id")).limit(1)


def season_with_rows(seasons: DataFrame, rows: DataFrame) -> DataFrame:
    """The current season if rows has any of it, else the newest that it has."""
    return current_season(seasons.join(rows.select("season_id").distinct(), "season_id", "left_semi"))


def live_rows(rows: DataFrame, live_cycle: int | None) -> DataFrame:
    """Rows of the live cycle; if there are none, those of no cycle."""
    live = F.coalesce(F.col("cycle_id") == F.lit(live_cycle), F.lit(False))
    if "season_id" in rows.columns:
        marked = rows.join(rows.groupBy("season_id").agg(F.bool_or(live).alias("_has")), "season_id")
    else:
        marked = rows.crossJoin(F.broadcast(rows.agg(F.bool_or(live).alias("_has"))))  # one row
    return marked.where(F.when(F.col("_has"), live).otherwise(F.col("cycle_id").isNull())).drop("_has")


def discovered(brackets: DataFrame) -> DataFrame:
    return brackets.where(~F.col("bracket").isin(*SKIPPED_BRACKETS))


def available(characters: DataFrame, as_of: Column) -> DataFrame:
    """Characters that aren't private and have no cooldown, or one that has run out."""
    return characters.where(~F.coalesce("is_private", F.lit(False)) & (F.col("unavailable_until").isNull() | (F.col("unavailable_until") <= as_of)))


def stale_meta(characters: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return characters.where(F.col("meta_synced_at").isNull() | (F.col("meta_synced_at") < as_of - F.make_interval(days=F.lit(days))))


def not_recent(rows: DataFrame, entries: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Rows whose character has no entry that was processed within `hours`."""
    fresh = entries.where(F.col("equipment_at") > as_of - F.make_interval(hours=F.lit(hours))).select("character_id").distinct()
    return rows.join(fresh, "character_id", "left_anti")


def unsynced(entries: DataFrame) -> DataFrame:
    """Entries with a gate unset, and whether they may be tried again (fewer than three times so far)."""
    return entries.where("equipment_at is null or talents_at is null").withColumn("retry", F.coalesce("sync_retry_count", F.lit(0)) < 3)


def incomplete_talents(talents: DataFrame, translations: DataFrame, locale: str) -> DataFrame:
    """Talents without an icon or without a description in the locale."""
    said = translations.where((F.col("key") == "description") & (F.col("locale") == locale)).select(F.col("id").alias("talent_id")).distinct()
    return talents.where("icon is null").unionByName(talents.join(said, "talent_id", "left_anti")).dropDuplicates(["talent_id"])


def newest_cycle(cycles: DataFrame) -> DataFrame:
    """The newest cycle of each season: that created last, then that with the highest id."""
    rest = F.struct(*[c for c in cycles.columns if c != "season_id"])
    return cycles.groupBy("season_id").agg(F.max_by(rest, F.struct("created_at", "cycle_id")).alias("_c")).select("season_id", "_c.*")


#: What a cycle is that isn't over.
UNDER_WAY = ("syncing_leaderboards", "syncing_characters")


def active_cycle(cycles: DataFrame) -> DataFrame:
    """The newest cycle of each season among those under way."""
    return newest_cycle(cycles.where(F.col("status").isin(*UNDER_WAY)))


def last_cycles(cycles: DataFrame, n: int = 5) -> DataFrame:
    """The last n completed cycles with their seconds."""
    done = cycles.where("status = 'completed'").orderBy(F.desc("completed_at"), F.desc("cycle_id")).limit(n)
    return done.withColumn("seconds", F.timestamp_diff("SECOND", F.col("snapshot_at"), F.col("completed_at")))
