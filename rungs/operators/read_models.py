"""Nested rows as they are published: meta tables with names, talent trees, character profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .popularity import usage_block


def localized(rows: DataFrame, translations: DataFrame, kind: str, id_col: str, locale: str, out: str = "name", key: str = "name", default: str = "en_US") -> DataFrame:
    """rows with the text of (kind, id, key) in the locale, else in the default one, else null."""
    t = translations.where((F.col("type") == kind) & (F.col("key") == key) & F.col("locale").isin(locale, default))
    t = t.groupBy(F.col("id").alias("_id")).agg(F.max_by("value", F.col("locale") == locale).alias(out))
    return rows.join(t, rows[id_col] == t["_id"], "left").drop("_id")


def item_rows(popularity: DataFrame, translations: DataFrame, crafting: DataFrame, locale: str) -> DataFrame:
    """Item popularity with name, whether it is crafted, its top crafting stats (an empty list by default) and a usage block."""
    rows = localized(popularity, translations, "item", "item_id", locale).join(crafting.select("item_id", "crafting_stats"), "item_id", "left")
    return rows.select("bracket", "spec_id", "slot", "item_id", "name", F.col("crafting_stats").isNotNull().alias("crafted"), F.coalesce("crafting_stats", F.array().cast("array<string>")).alias("top_crafting_stats"), usage_block(rows))


def named_rows(popularity: DataFrame, translations: DataFrame, kind: str, id_col: str, locale: str, dims: tuple[str, ...] = ("slot",)) -> DataFrame:
    """Popularity of enchants or gems (an id column, and the dimensions it is counted by) with name and usage block."""
    rows = localized(popularity.withColumn("_key", F.col(id_col).cast("string")), translations, kind, "_key", locale)
    return rows.select("bracket", "spec_id", *dims, id_col, "name", usage_block(rows))


def talent_rows(rows: DataFrame, dim: DataFrame, edges: DataFrame) -> DataFrame:
    """Talent rows with node, default points and the sorted prerequisite nodes of their node."""
    pre = edges.groupBy("node_id").agg(F.array_sort(F.collect_set("prerequisite_id")).alias("prerequisites"))
    out = rows.join(dim.select("talent_id", "node_id"), "talent_id", "left").join(pre, "node_id", "left")
    return out.withColumn("prerequisites", F.coalesce("prerequisites", F.array().cast("array<bigint>")))


def primary_spec(entries: DataFrame) -> DataFrame:
    """character_id, spec_id of the highest-rated entry (then the least entry_id)."""
    return entries.where("spec_id is not null").groupBy("character_id").agg(F.max_by("spec_id", F.struct(F.coalesce(F.col("rating"), F.lit(float("-inf"))), -F.col("entry_id"))).alias("spec_id"))


def shown_sockets(items: DataFrame, gem_names: DataFrame) -> DataFrame:
    """character_id, slot, sockets: type and gem name, else display string, of each socket that has either, in order.
    gem_names: gem_id, name."""
    s = items.select("character_id", "slot", F.posexplode("sockets").alias("k", "s")).select("character_id", "slot", "k", F.col("s.type").alias("type"), F.col("s.item_id").alias("gem_id"), F.col("s.display_string").alias("said"))
    s = s.join(gem_names, "gem_id", "left").withColumn("label", F.coalesce("name", "said")).where("label is not null")
    return s.groupBy("character_id", "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "type", "label"))), lambda x: F.struct(x["type"], x["label"])).alias("sockets"))


def profiles(characters: DataFrame, entries: DataFrame, items: DataFrame, talents: DataFrame) -> DataFrame:
    """One nested row a character: its entries by rating, and the equipment and talents of its primary spec."""
    e = entries.groupBy("character_id").agg(F.sort_array(F.collect_list(F.struct("rating", "bracket", "rank", "wins", "losses", "spec_id")), asc=False).alias("entries"))
    spec = primary_spec(entries)
    own = lambda d, cols, name: d.join(spec, ["character_id", "spec_id"]).groupBy("character_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    rows = characters.join(e, "character_id", "left").join(spec.withColumnRenamed("spec_id", "primary_spec_id"), "character_id", "left")
    return rows.join(own(items, ["slot", "item_id", "item_level"], "equipment"), "character_id", "left").join(own(talents, ["talent_id", "rank"], "talents"), "character_id", "left")


def tree_of(profiles_: DataFrame, talents: DataFrame, assignments: DataFrame) -> DataFrame:
    """character_id, tree: every talent assigned to the character's primary spec, with whether and at what rank it is taken."""
    taken = profiles_.select("character_id", "primary_spec_id", F.explode_outer("talents").alias("t")).select("character_id", F.col("t.talent_id").alias("talent_id"), F.col("t.rank").alias("rank"))
    whole = profiles_.select("character_id", F.col("primary_spec_id").alias("spec_id")).join(assignments.select("talent_id", "spec_id"), "spec_id").join(talents.select("talent_id", "node_id"), "talent_id")
    rows = whole.join(taken.where("talent_id is not null"), ["character_id", "talent_id"], "left")
    return rows.groupBy("character_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "talent_id", F.col("rank").isNotNull().alias("selected"), F.coalesce("rank", F.lit(0)).alias("rank")))).alias("tree"))


def stats_response(stats: DataFrame) -> DataFrame:
    """Nulls of all number columns as 0."""
    return stats.fillna(0)


def failed_characters(entries: DataFrame, characters: DataFrame, least_pct: float = 5.0) -> DataFrame:
    """line: REGION/realm/name of the characters of unsynced entries, if they are least_pct of all entries or more."""
    failed = F.col("equipment_at").isNull() | F.col("talents_at").isNull()
    share = entries.agg(F.count_if(failed).alias("_f"), F.count("*").alias("_n"))
    rows = entries.where(failed).select("character_id").distinct().join(characters, "character_id")
    rows = rows.crossJoin(F.broadcast(share)).where(F.col("_f") * 100.0 >= least_pct * F.col("_n"))  # one row
    return rows.select(F.concat_ws("/", F.upper("region"), "realm", "name").alias("line"))


def titles(characters: DataFrame) -> DataFrame:
    return characters.withColumn("display_name", X.display_name(F.col("name"), F.col("realm")))
