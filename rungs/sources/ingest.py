"""Payloads to tables: ladders, equipment, specialisations, talent trees, seasons, media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import schemas

#: Slots that hold no equipment, and the stats that count.
NO_SLOTS = ("TABARD", "SHIRT")
STATS = {"HASTE_RATING": "haste", "CRIT_RATING": "crit", "MASTERY_RATING": "mastery", "VERSATILITY": "versatility"}


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_payloads(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Payloads of a folder of JSON lines, and those that are rejected: file, reason, payload (the line as it is).

    Reasons: `no JSON object`; `wrong type`, a field of another type than the schema's; `without <field>`, the first of the
    required fields that is null. A line is in one of the two, but for blank ones, which are in neither. Fields that the
    schema lacks are passed over.
    """
    bad = "_not_parsed"
    lines = spark.read.text(path).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file")).where(F.col("payload").rlike(r"\S"))
    lines = lines.withColumn("_p", F.from_json("payload", f"{schema}, {bad} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    no_object = ~F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False))
    reason = F.when(no_object, "no JSON object").when(F.col(f"_p.{bad}").isNotNull(), "wrong type")
    for field in required:
        reason = reason.when(F.col(f"_p.{field}").isNull(), f"without {field}")
    lines = lines.withColumn("reason", reason)
    return lines.where("reason is null").select("_p.*").drop(bad), lines.where("reason is not null").select("file", "reason", "payload")


def leaderboard(payloads: DataFrame) -> DataFrame:
    """One row an entry of each ladder payload, of the first top-N of its list: season_id, bracket, region, character_id,
    name, realm, faction, rank, rating, wins, losses, and class and spec where the bracket names them. A character that
    stands in a ladder several times keeps its best place. A ladder may come in pages, with the number of entries before
    each as `offset`."""
    before = F.coalesce("offset", F.lit(0)) if "offset" in payloads.columns else F.lit(0)
    p = payloads.select("season_id", "bracket", "region", "fetched_at", before.alias("before"), F.posexplode("entries").alias("pos", "e")).where(F.col("before") + F.col("pos") < X.bracket_top_n(F.col("bracket")))
    p = p.select(
        "season_id", "bracket", "region", F.col("fetched_at").alias("snapshot_at"), F.col("e.character.id").alias("character_id"), F.col("e.character.name").alias("name"), F.col("e.character.realm.slug").alias("realm"),
        X.faction_code(F.col("e.faction.type")).alias("faction"), "e.rank", "e.rating", F.coalesce("e.season_match_statistics.won", F.lit(0)).alias("wins"), F.coalesce("e.season_match_statistics.lost", F.lit(0)).alias("losses"),
        X.bracket_class(F.col("bracket")).alias("class_slug"), X.bracket_spec(F.col("bracket")).alias("spec_slug"),
    )
    return best_placement(p, ["season_id", "bracket", "region", "character_id"])


def best_placement(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of several rows of a key that with the lowest rank (then the highest rating)."""
    by = W.partitionBy(*keys).orderBy(F.col("rank").asc_nulls_last(), F.desc("rating"), F.desc("wins"), "losses")
    return rows.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def valid_items(items: Column) -> Column:
    """Items in slots that count, with an item level over 0."""
    return F.filter(items, lambda i: ~F.coalesce(i["slot"]["type"], F.lit("")).isin(*NO_SLOTS) & (F.coalesce(i["level"]["value"], F.lit(0)) > 0))


def equipment(payloads: DataFrame) -> DataFrame:
    """One row a worn item: character_id, spec_id, slot, item_id, item_level, context, bonus_list, enchantment_id,
    enchant_name, enchant_source, sockets, crafting_stats and the map of secondary stats."""
    i = payloads.select("character_id", "spec_id", F.explode(valid_items(F.col("equipped_items"))).alias("i"))
    permanent = F.get(F.filter(F.col("i.enchantments"), lambda e: F.coalesce(e["enchantment_slot"]["type"], F.lit("")) == "PERMANENT"), F.lit(0))
    sockets = F.transform(F.coalesce(F.col("i.sockets"), F.array().cast("array<struct<socket_type:struct<type:string>,item:struct<id:bigint,name:string>,display_string:string>>")), lambda s: F.struct(s["socket_type"]["type"].alias("type"), s["item"]["id"].alias("item_id"), s["display_string"].alias("display_string")))
    names = F.create_map(*[F.lit(x) for kv in STATS.items() for x in kv])
    own = F.filter(F.col("i.stats"), lambda s: F.map_contains_key(names, F.coalesce(s["type"]["type"], F.lit(""))) & ~F.coalesce(s["is_negated"], F.lit(False)))
    stats = F.map_from_entries(F.transform(own, lambda s: F.struct(names[s["type"]["type"]], s["value"])))
    return i.select(
        "character_id", "spec_id", F.col("i.slot.type").alias("slot"), F.col("i.item.id").alias("item_id"), F.col("i.level.value").alias("item_level"), F.col("i.context").try_cast("int").alias("context"),
        F.array_sort(F.coalesce(F.col("i.bonus_list"), F.array().cast("array<int>"))).alias("bonus_list"), permanent["enchantment_id"].alias("enchantment_id"), X.clean_enchant_name(permanent["display_string"]).alias("enchant_name"),
        permanent["source_item"]["id"].alias("enchant_source"), sockets.alias("sockets"), F.coalesce(F.transform(F.col("i.modified_crafting_stat"), lambda c: c["type"]), F.array().cast("array<string>")).alias("crafting_stats"),
        F.coalesce(stats, F.create_map().cast("map<string,int>")).alias("stats"),
    )


def item_dims(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, item_class, item_subclass, inventory_type, quality, media_id), with bare rows for gems and enchant
    sources that no one wears; and enchantments (enchantment_id, name, source_item_id)."""
    i = payloads.select(F.explode(valid_items(F.col("equipped_items"))).alias("i"))
    low = lambda c: F.lower(F.col(c))
    worn = i.groupBy(F.col("i.item.id").alias("item_id")).agg(F.min(F.struct(low("i.item_class.name").alias("item_class"), low("i.item_subclass.name").alias("item_subclass"), low("i.inventory_type.type").alias("inventory_type"), low("i.quality.type").alias("quality"), F.col("i.media.id").alias("media_id"))).alias("d")).select("item_id", "d.*")
    gems = i.select(F.explode("i.sockets").alias("s")).select(F.col("s.item.id").alias("item_id"))
    sources = i.select(F.explode("i.enchantments").alias("e"))
    stubs = gems.union(sources.select(F.col("e.source_item.id").alias("item_id"))).where("item_id is not null").distinct().join(worn, "item_id", "left_anti")
    enchants = sources.where("e.enchantment_id is not null").groupBy(F.col("e.enchantment_id").alias("enchantment_id")).agg(F.min(X.clean_enchant_name(F.col("e.display_string"))).alias("name"), F.min("e.source_item.id").alias("source_item_id"))
    return worn.unionByName(stubs, allowMissingColumns=True), enchants


def gear_summary(payloads: DataFrame) -> DataFrame:
    """character_id, item_level (whole-number mean of the valid slots), and of the first set: id, name, pieces worn, and whether its four-piece effect is active."""
    items = valid_items(F.col("equipped_items"))
    total = F.aggregate(items, F.lit(0), lambda a, i: a + i["level"]["value"])
    s = F.get(F.filter(items, lambda i: i["set"].isNotNull()), F.lit(0))["set"]
    worn = F.size(F.filter(s["items"], lambda x: F.coalesce(x["is_equipped"], F.lit(False))))
    four = F.exists(s["effects"], lambda e: (F.coalesce(e["required_count"], F.lit(0)) == 4) & F.coalesce(e["is_active"], F.lit(False)))
    level = F.when(F.size(items) > 0, F.floor(total / F.size(items)).cast("int"))
    return payloads.select("character_id", level.alias("item_level"), s["item_set"]["id"].alias("tier_set_id"), s["item_set"]["name"].alias("tier_set_name"), F.when(s.isNotNull(), F.coalesce(worn, F.lit(0))).alias("tier_set_pieces"), F.when(s.isNotNull(), F.coalesce(four, F.lit(False))).alias("tier_4p_active"))


def specializations(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Talents (character_id, spec_id, talent_type, talent_id, rank, slot_number) of every spec with an active loadout,
    pvp slots counted from 2; and loadouts (character_id, spec_id, loadout_code, hero_tree_id, hero_tree_name)."""
    s = payloads.select("character_id", F.explode("specializations").alias("s")).select("character_id", F.col("s.specialization.id").cast("int").alias("spec_id"), F.get(F.filter("s.loadouts", lambda x: F.coalesce(x["is_active"], F.lit(False))), F.lit(0)).alias("l"), F.col("s.pvp_talent_slots").alias("pvp"))
    s = s.where("l is not null")
    of = lambda kind, c: s.select("character_id", "spec_id", F.lit(kind).alias("talent_type"), F.explode(c).alias("t")).select("character_id", "spec_id", "talent_type", F.col("t.tooltip.talent.id").alias("talent_id"), F.coalesce("t.rank", F.lit(0)).alias("rank"), F.lit(None).cast("int").alias("slot_number"))
    pvp = s.select("character_id", "spec_id", F.posexplode("pvp").alias("k", "p")).select("character_id", "spec_id", F.lit("pvp").alias("talent_type"), F.col("p.selected.talent.id").alias("talent_id"), F.lit(1).alias("rank"), (F.col("k") + 2).alias("slot_number"))
    talents = of("class", "l.selected_class_talents").union(of("spec", "l.selected_spec_talents")).union(of("hero", "l.selected_hero_talents")).union(pvp).where("talent_id is not null")
    loadouts = s.select("character_id", "spec_id", F.col("l.talent_loadout_code").alias("loadout_code"), F.col("l.selected_hero_talent_tree.id").alias("hero_tree_id"), F.col("l.selected_hero_talent_tree.name").alias("hero_tree_name"))
    return talents, loadouts


def trees(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Talents (spec_id, talent_type, node_id, talent_id, name, spell_id, display_row, display_col, max_rank) and edges
    (node_id, prerequisite_id). Ranks hold one tooltip or a choice of them; hero nodes fall back to the older key."""
    hero = F.flatten(F.transform("hero_talent_trees", lambda t: F.coalesce(t["hero_talent_nodes"], t["nodes"])))
    of = lambda kind, c: payloads.select("spec_id", F.lit(kind).alias("talent_type"), F.explode(c).alias("n"))
    nodes = of("class", "class_talent_nodes").union(of("spec", "spec_talent_nodes")).union(of("hero", hero))
    tips = F.flatten(F.transform("n.ranks", lambda r: F.when(r["tooltip"].isNotNull(), F.array(r["tooltip"])).otherwise(F.coalesce(r["choice_of_tooltips"], F.slice(F.array(r["tooltip"]), 1, 0)))))
    talents = nodes.select("spec_id", "talent_type", F.col("n.id").alias("node_id"), F.explode(tips).alias("t"), F.col("n.display_row").alias("display_row"), F.col("n.display_col").alias("display_col"), F.size("n.ranks").alias("max_rank"))
    talents = talents.select("spec_id", "talent_type", "node_id", F.col("t.talent.id").alias("talent_id"), F.col("t.talent.name").alias("name"), F.col("t.spell_tooltip.spell.id").alias("spell_id"), "display_row", "display_col", "max_rank").where("talent_id is not null").distinct()
    locks = nodes.select(F.col("n.id").alias("node_id"), F.explode("n.locked_by").alias("l"))
    edges = locks.select("node_id", F.coalesce(F.col("l").try_cast("bigint"), F.get_json_object("l", "$.id").try_cast("bigint")).alias("prerequisite_id")).where("prerequisite_id is not null").distinct()
    return talents, edges


def seasons(payloads: DataFrame) -> DataFrame:
    """season_id, display_name, starts_at, ends_at, is_current (that with the highest id)."""
    at = lambda c: F.timestamp_seconds(F.floor(F.col(c) / 1000))
    top = F.max("season_id").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))  # a few rows
    return payloads.select("season_id", F.col("season_name").alias("display_name"), at("season_start_timestamp").alias("starts_at"), at("season_end_timestamp").alias("ends_at"), (F.col("season_id") == top).alias("is_current"))


def media(payloads: DataFrame, keys: tuple[str, ...] = ("avatar", "inset", "main-raw", "icon")) -> DataFrame:
    """id and a column a key (hyphens as underscores) from lists of key and value; the first of equal keys."""
    one = lambda k: F.get(F.filter("assets", lambda a: a["key"] == k), F.lit(0))["value"].alias(k.replace("-", "_"))
    return payloads.select("id", *[one(k) for k in keys])


def profiles(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.col("id").alias("character_id"), "name", F.col("realm.slug").alias("realm"), F.col("race.id").alias("race_id"), F.col("character_class.id").alias("class_id"), X.slug(F.col("character_class.name")).alias("class_slug"), X.faction_code(F.col("faction.type")).alias("faction"))


__all__ = ["best_placement", "equipment", "gear_summary", "item_dims", "leaderboard", "media", "profiles", "read_json", "read_payloads", "schemas", "seasons", "specializations", "trees", "valid_items"]
