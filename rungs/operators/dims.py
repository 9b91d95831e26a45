"""Repairs of dimensions: siblings, variants, neighbours, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def orphan_nodes(talents: DataFrame) -> DataFrame:
    """talents with the node of a talent of the same name and type where there is none (the least node of such)."""
    named = talents.where("node_id is not null and name is not null").groupBy("name", "talent_type").agg(F.min("node_id").alias("_node"))
    return talents.join(named, ["name", "talent_type"], "left").withColumn("node_id", F.coalesce("node_id", "_node")).drop("_node")


def crowded_nodes(points: DataFrame, near: int = 5, least: int = 8) -> DataFrame:
    """node_id, n of the nodes with `least` or more hero nodes (is_hero) within `near` ids, themselves counted if they are.

    A band join: ids are put in bins as wide as the band, and a node looks into its own bin and the two beside it.
    """
    nodes = points.select("node_id").distinct()
    heroes = points.where("is_hero").groupBy("node_id").agg(F.count("*").alias("_c")).select(F.col("node_id").alias("_hero"), "_c", F.floor(F.col("node_id") / near).alias("_bin"))
    looks = nodes.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("node_id") / near) + d)))
    met = looks.join(heroes, "_bin").where(F.col("_hero").between(F.col("node_id") - near, F.col("node_id") + near))
    return met.groupBy("node_id").agg(F.sum("_c").alias("n")).where(F.col("n") >= least)


def gateway_repair(talents: DataFrame, near: int = 5, least: int = 8) -> DataFrame:
    """talents with type hero on nodes that hold a hero talent, and then on nodes with many hero nodes around."""
    placed = talents.where("node_id is not null")  # the others may be many, and would be one group
    hero = F.bool_or(F.col("talent_type") == "hero").over(W.partitionBy("node_id"))
    t = placed.withColumn("_h", hero).withColumn("talent_type", F.when(F.col("_h"), "hero").otherwise(F.col("talent_type"))).drop("_h")
    t = t.unionByName(talents.where("node_id is null"))
    points = t.where("node_id is not null").groupBy("node_id").agg(F.bool_or(F.col("talent_type") == "hero").alias("is_hero"))
    close = crowded_nodes(points, near, least).select("node_id", F.lit(True).alias("_near"))
    return t.join(close, "node_id", "left").withColumn("talent_type", F.when(F.col("_near"), "hero").otherwise(F.col("talent_type"))).drop("_near")


def sibling_assignments(talents: DataFrame, assignments: DataFrame) -> DataFrame:
    """talent_id, spec_id of the assignments that ranked nodes (max_rank over 1) lack: what one talent of a node has, all of it get."""
    ranked = talents.where("node_id is not null and max_rank > 1").select("talent_id", "node_id")
    given = ranked.join(assignments.select("talent_id", "spec_id"), "talent_id").select("node_id", "spec_id").distinct()
    return ranked.join(given, "node_id").select("talent_id", "spec_id").join(assignments.select("talent_id", "spec_id"), ["talent_id", "spec_id"], "left_anti")


def source_items(enchants: DataFrame) -> DataFrame:
    """enchantment_id, source_item_id: the least item that each enchant comes from."""
    return enchants.where("source_item_id is not null").groupBy("enchantment_id").agg(F.min("source_item_id").alias("source_item_id"))


def with_stubs(dim: DataFrame, rows: DataFrame, vendor: str, key: str, buckets: int = 256) -> DataFrame:
    """dim and, for each vendor's id in rows that it lacks, a row with the id and a key of its own above all others; its
    other columns are null. New keys are numbered in buckets, so that they are not all put in one order."""
    new = rows.select(vendor).where(F.col(vendor).isNotNull()).distinct().join(dim.select(vendor), vendor, "left_anti")
    new = new.withColumn("_b", F.pmod(F.xxhash64(vendor), F.lit(buckets))).withColumn("_k", F.row_number().over(W.partitionBy("_b").orderBy(vendor)))
    sizes = new.groupBy("_b").agg(F.max("_k").alias("_n"))
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))  # a row a bucket
    top = dim.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    kind = dim.schema[key].dataType
    stubs = new.join(F.broadcast(starts), "_b").crossJoin(F.broadcast(top)).select(vendor, (F.col("_top") + F.col("_s") + F.col("_k")).cast(kind).alias(key))  # one row, a row a bucket
    return dim.unionByName(stubs, allowMissingColumns=True)


def repoint(rows: DataFrame, dim: DataFrame, vendor: str, key: str) -> DataFrame:
    """rows with the surrogate key of dim (vendor, key; see with_stubs()) in place of the vendor's id; rows without an id are left out."""
    return rows.join(dim.select(vendor, key), vendor).drop(vendor)


def copy_points(assignments: DataFrame, talents: DataFrame) -> DataFrame:
    """assignments with the default points of their talent where these are over 0."""
    p = talents.where("default_points > 0").select("talent_id", F.col("default_points").alias("_p"))
    return assignments.join(p, "talent_id", "left").withColumn("default_points", F.coalesce("_p", "default_points")).drop("_p")


def prune_rare(assignments: DataFrame, talents: DataFrame, used: DataFrame, least: int = 3) -> DataFrame:
    """assignments without those of spec talents that fewer than `least` rows of character talents of the spec use."""
    n = used.groupBy("talent_id", "spec_id").agg(F.count("*").alias("_n"))
    rows = assignments.join(talents.select("talent_id", F.col("talent_type").alias("_type")), "talent_id", "left").join(n, ["talent_id", "spec_id"], "left")
    return rows.where((F.coalesce("_type", F.lit("")) != "spec") | (F.coalesce("_n", F.lit(0)) >= least)).select(*assignments.columns)


def variant_max_rank(talents: DataFrame) -> DataFrame:
    """talents with the number of talents on the node as max_rank where there are several."""
    n = F.count("*").over(W.partitionBy("node_id"))
    placed = talents.where("node_id is not null").withColumn("_n", n)
    placed = placed.withColumn("max_rank", F.when(F.col("_n") > 1, F.col("_n").cast("int")).otherwise(F.col("max_rank"))).drop("_n")
    return placed.unionByName(talents.where("node_id is null"))


def fake_rank_nodes(talents: DataFrame, used: DataFrame) -> DataFrame:
    """node_id of the nodes whose several variants share one name while no one has a rank over 1: their max_rank is 1."""
    nodes = talents.where("node_id is not null").join(used.groupBy("talent_id").agg(F.max("rank").alias("_r")), "talent_id", "left").groupBy("node_id")
    nodes = nodes.agg(F.count("*").alias("variants"), F.countDistinct("name").alias("names"), F.coalesce(F.max("_r"), F.lit(0)).alias("top"))
    return nodes.where("variants > 1 and names = 1 and top <= 1").select("node_id")


def assignment_counts(assignments: DataFrame, talents: DataFrame) -> DataFrame:
    """talent_type, n: assignments of each type."""
    return assignments.join(talents.select("talent_id", "talent_type"), "talent_id").groupBy("talent_type").agg(F.count("*").alias("n"))


def latest_per_key(rows: DataFrame, keys: list[str], at: str, ident: str) -> DataFrame:
    """Of each key the row with the newest `at` (null last), then the highest `ident`."""
    by = W.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.desc(ident))
    return rows.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def latest_spec(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows with the spec of their character's newest entry that has one, where they have none."""
    last = entries.where("spec_id is not null").groupBy("character_id").agg(F.max_by("spec_id", F.struct("snapshot_at", "entry_id")).alias("_spec"))
    return rows.join(last, "character_id", "left").withColumn("spec_id", F.coalesce("spec_id", "_spec")).drop("_spec")


def without_entries(characters: DataFrame, entries: DataFrame) -> DataFrame:
    return characters.join(entries.select("character_id").distinct(), "character_id", "left_anti")


def dropped_entries(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("leaderboard", "character_id")) -> DataFrame:
    """Entries of ladders in `new` whose character is no longer there; ladders that `new` has no rows of are passed over."""
    return old.join(new.select(keys[0]).distinct(), keys[0], "left_semi").join(new.select(*keys), list(keys), "left_anti")


def without_rows(characters: DataFrame, rows: DataFrame) -> DataFrame:
    """Characters that have none of the rows (items, say)."""
    return characters.join(rows.select("character_id").distinct(), "character_id", "left_anti")


def processed_without(entries: DataFrame, gate: str, rows: DataFrame) -> DataFrame:
    """Entries that passed the gate although their character has none of the rows that it stands for."""
    return without_rows(entries.where(F.col(gate).isNotNull()), rows)
