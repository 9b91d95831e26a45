"""Talent rows made fit for publishing: variants merged, stale ones mapped, missing ones filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Which section wins if a talent stands in several.
TYPE_PRIORITY = {"hero": 3, "spec": 2, "class": 1}


def merge_rank_variants(usage: DataFrame, dim: DataFrame) -> DataFrame:
    """One row for each name on a node of a bracket and spec: that with the largest share (then the least talent), with
    the largest default points and rank of all and in_top_build of any. Counts are not added up: every character has a
    row for each rank. Rows without a node stay as they are. dim: talent_id, node_id, name."""
    rows = usage.join(dim.select("talent_id", "node_id", "name"), "talent_id", "left")
    by = W.partitionBy("bracket", "spec_id", "node_id", "name")
    top = F.row_number().over(by.orderBy(F.desc("usage_pct"), "talent_id"))
    merged = rows.where("node_id is not null").withColumns({"_k": top, "_points": F.max("default_points").over(by), "_in": F.bool_or("in_top_build").over(by), "_rank": F.max("top_build_rank").over(by)}).where("_k = 1")
    merged = merged.withColumns({"default_points": F.col("_points"), "in_top_build": F.col("_in"), "top_build_rank": F.col("_rank")})
    return merged.select(*rows.columns).unionByName(rows.where("node_id is null")).select(*usage.columns)


def merge_stale_variants(usage: DataFrame, names: DataFrame, assignments: DataFrame) -> DataFrame:
    """Rows of one name in a bracket and spec, by which of their talents are assigned to the spec: one, and only it
    stays; several, and all stay; none, and the row with the largest share takes the one assigned talent of that name,
    if there is just one, else all stay. A talent without a name has none in common with others.
    names: talent_id, name; assignments: talent_id, spec_id."""
    given = assignments.select("talent_id", "spec_id").distinct()
    rows = usage.join(names.select("talent_id", "name"), "talent_id", "left").join(given.withColumn("_given", F.lit(1)), ["talent_id", "spec_id"], "left")
    rows = rows.withColumn("_name", F.coalesce(F.concat(F.lit("n"), "name"), F.concat(F.lit("t"), F.col("talent_id").cast("string"))))
    by = W.partitionBy("bracket", "spec_id", "_name")
    rows = rows.withColumns({"_n": F.count("_given").over(by), "_all": F.count("*").over(by), "_k": F.row_number().over(by.orderBy(F.desc("usage_pct"), "talent_id"))})
    canon = given.join(names.select("talent_id", "name"), "talent_id").where("name is not null").groupBy("spec_id", "name").agg(F.count("*").alias("_c"), F.min("talent_id").alias("_to")).where("_c = 1")
    rows = rows.join(canon, ["spec_id", "name"], "left")
    moved = (F.col("_n") == 0) & F.col("_to").isNotNull()
    rows = rows.where((F.col("_all") == 1) & ~moved | F.when(F.col("_n") == 1, F.col("_given") == 1).when(moved, F.col("_k") == 1).otherwise(F.lit(True)))
    return rows.withColumn("talent_id", F.when(moved, F.col("_to")).otherwise(F.col("talent_id"))).select(*usage.columns)


def drop_unresolvable(usage: DataFrame, dim: DataFrame, assignments: DataFrame) -> DataFrame:
    """Without rows that have neither an assignment to their spec nor an icon. dim: talent_id, icon."""
    rows = usage.join(assignments.select("talent_id", "spec_id").distinct().withColumn("_given", F.lit(1)), ["talent_id", "spec_id"], "left").join(dim.select("talent_id", F.col("icon").alias("_icon")), "talent_id", "left")
    return rows.where("_given is not null or _icon is not null").select(*usage.columns)


def zero_fill(rows: DataFrame, assignments: DataFrame, dim: DataFrame, pvp_users: DataFrame) -> DataFrame:
    """rows and, with a share of 0, the talents of their bracket and spec that no one uses: those assigned to the spec
    whose (node, name) isn't there yet (one a pair: that with an icon, then the least), and pvp talents that anyone of
    the spec has. Filled-in rows are bis if they have default points, else common.

    dim: talent_id, node_id, name, icon, talent_type; assignments: talent_id, spec_id, default_points; pvp_users:
    talent_id, spec_id.
    """
    wanted = assignments.join(dim, "talent_id")
    pairs = W.partitionBy("spec_id", "node_id", "name").orderBy(F.col("icon").isNull(), "talent_id")
    single = wanted.where("node_id is not null").withColumn("_k", F.row_number().over(pairs)).where("_k = 1").drop("_k").unionByName(wanted.where("node_id is null"))
    pvp = pvp_users.select("talent_id", "spec_id").distinct().join(dim.where("talent_type = 'pvp'"), "talent_id").join(assignments.select("talent_id", "spec_id"), ["talent_id", "spec_id"], "left_anti").withColumn("default_points", F.lit(0))
    groups = rows.select("bracket", "spec_id").distinct()
    cand = single.unionByName(pvp.select(*single.columns)).join(groups, "spec_id")
    there = rows.join(dim.select("talent_id", "node_id", "name"), "talent_id")
    cand = cand.join(rows.select("bracket", "spec_id", "talent_id"), ["bracket", "spec_id", "talent_id"], "left_anti")
    covered = there.where("node_id is not null").select("bracket", "spec_id", "node_id", F.col("name").alias("_name")).distinct()
    same = (cand["bracket"] == covered["bracket"]) & (cand["spec_id"] == covered["spec_id"]) & (cand["node_id"] == covered["node_id"]) & cand["name"].eqNullSafe(covered["_name"])
    cand = cand.join(covered, same, "left_anti")
    zero = cand.select("bracket", "spec_id", "talent_id", "talent_type", "default_points", F.lit(0).cast("long").alias("usage_count"), F.lit(0.0).alias("usage_pct"), F.when(F.col("default_points") > 0, "bis").otherwise("common").alias("tier"))
    return rows.select(*zero.columns).unionByName(zero)


def integrity_check(rows: DataFrame) -> DataFrame:
    """bracket, spec_id of the groups without any row of type hero."""
    return rows.select("bracket", "spec_id").distinct().join(rows.where("talent_type = 'hero'").select("bracket", "spec_id").distinct(), ["bracket", "spec_id"], "left_anti")


def response_meta(rows: DataFrame, players: DataFrame) -> DataFrame:
    """bracket, spec_id, total_weighted, total_players, stale_count, confidence. players: bracket, spec_id, total_players."""
    stale = F.col("talent_type").isin("class", "spec") & (F.col("usage_pct") < 1) & ~F.col("in_top_build") & (F.col("tier") == "common")
    out = rows.groupBy("bracket", "spec_id").agg(F.sum("usage_count").alias("total_weighted"), F.count_if(stale).alias("stale_count")).join(players, ["bracket", "spec_id"], "left")
    out = out.withColumn("total_players", F.coalesce("total_players", F.lit(0)))
    return out.withColumn("confidence", X.confidence(F.col("total_players"), F.col("stale_count")))


def section_type(rows: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """talent_id, talent_type: hero over spec over class where a talent stands in several sections; a talent that is hero stays hero."""
    rank = F.create_map(*[F.lit(x) for kv in TYPE_PRIORITY.items() for x in kv])
    out = rows.groupBy("talent_id").agg(F.max_by("talent_type", rank[F.col("talent_type")]).alias("talent_type"))
    if current is None:
        return out
    was = current.select("talent_id", F.col("talent_type").alias("_was"))
    return out.join(was, "talent_id", "left").select("talent_id", F.when(F.col("_was") == "hero", "hero").otherwise(F.col("talent_type")).alias("talent_type"))


def apply_assignments(current: DataFrame, new: DataFrame, specs_done: DataFrame) -> DataFrame:
    """Assignments (talent_id, spec_id, talent_type, default_points) after a sync: of the specs that were read
    (specs_done) and the types seen for them, exactly the new ones; everything else as it was."""
    seen = new.join(specs_done, "spec_id", "left_semi").select("spec_id", "talent_type").distinct()
    fresh = new.join(specs_done, "spec_id", "left_semi")
    return current.join(seen, ["spec_id", "talent_type"], "left_anti").unionByName(fresh.select(*current.columns).distinct())
