"""Talent usage of a weighted cohort, its commonest build, and the rank each talent is commonly taken at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X

BIS, SITUATIONAL = 75.0, 50.0


def sql_tier(default_points: Column, usage_pct: Column) -> Column:
    """The tier that a talent has until its node is looked at."""
    return F.when((default_points > 0) | (usage_pct > BIS), "bis").when(usage_pct > SITUATIONAL, "situational").otherwise("common")


def _worn(cohort: DataFrame, talents: DataFrame) -> DataFrame:
    return cohort.select("bracket", "character_id", "spec_id", "weight").join(talents, ["character_id", "spec_id"])


def weighted_usage(cohort: DataFrame, talents: DataFrame, dim: DataFrame, assignments: DataFrame) -> DataFrame:
    """bracket, spec_id, talent_id, talent_type, default_points, usage_count, usage_pct, tier.

    usage_count: weight of the characters that have the talent, at any rank; usage_pct: of the cohort's whole weight,
    to four decimals. dim: talent_id, talent_type; assignments: talent_id, spec_id, default_points.
    """
    totals = cohort.groupBy("bracket", "spec_id").agg(F.sum("weight").alias("total"))
    used = _worn(cohort, talents).groupBy("bracket", "spec_id", "talent_id").agg(F.sum("weight").alias("usage_count"))
    rows = used.join(dim.select("talent_id", "talent_type"), "talent_id").join(assignments.select("talent_id", "spec_id", "default_points"), ["talent_id", "spec_id"], "left").join(totals, ["bracket", "spec_id"])
    rows = rows.withColumns({"default_points": F.coalesce("default_points", F.lit(0)), "usage_pct": X.pct(F.col("usage_count"), F.col("total"), 4)})
    return rows.select("bracket", "spec_id", "talent_id", "talent_type", "default_points", "usage_count", "usage_pct", sql_tier(F.col("default_points"), F.col("usage_pct")).alias("tier"))


def modal_build(cohort: DataFrame, talents: DataFrame) -> DataFrame:
    """bracket, spec_id, build, build_weight: the sorted talents (rank over 0) that most weight has whole; of equals the least array."""
    builds = _worn(cohort, talents.where("rank > 0")).groupBy("bracket", "spec_id", "character_id", "weight").agg(F.array_sort(F.collect_list("talent_id")).alias("build"))
    weights = builds.groupBy("bracket", "spec_id", "build").agg(F.sum("weight").alias("build_weight"))
    top = W.partitionBy("bracket", "spec_id").orderBy(F.desc("build_weight"), "build")
    return weights.withColumn("_k", F.row_number().over(top)).where("_k = 1").drop("_k")


def modal_rank(cohort: DataFrame, talents: DataFrame) -> DataFrame:
    """bracket, spec_id, talent_id, top_build_rank: the rank over 0 with the most weight in the whole cohort; of equals the least."""
    ranks = _worn(cohort, talents.where("rank > 0")).groupBy("bracket", "spec_id", "talent_id", "rank").agg(F.sum("weight").alias("w"))
    return ranks.groupBy("bracket", "spec_id", "talent_id").agg(F.max_by("rank", F.struct("w", -F.col("rank"))).alias("top_build_rank"))


def with_build(usage: DataFrame, builds: DataFrame, ranks: DataFrame) -> DataFrame:
    """usage with in_top_build and top_build_rank (0 where no one has a rank)."""
    inside = builds.select("bracket", "spec_id", F.explode("build").alias("talent_id")).distinct().withColumn("_in", F.lit(True))
    keys = ["bracket", "spec_id", "talent_id"]
    rows = usage.join(inside, keys, "left").join(ranks, keys, "left")
    return rows.withColumns({"in_top_build": F.coalesce("_in", F.lit(False)), "top_build_rank": F.coalesce("top_build_rank", F.lit(0))}).drop("_in")


def with_talents(cohort: DataFrame, talents: DataFrame) -> DataFrame:
    """cohort with `talents`, an array of (talent_id, rank); null for characters that have none."""
    own = talents.groupBy("character_id", "spec_id").agg(F.collect_list(F.struct("talent_id", "rank")).alias("talents"))  # tens a character
    return cohort.join(own, ["character_id", "spec_id"], "left")


def usage_facts(cohort: DataFrame) -> DataFrame:
    """bracket, spec_id, kind, talent_id, rank, build, n: weights of a weighted cohort with_talents(), summed: of the group
    (kind 0), of each build (1) and of each talent at each rank (2). Sums of parts of a cohort add up to the whole's."""
    ids = F.array_sort(F.transform(F.filter("talents", lambda t: t["rank"] > 0), lambda t: t["talent_id"]))
    none = F.lit(None)
    fact = lambda kind, talent, rank, build: F.struct(F.lit(kind).alias("kind"), talent.cast("long").alias("talent_id"), rank.cast("int").alias("rank"), build.cast("array<long>").alias("build"))
    facts = F.concat(
        F.array(fact(0, none, none, none)),
        F.when(F.size(ids) > 0, F.array(fact(1, none, none, ids))).otherwise(F.array()),
        F.coalesce(F.transform("talents", lambda t: fact(2, t["talent_id"], t["rank"], none)), F.array()),
    )
    rows = cohort.select("bracket", "spec_id", "weight", F.explode(facts).alias("f"))
    return rows.groupBy("bracket", "spec_id", "f.kind", "f.talent_id", "f.rank", "f.build").agg(F.sum("weight").alias("n"))


def usage_of(facts: DataFrame, dim: DataFrame, assignments: DataFrame) -> DataFrame:
    """Usage, tier, in_top_build and top_build_rank of the talents of usage_facts(). What is left of a group there, its
    talents by rank and its builds, is weighed in one window."""
    group = W.partitionBy("bracket", "spec_id")
    best = group.orderBy(F.when(F.col("kind") == 1, F.col("n")).desc_nulls_last(), "build").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = facts.withColumns({"total": F.max(F.when(F.col("kind") == 0, F.col("n"))).over(group), "top": F.first("build").over(best)}).where("kind = 2")
    ranked = F.max_by("rank", F.when(F.col("rank") > 0, F.struct("n", -F.col("rank"))))
    used = rows.groupBy("bracket", "spec_id", "talent_id").agg(F.sum("n").alias("usage_count"), F.max("total").alias("total"), F.bool_or(F.array_contains("top", F.col("talent_id"))).alias("in_top_build"), F.coalesce(ranked, F.lit(0)).alias("top_build_rank"))
    rows = used.join(dim.select("talent_id", "talent_type"), "talent_id").join(assignments.select("talent_id", "spec_id", "default_points"), ["talent_id", "spec_id"], "left")
    rows = rows.withColumns({"default_points": F.coalesce("default_points", F.lit(0)), "in_top_build": F.coalesce("in_top_build", F.lit(False)), "usage_pct": X.pct(F.col("usage_count"), F.col("total"), 4)})
    tier = sql_tier(F.col("default_points"), F.col("usage_pct")).alias("tier")
    return rows.select("bracket", "spec_id", "talent_id", "talent_type", "default_points", "usage_count", "usage_pct", tier, "in_top_build", "top_build_rank")


def full_usage(cohort: DataFrame, dim: DataFrame, assignments: DataFrame) -> DataFrame:
    """What with_build() makes of weighted_usage(), modal_build() and modal_rank(), in one pass over a weighted cohort with_talents()."""
    return usage_of(usage_facts(cohort), dim, assignments)
