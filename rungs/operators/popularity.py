"""Share of a cohort that uses each item, enchant or gem, and what has changed since the version before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X


@dataclass(frozen=True)
class PopularitySpec:
    """What is counted: the item column; the dimensions besides bracket and spec; and of what the count is a share.

    denominator `rows`: of all counted rows of these dimensions. `entities`: of the characters that have a row in
    `base_dims`, even if it holds no item; each character then counts once an item.
    """

    item: str
    dims: tuple[str, ...]
    denominator: str = "rows"
    base_dims: tuple[str, ...] = ()


ITEMS = PopularitySpec("item_id", ("slot",))
ENCHANTS = PopularitySpec("enchantment_id", ("slot",))
GEMS = PopularitySpec("gem_id", ("slot", "socket_type"), "entities", ("slot",))


def counts(cohort: DataFrame, facts: DataFrame, spec: PopularitySpec) -> DataFrame:
    """bracket, spec_id, dims, item, n: how often the cohort has each item; and, where the share is of entities, how many
    characters have a row in base_dims, as rows without an item (the other dims are null too).

    facts: a row for each thing of a character and spec. Counts of parts of a cohort add up to the whole's.
    """
    keys = ["bracket", "spec_id", *spec.dims]
    worn = cohort.select("bracket", "character_id", "spec_id").join(facts, ["character_id", "spec_id"])
    there = F.col(spec.item).isNotNull()
    if spec.denominator == "rows":
        return worn.where(there).groupBy(*keys, spec.item).agg(F.count("*").alias("n"))
    # each character once for its item, and once for what the item is a share of
    base = [F.col(d) if d in spec.base_dims else F.lit(None).cast(worn.schema[d].dataType).alias(d) for d in spec.dims]
    whole = worn.select("bracket", "spec_id", *base, F.lit(None).cast(worn.schema[spec.item].dataType).alias(spec.item), "character_id")
    return worn.where(there).select(*keys, spec.item, "character_id").union(whole).distinct().groupBy(*keys, spec.item).agg(F.count("*").alias("n"))


def shares(counted: DataFrame, spec: PopularitySpec) -> DataFrame:
    """bracket, spec_id, dims, item, usage_count, total, usage_pct of counts(). The total is a sum over the few counted rows."""
    keys = ["bracket", "spec_id", *spec.dims]
    there = F.col(spec.item).isNotNull()
    if spec.denominator == "rows":
        total = F.sum("n").over(W.partitionBy(*keys))
    else:
        total = F.max(F.when(~there, F.col("n"))).over(W.partitionBy("bracket", "spec_id", *spec.base_dims))
    out = counted.withColumn("total", total).where(there).withColumnRenamed("n", "usage_count")
    return out.select(*keys, spec.item, "usage_count", "total", X.pct(F.col("usage_count"), F.col("total")).alias("usage_pct"))


def popularity(cohort: DataFrame, facts: DataFrame, spec: PopularitySpec) -> DataFrame:
    """bracket, spec_id, dims, item, usage_count, total, usage_pct for every item that the cohort has.

    Counted first, so that only sums are shuffled on.
    """
    return shares(counts(cohort, facts, spec), spec)


def popularity_trend(cohorts: DataFrame, facts: DataFrame, spec: PopularitySpec) -> DataFrame:
    """popularity() of each item with the share it had before, and the trend, in one pass: `old` tells the rows of cohorts that are of the version before.

    Shares are of rows. What only the version before had is left out.
    """
    keys = ["bracket", "spec_id", *spec.dims]
    worn = cohorts.select("old", "bracket", "character_id", "spec_id").join(facts.where(F.col(spec.item).isNotNull()), ["character_id", "spec_id"])
    rows = worn.groupBy(*keys, spec.item).agg(F.count_if(~F.col("old")).alias("usage_count"), F.count_if("old").alias("_before"))
    group = W.partitionBy(*keys)
    rows = rows.withColumns({"total": F.sum("usage_count").over(group), "_all": F.sum("_before").over(group)}).where("usage_count > 0")
    before = F.when(F.col("_before") > 0, X.pct(F.col("_before"), F.col("_all")))
    rows = rows.withColumns({"usage_pct": X.pct(F.col("usage_count"), F.col("total")), "prev_usage_pct": before})
    return rows.select(*keys, spec.item, "usage_count", "total", "usage_pct", "prev_usage_pct", X.trend(F.col("usage_pct"), F.col("prev_usage_pct")).alias("trend"))


def socket_rows(items: DataFrame) -> DataFrame:
    """character_id, spec_id, slot, socket_type, gem_id of each socket of items that have any; gem_id is null in an empty one."""
    s = items.where(F.size("sockets") > 0).select("character_id", "spec_id", "slot", F.explode("sockets").alias("s"))
    return s.select("character_id", "spec_id", "slot", F.col("s.type").alias("socket_type"), F.col("s.item_id").alias("gem_id"))


def with_previous(current: DataFrame, previous: DataFrame, keys: list[str], value: str = "usage_pct") -> DataFrame:
    """current with prev_usage_pct of the version before, and the trend."""
    before = previous.select(*keys, F.col(value).alias("prev_usage_pct"))
    return current.join(before, keys, "left").withColumn("trend", X.trend(F.col(value), F.col("prev_usage_pct")))


def merge_variants(rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Rows of one name (keys) as one: counts and shares summed, the previous share where any has one, `keep` from the
    row with the largest share (then the least keep), and the trend anew."""
    top = F.max_by(F.struct(*keep), F.struct("usage_pct", *[(-F.col(c)).alias(f"_{c}") for c in keep]))
    out = rows.groupBy(*keys).agg(F.sum("usage_count").alias("usage_count"), F.sum("usage_pct").alias("_pct"), F.sum("prev_usage_pct").alias("_prev"), top.alias("_top"))
    out = out.withColumns({"usage_pct": X.half_up(F.col("_pct"), 2), "prev_usage_pct": X.half_up(F.col("_prev"), 2)})
    return out.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in keep], "usage_count", "usage_pct", "prev_usage_pct", X.trend(F.col("usage_pct"), F.col("prev_usage_pct")).alias("trend"))


def top_crafting(items: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """item_id, crafting_stats: the commonest non-empty crafting-stat array of each item, the least of equals."""
    rows = items.where(F.size("crafting_stats") > 0)
    if cohort is not None:
        rows = rows.join(cohort.select("character_id", "spec_id").distinct(), ["character_id", "spec_id"], "left_semi")
    counts = rows.groupBy("item_id", "crafting_stats").agg(F.count("*").alias("n"))
    top = W.partitionBy("item_id").orderBy(F.desc("n"), "crafting_stats")
    return counts.withColumn("_k", F.row_number().over(top)).where("_k = 1").select("item_id", "crafting_stats", "n")


def usage_block(rows: DataFrame) -> Column:
    """usage: count, pct, prev_pct and trend as one struct."""
    return F.struct(F.col("usage_count").alias("count"), F.col("usage_pct").cast("double").alias("pct"), F.col("prev_usage_pct").cast("double").alias("prev_pct"), X.trend(F.col("usage_pct"), F.col("prev_usage_pct")).alias("trend")).alias("usage")
