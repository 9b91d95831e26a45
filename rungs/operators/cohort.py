"""The top players of each bracket and specialisation: what all popularity figures are shares of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bracket_scope(entries: DataFrame, slug: str) -> DataFrame:
    """Entries of a bracket; `shuffle` and `blitz` stand for all brackets that begin so."""
    return entries.where(F.col("bracket").startswith(f"{slug}-") if slug in ("shuffle", "blitz") else F.col("bracket") == slug)


def processed(entries: DataFrame, gate: str) -> DataFrame:
    """Entries whose spec is known and whose gate (the time at which a part was processed) is set."""
    return entries.where(F.col("spec_id").isNotNull() & F.col(gate).isNotNull())


#: Parts that the entries of a bracket and spec are ranked and counted in before they meet.
_PARTS = 64


def best_entry(entries: DataFrame, gate: str | None = None, ties: tuple[str, ...] = ("entry_id",), versions: tuple[str, ...] = ()) -> DataFrame:
    """One entry for each character and bracket, over all regions and specs: that with the highest rating, a null one
    above all, then by `ties`. A partial top-1 runs before the shuffle. `versions`: columns whose values are kept apart."""
    e = processed(entries, gate) if gate else entries
    by = W.partitionBy(*versions, "bracket", "character_id").orderBy(F.col("rating").desc_nulls_first(), *ties)
    return e.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def player_weight(rank: Column, size: Column, wins: Column, losses: Column) -> Column:
    """3 for the top 15 % that win over 60 %; 2 for the top half, or over 55 %; else 1."""
    rate = F.try_divide(wins * 100.0, wins + losses)
    return F.when((rank <= size * 0.15) & (rate > 60), 3).when((rank <= size * 0.5) | (rate > 55), 2).otherwise(1)


def top_cohort(entries: DataFrame, gate: str | None = None, top_n: int = 1000, weighted: bool = False, ties: tuple[str, ...] = ("entry_id",), versions: tuple[str, ...] = ()) -> DataFrame:
    """The best entries of each bracket and spec, by rank of rating up to top_n; ties at the cut all stay.

    weighted adds spec_total (entries before the cut) and weight; `versions` are columns whose values are kept apart.
    """
    e = best_entry(entries, gate, ties, versions)
    group = [*versions, "bracket", "spec_id"]
    order = F.col("rating").desc_nulls_first()
    by = W.partitionBy(*group)
    if not weighted:
        return e.withColumn("spec_rank", F.rank().over(by.orderBy(order))).where(F.col("spec_rank") <= top_n)
    # parts of a group are ranked and counted first; only the top of each part meets, and the first row brings the part's size
    part = W.partitionBy(*group, "_part")
    e = e.withColumn("_part", F.pmod(F.xxhash64("character_id"), F.lit(_PARTS)))
    e = e.withColumns({"_rank": F.rank().over(part.orderBy(order)), "_size": F.count("*").over(part), "_first": F.row_number().over(part.orderBy(order)) == 1}).where(F.col("_rank") <= top_n)
    e = e.withColumns({"spec_rank": F.rank().over(by.orderBy(order)), "spec_total": F.sum(F.when(F.col("_first"), F.col("_size"))).over(by)}).where(F.col("spec_rank") <= top_n)
    return e.drop("_part", "_rank", "_size", "_first").withColumn("weight", player_weight(F.col("spec_rank"), F.col("spec_total"), F.col("wins"), F.col("losses")))


def gated(entries: DataFrame, good: Column, least: int = 10) -> DataFrame:
    """Rows for which `good` holds, or all where fewer than `least` do."""
    n = entries.agg(F.count_if(good).alias("_n"))
    return entries.crossJoin(F.broadcast(n)).where((F.col("_n") < least) | good).drop("_n")  # one row


def recent(entries: DataFrame, column: str, as_of: Column, days: int = 60) -> DataFrame:
    return entries.where(F.col(column) >= as_of - F.make_interval(days=F.lit(days)))
