"""Ladders stored by ranges of ranks, with counts beside them that lead a page to the ranges it stands in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.tables import read_parts, write_parts
from .cohort import bracket_scope
from .ladder import filtered

#: A bracket has no more ranges than this: as many counts come to the driver for a page.
RANGES = 256


def store_ladders(ranked: DataFrame, path: str, width: int = 500) -> None:
    """Writes ranked entries (bracket, region, spec_id, rank, entry_id and more), a folder a bracket and range of ranks, in
    order of rank, and the rows of each range by region and spec.

    A range is `width` ranks, or more where the deepest ladder would have over RANGES of them. Entries without a rank or
    with one below 1 are a range of their own before the others. Large ranges are several files.
    """
    deepest = ranked.agg(F.max("rank")).first()[0] or 0
    width = max(width, -(-deepest // (RANGES - 1)))
    place = F.when(F.col("rank") >= 1, F.floor((F.col("rank") - 1) / width).cast("int")).otherwise(-1)
    rows = ranked.withColumn("rank_range", F.coalesce(place, F.lit(-1)))
    parts = rows.repartition("bracket", "rank_range").sortWithinPartitions("bracket", "rank_range", "rank", "entry_id")
    write_parts(parts, path, ["bracket", "rank_range"])
    counts = stored_ladders(ranked.sparkSession, path).groupBy("bracket", "region", "spec_id", "rank_range").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def stored_ladders(spark: SparkSession, path: str) -> DataFrame:
    """The entries of store_ladders() with their rank_range."""
    return read_parts(spark, path)


def stored_page(spark: SparkSession, path: str, bracket: str, page: int = 1, per_page: int = 50, **filters) -> DataFrame:
    """ladder_page() of stored ladders: the same rows and columns, but only the ranges of ranks that hold the page are read.

    Rows of each range are counted first: from the stored counts if the page is filtered by region and spec alone, else
    by one pass over the filters' columns of the bracket, without a sort. At most RANGES counts come to the driver. Pages past the end have no rows.
    """
    per_page = min(500, max(1, per_page))
    skip = (max(1, page) - 1) * per_page
    rows = stored_ladders(spark, path)
    given = {k: v for k, v in filters.items() if v is not None}
    if set(given) <= {"region", "spec_id"}:
        counted = filtered(bracket_scope(spark.read.parquet(f"{path}/counts"), bracket), **given).groupBy("rank_range").agg(F.sum("n").alias("n"))
    else:
        counted = filtered(bracket_scope(rows, bracket), **given).groupBy("rank_range").agg(F.count("*").alias("n"))
    sizes = sorted((r["rank_range"], r["n"]) for r in counted.collect())  # at most RANGES rows
    total = sum(n for _, n in sizes)
    wanted, before, passed = [], 0, 0
    for place, n in sizes:
        if passed + n > skip and passed < skip + per_page:
            if not wanted:
                before = passed
            wanted.append(place)
        passed += n
    near = bracket_scope(rows, bracket).where(F.col("rank_range").isin(wanted) if wanted else F.lit(False))
    out = filtered(near, **given).drop("rank_range").orderBy("rank", "entry_id").offset(skip - before).limit(per_page)
    out = out.withColumn("winrate", X.half_up(X.winrate_pct(F.col("wins"), F.col("losses")), 1))
    return out.withColumn("total_rows", F.lit(total).cast("long")).withColumn("total_pages", F.ceil(F.col("total_rows") / per_page))
