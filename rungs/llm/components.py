"""Connected components by large-star and small-star steps: joins and sums alone, written out after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of the component) of every node that links (a, b: longs) name.

    Null ends and loops are left out; an empty table gives an empty result. A hub's neighbours are never gathered:
    the least one is a partial sum, and the join that hands it out can be split.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "links")
    before = None
    for _ in range(most_rounds):
        # large star: each neighbour above a node is linked with the least of the node and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each neighbour below a node, and the node, are linked with the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = written(small, "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("x")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not found in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
