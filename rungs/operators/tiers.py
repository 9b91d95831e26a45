"""Tiers of talents: by budget and choice nodes, by natural breaks, and by connected parts of the hero graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage

#: Points to spend in each tree, and the percentages at which tiers begin.
BUDGETS = {"class": 34, "spec": 34, "hero": 10}
BIS, SITUATIONAL, COMMON, CONTESTED, OFF_TREE = 75.0, 50.0, 35.0, 30.0, 30.0
_GROUP = ["bracket", "spec_id", "talent_type"]


def node_rows(usage: DataFrame, dim: DataFrame) -> DataFrame:
    """usage with node_id, name and max_rank, and the node's primary talent: that with the largest share, then the least id."""
    rows = usage.join(dim.select("talent_id", "node_id", "name", "max_rank"), "talent_id").where("node_id is not null")
    by = W.partitionBy(*_GROUP, "node_id")
    top = F.max(F.struct("usage_pct", (-F.col("talent_id")).alias("t"), F.coalesce("max_rank", F.lit(1)).alias("cost"))).over(by)
    return rows.withColumns({
        "primary_pct": top["usage_pct"], "is_primary": F.col("talent_id") == -top["t"], "cost": top["cost"], "node_in_build": F.bool_or("in_top_build").over(by),
        "choice": F.size(F.collect_set("name").over(by)) > 1, "gap": top["usage_pct"] - F.max(F.when(F.col("talent_id") != -top["t"], F.col("usage_pct"))).over(by),
    })


def split_choice(node_tier: Column) -> Column:
    """A talent's tier from its node's: on a choice node the alternatives drop a step, and if one is within 30 points of
    the primary of a bis node, all are situational."""
    contested = F.coalesce(F.col("gap") <= CONTESTED, F.lit(False))
    drop = F.when(contested | ((node_tier == "bis") & (F.col("usage_pct") >= COMMON)), "situational").otherwise("common")
    chosen = F.when((node_tier == "bis") & contested, "situational").when(F.col("is_primary"), node_tier).otherwise(drop)
    return F.when(F.col("choice") & (node_tier != "common"), chosen).otherwise(node_tier)


def budget_tiers(usage: DataFrame, dim: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    """usage rows of class and spec nodes with node_tier and tier.

    Nodes of the commonest build are bought by falling share of their primary (then the least node) while the budget
    lasts, passing over those that cost too much; the others are situational from half the least share bought on (50
    if none was).
    """
    budgets = budgets or BUDGETS
    rows = node_rows(usage.where(F.col("talent_type").isin("class", "spec")), dim)
    nodes = rows.groupBy(*_GROUP, "node_id").agg(F.max("primary_pct").alias("p"), F.max("cost").alias("cost"), F.bool_or("node_in_build").alias("built"))
    budget = F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv])[F.col("talent_type")]
    queue = F.array_sort(F.collect_list(F.when(F.col("built"), F.struct((-F.col("p")).alias("p"), F.col("node_id").alias("node"), F.col("cost").cast("int").alias("cost")))))
    groups = nodes.groupBy(*_GROUP).agg(queue.alias("queue"))
    start = F.struct(budget.cast("int").alias("left"), F.array().cast("array<bigint>").alias("got"), F.lit(None).cast("double").alias("least"))

    def buy(acc: Column, n: Column) -> Column:
        fits = n["cost"] <= acc["left"]
        return F.struct(F.when(fits, acc["left"] - n["cost"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.array_append(acc["got"], n["node"].cast("bigint"))).otherwise(acc["got"]).alias("got"), F.when(fits, -n["p"]).otherwise(acc["least"]).cast("double").alias("least"))

    bought = groups.withColumn("b", F.aggregate("queue", start, buy)).select(*_GROUP, F.col("b.got").alias("got"), F.coalesce(F.col("b.least") * 0.5, F.lit(SITUATIONAL)).alias("from"))
    rows = rows.join(bought, _GROUP)
    tier = F.when(F.array_contains("got", F.col("node_id").cast("bigint")), "bis").when(F.col("primary_pct") >= F.col("from"), "situational").otherwise("common")
    rows = rows.withColumn("node_tier", tier)
    return rows.withColumn("tier", split_choice(F.col("node_tier"))).select(*_GROUP, "talent_id", "node_id", "usage_pct", "node_tier", "tier")


def natural_breaks(values: np.ndarray, k: int = 3) -> list[float]:
    """First value of each class but the lowest in the split of sorted values into k classes with the least squared
    deviation; none for k values or fewer. The sums of squares of all runs come from prefix sums, a class at a time."""
    v = np.sort(np.asarray(values, float))
    n = len(v)
    if n <= k:
        return []
    one, two = np.concatenate([[0], v.cumsum()]), np.concatenate([[0], (v * v).cumsum()])
    i, j = np.arange(n)[:, None], np.arange(n)[None, :]
    count = np.maximum(j - i + 1, 1)
    run = np.where(j >= i, (two[j + 1] - two[i]) - (one[j + 1] - one[i]) ** 2 / count, np.inf)
    cost, starts = run[0].copy(), []
    for _ in range(k - 1):
        # the last class starts at s: the best split before it, and its own run
        total = np.concatenate([np.full((1, n), np.inf), cost[:-1, None] + run[1:]], axis=0)
        total = np.where(j >= i, total.round(9), np.inf)  # of splits that are equal but for rounding, the first
        starts.append(total.argmin(axis=0))
        cost = total.min(axis=0)
    at, out = n - 1, []
    for s in reversed(starts):
        out.append(float(v[s[at]]))
        at = int(s[at]) - 1
    return out[::-1]


def jenks_tiers(usage: DataFrame, k: int = 3) -> DataFrame:
    """bracket, spec_id, talent_id, usage_pct, tier of pvp talents, by natural breaks of each group; by 75 and 50 in groups
    of k or fewer. A group is the pvp talents of one spec: tens of rows."""

    def tiers(g: pd.DataFrame) -> pd.DataFrame:
        breaks = natural_breaks(g["usage_pct"].to_numpy(), k)
        sit, bis = (breaks[0], breaks[1]) if len(breaks) > 1 else (SITUATIONAL, BIS)
        return g.assign(tier=np.where(g["usage_pct"] >= bis, "bis", np.where(g["usage_pct"] >= sit, "situational", "common")))

    rows = usage.where("talent_type = 'pvp'").select("bracket", "spec_id", "talent_id", F.col("usage_pct").cast("double").alias("usage_pct"))
    return rows.groupBy("bracket", "spec_id").applyInPandas(tiers, f"bracket string, spec_id {dict(rows.dtypes)['spec_id']}, talent_id {dict(rows.dtypes)['talent_id']}, usage_pct double, tier string")


#: Edges that a group's own task may hold.
FEW = 10_000


def least_reached(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the least node that it is connected with by edges a, b, by union-find: the lesser root stays."""
    root = {n: n for n in nodes.tolist()}

    def top(n: int) -> int:
        while root[n] != n:
            root[n] = root[root[n]]  # halves the way for those who come after
            n = root[n]
        return n

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = top(x), top(y)
        root[max(x, y)] = min(x, y)
    return np.array([top(n) for n in nodes.tolist()], dtype=np.int64)


def components(nodes: DataFrame, links: DataFrame, key: list[str], few: bool = False) -> DataFrame:
    """nodes (key, node_id) with component, the least node of a group's connected part. links: key, a, b, both ends among nodes.

    Groups of up to FEW links are one task's each, in one pass, by union-find. In larger ones labels spread round by round.
    `few` says that no group has more, which saves counting them. Nodes are whole numbers; null keys are a group.
    """
    if few:
        return _in_groups(nodes, links, key)
    nodes, links = cut_lineage(nodes), cut_lineage(links)
    many = cut_lineage(links.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select(*[F.col(k).alias(f"_many_{k}") for k in key]))
    if many.isEmpty():
        return _in_groups(nodes, links, key)
    same = [F.col(k).eqNullSafe(F.col(f"_many_{k}")) for k in key]
    small = _in_groups(nodes.join(many, same, "left_anti"), links.join(many, same, "left_anti"), key)
    return small.unionByName(_by_rounds(nodes.join(many, same, "left_semi"), links.join(many, same, "left_semi"), key))


def _in_groups(nodes: DataFrame, links: DataFrame, key: list[str]) -> DataFrame:
    def connected(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        return n.assign(component=least_reached(n["node_id"].to_numpy(), e["a"].to_numpy(), e["b"].to_numpy()))

    nodes = nodes.select(*key, F.col("node_id").cast("long").alias("node_id"))
    own = [f"_of_{k}" for k in key]  # links may come out of the nodes: columns of other names are never taken for theirs
    links = links.select(*[F.col(k).alias(o) for k, o in zip(key, own)], F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    schema = ", ".join(f"{n} {t}" for n, t in nodes.dtypes) + ", component long"
    return nodes.groupBy(*key).cogroup(links.groupBy(*own)).applyInPandas(connected, schema).where("node_id is not null")


def _by_rounds(nodes: DataFrame, links: DataFrame, key: list[str]) -> DataFrame:
    """A label, the least node known to be connected, spreads along the links and then from label to label, until none
    changes: few rounds, for long paths too. Each round is written out."""
    # keys may be null, which plain joins pass over
    group = F.to_json(F.struct(*key))
    ends = links.select(group.alias("_g"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    ends = cut_lineage(ends.union(ends.select("_g", "b", "a")).where("a <> b").distinct())
    labels = nodes.select(*key, group.alias("_g"), F.col("node_id").cast("long").alias("node_id")).withColumn("component", F.col("node_id"))
    while True:
        # a node, and the node that is its label, hear of the labels beside it
        of = labels.select("_g", "node_id", "component")
        heard = ends.join(of.toDF("_g", "a", "_ca"), ["_g", "a"]).join(of.toDF("_g", "b", "_cb"), ["_g", "b"])
        least = heard.select("_g", F.explode(F.array_distinct(F.array("a", "_ca"))).alias("node_id"), "_cb").groupBy("_g", "node_id").agg(F.min("_cb").alias("_near"))
        spread = labels.join(least, ["_g", "node_id"], "left").withColumn("_near", F.least("component", "_near"))
        # what the label itself is labelled with
        spread = spread.join(of.select("_g", F.col("node_id").alias("_near"), F.col("component").alias("_far")), ["_g", "_near"]).withColumn("_new", F.least("_near", "_far"))
        spread = cut_lineage(spread.select(*key, "_g", "node_id", F.col("_new").alias("component"), (F.col("_new") < F.col("component")).cast("int").alias("_moved")))
        labels = spread.drop("_moved")
        if not spread.agg(F.max("_moved")).first()[0]:
            return labels.drop("_g")


def hero_tiers(usage: DataFrame, dim: DataFrame, edges: DataFrame) -> DataFrame:
    """usage rows of hero nodes with component and tier: the connected part with the largest mean share (then the least
    node) is bis, choice nodes split; other parts are situational from a mean of 30 on, else common.

    edges: node_id, prerequisite_id, of which those between present nodes of one bracket and spec count (see components()).
    """
    rows = node_rows(usage.where("talent_type = 'hero'"), dim)
    key = ["bracket", "spec_id"]
    nodes = rows.select(*key, "node_id").distinct()
    pairs = edges.select(F.col("node_id").alias("a"), F.col("prerequisite_id").alias("b"))
    present = nodes.join(pairs, nodes["node_id"] == pairs["a"]).select(*key, "a", "b")
    present = present.join(nodes.withColumnRenamed("node_id", "b"), [*key, "b"])
    labels = components(nodes, present, key, few=pairs.limit(FEW + 1).count() <= FEW)
    rows = rows.join(labels, [*key, "node_id"])
    means = rows.groupBy(*key, "component").agg(F.avg("usage_pct").alias("mean_pct"))
    first = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("mean_pct"), "component")) == 1
    rows = rows.join(means.withColumn("selected", first), [*key, "component"])
    off = F.when(F.col("mean_pct") >= OFF_TREE, "situational").otherwise("common")
    return rows.withColumn("tier", F.when(F.col("selected"), split_choice(F.lit("bis"))).otherwise(off)).select(*_GROUP, "talent_id", "node_id", "component", "usage_pct", "tier")
