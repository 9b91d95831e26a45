"""Strength of specialisations by hierarchical shrinkage of ratings and win rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from .cohort import bracket_scope

#: Weights of rating, win rate and presence by role.
ARENA = {"dps": (0.40, 0.15, 0.45), "healer": (0.25, 0.15, 0.60), "tank": (0.25, 0.15, 0.60)}
SOLO = {"dps": (0.65, 0.35, 0.0), "healer": (0.55, 0.45, 0.0), "tank": (0.55, 0.45, 0.0)}
SOLO_LADDERS = ("shuffle", "blitz")
Z90 = 1.645
LEAST_PLAYERS = 3


def top_half(entries: DataFrame, group: list[str], least: int = LEAST_PLAYERS) -> DataFrame:
    """The better half of each group by rating (then entry_id), one row at least; groups of which fewer than `least` are
    left are dropped."""
    by = W.partitionBy(*group)
    e = entries.withColumns({"_n": F.count("*").over(by), "_k": F.row_number().over(by.orderBy(F.col("rating").desc_nulls_last(), "entry_id"))})
    half = F.greatest(F.lit(1), F.ceil(F.col("_n") / 2))
    return e.where((F.col("_k") <= half) & (half >= least)).withColumnRenamed("_n", "total_in_bracket").drop("_k")


def minmax(x: Column, by) -> Column:
    """x over its range; 0.5 where the range is 0."""
    low, high = F.min(x).over(by), F.max(x).over(by)
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.5))


def strength_rows(sample: DataFrame, ladder: list[str], spec: list[str], solo: Column | None = None) -> DataFrame:
    """One scored row for each spec of each ladder; many ladders are ranked in one job.

    sample: ladder, spec, role, rating, wins, losses, total_in_bracket. Hyper-parameters are sums over the specs of a
    ladder. With no games at all, or no spread, win rates shrink to an even chance by a prior of (50, 50), and ratings
    to the common mean.
    """
    g = sample.groupBy(*ladder, *spec, "role").agg(
        F.count("*").alias("n"), F.max("total_in_bracket").alias("total_in_bracket"), F.avg("rating").alias("mean_rating"),
        F.coalesce(F.var_samp("rating"), F.lit(0.0)).alias("var_rating"), F.sum("wins").alias("total_wins"), F.sum("losses").alias("total_losses"),
    )
    by = W.partitionBy(*ladder)
    games = F.col("total_wins") + F.col("total_losses")
    rate = F.try_divide(F.col("total_wins").cast("double"), games)
    g = g.withColumns({"total_games": games, "rate": rate})
    spread = lambda c: F.coalesce(F.var_samp(c).over(by), F.lit(0.0))
    g = g.withColumns({"mu0": F.avg("mean_rating").over(by), "between": spread("mean_rating"), "within": F.avg(F.when(F.col("var_rating") > 0, F.col("var_rating"))).over(by), "rate_mean": F.avg("rate").over(by), "rate_var": spread("rate")})
    g = g.withColumn("sigma2", F.coalesce("within", "between"))
    g = g.withColumn("tau0", F.greatest(F.lit(0.0), F.col("between") - F.avg(F.col("sigma2") / F.col("n")).over(by)))
    g = g.withColumn("tau2", F.when(F.col("tau0") == 0, F.col("sigma2") / 10).otherwise(F.col("tau0")))
    room = F.col("rate_mean") * (1 - F.col("rate_mean"))
    common = F.when((F.col("rate_var") > 0) & (F.col("rate_var") < room), room / F.col("rate_var") - 1)
    g = g.withColumns({"alpha0": F.coalesce(F.col("rate_mean") * common, F.lit(50.0)), "beta0": F.coalesce((1 - F.col("rate_mean")) * common, F.lit(50.0))})
    b = F.coalesce(F.try_divide(F.col("tau2"), F.col("tau2") + F.col("sigma2") / F.col("n")), F.lit(0.0))
    g = g.withColumn("b", b)
    g = g.withColumns({
        "theta": F.col("b") * F.col("mean_rating") + (1 - F.col("b")) * F.col("mu0"),
        "sd": F.sqrt(F.coalesce(F.try_divide(F.lit(1.0), F.try_divide(F.col("n").cast("double"), F.col("sigma2")) + F.try_divide(F.lit(1.0), F.col("tau2"))), F.lit(0.0))),
        "wr": (F.col("alpha0") + F.col("total_wins")) / (F.col("alpha0") + F.col("beta0") + F.col("total_wins") + F.col("total_losses")),
    })
    g = g.withColumns({"theta_hat": X.half_up(F.col("theta"), 1), "wr_hat": X.half_up(F.col("wr"), 4), "b_k": X.half_up(F.col("b"), 4)})
    solo = F.lit(False) if solo is None else solo
    weight = lambda k: F.when(solo, _by_role(SOLO, k)).otherwise(_by_role(ARENA, k))
    performance = minmax(F.col("theta_hat"), by) * weight(0) + minmax(F.col("wr_hat"), by) * weight(1)
    score = performance * F.col("b_k") + minmax(F.log1p(F.col("n").cast("double")), by) * weight(2)
    out = g.withColumns({
        "score": X.half_up(score, 4), "mean_rating": X.half_up(F.col("mean_rating"), 1), "rating_ci_low": X.half_up(F.col("theta") - Z90 * F.col("sd"), 1), "rating_ci_high": X.half_up(F.col("theta") + Z90 * F.col("sd"), 1),
        "raw_winrate": X.half_up(F.coalesce("rate", F.lit(0.5)), 4),
    })
    return out.select(*ladder, *spec, "role", F.col("n").alias("count"), "total_in_bracket", "mean_rating", "theta_hat", "b_k", "rating_ci_low", "rating_ci_high", "raw_winrate", "wr_hat", "total_games", "total_wins", "score")


def _by_role(table: dict[str, tuple[float, float, float]], k: int) -> Column:
    role = F.col("role")
    return F.when(role == "healer", table["healer"][k]).when(role == "tank", table["tank"][k]).otherwise(table["dps"][k])


def spec_strength(entries: DataFrame, catalog: DataFrame, bracket: str, region: str | None = None, role: str | None = None) -> DataFrame:
    """Scores of the specs of one ladder: entries of the bracket (and region), specs of the catalog (and role)."""
    e = bracket_scope(entries.drop("role"), bracket)
    e = e.where(F.col("region") == region) if region else e
    c = F.broadcast(catalog.where(F.col("role") == role) if role else catalog)  # forty rows
    sample = top_half(e.join(c, "spec_id"), ["spec_id"]).withColumn("ladder", F.lit(bracket))
    return strength_rows(sample, ["ladder"], ["spec_id", "class_slug", "spec_slug"], F.lit(bracket in SOLO_LADDERS)).drop("ladder")


def beta_shrinkage(outcomes: DataFrame, group: str, win: str) -> DataFrame:
    """group, n, wins, rate, shrunk: rates of a yes/no outcome drawn to their common mean by a Beta prior from their own spread."""
    g = outcomes.groupBy(group).agg(F.count("*").alias("n"), F.sum(win).alias("wins")).withColumn("rate", F.col("wins") / F.col("n"))
    by = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # a row a group
    g = g.withColumns({"m": F.avg("rate").over(by), "v": F.coalesce(F.var_samp("rate").over(by), F.lit(0.0))})
    room = F.col("m") * (1 - F.col("m"))
    common = F.when((F.col("v") > 0) & (F.col("v") < room), room / F.col("v") - 1)
    a, b = F.coalesce(F.col("m") * common, F.lit(50.0)), F.coalesce((1 - F.col("m")) * common, F.lit(50.0))
    return g.select(group, "n", "wins", X.half_up(F.col("rate"), 6).alias("rate"), X.half_up((a + F.col("wins")) / (a + b + F.col("n")), 6).alias("shrunk"))


def rank_change(ranked: DataFrame, snapshot: DataFrame, group: list[str], key: str = "spec_id") -> DataFrame:
    """ranked with place and change: the place in the snapshot less the place now, null if it wasn't there. Both by score, then key."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("score"), key))
    before = snapshot.select(*group, key, place.alias("_before"))
    return ranked.withColumn("place", place).join(before, [*group, key], "left").withColumn("change", F.col("_before") - F.col("place")).drop("_before")
