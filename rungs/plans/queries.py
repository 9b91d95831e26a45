"""The ladder queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import builds, cohort, dims, health, ladder, popularity, read_models, spec_stats, strength, talents, tiers
from ..sources import ingest, tables
from ..sources.scratch import written
from ..streaming import incremental, streams
from .registry import QUERIES, SQL, pct, query
from .testdata import Ladder

TOP_N = 10
LOCALES = ["en_US", "fr_FR"]


# ---- popularity ----------------------------------------------------------------------------------------------------

_SHARE = "SELECT *, CAST(sum(usage_count) OVER (PARTITION BY bracket, spec_id, slot) AS BIGINT) AS total FROM (SELECT bracket, c.spec_id, slot, {0}, count(*) AS usage_count FROM cohort c JOIN items i ON i.character_id = c.character_id AND i.spec_id = c.spec_id WHERE {0} IS NOT NULL GROUP BY ALL)"


def _cohort(t: Ladder) -> DataFrame:
    return cohort.top_cohort(t.entries, "equipment_at", TOP_N)


@query(f"SELECT *, {pct('usage_count', 'total')} AS usage_pct FROM ({_SHARE.format('item_id')})", "cohort", "items")
def item_popularity(t: Ladder) -> DataFrame:
    return popularity.popularity(_cohort(t), t.items, popularity.ITEMS)


_WIDE = "WITH wide AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY bracket, spec_id ORDER BY rating DESC NULLS FIRST) AS spec_rank FROM best_eq) WHERE spec_rank <= 1000)"


@query(f"{_WIDE} SELECT *, {pct('usage_count', 'total')} AS usage_pct FROM ({_SHARE.format('item_id').replace('cohort c', 'wide c')})", "best_eq", "items")
def item_popularity_of_1000(t: Ladder) -> DataFrame:
    """With as many players of a bracket and spec as a full refresh takes."""
    return popularity.popularity(cohort.top_cohort(t.entries, "equipment_at"), t.items, popularity.ITEMS)


@query(f"SELECT *, {pct('usage_count', 'total')} AS usage_pct FROM ({_SHARE.format('enchantment_id')})", "cohort", "items")
def enchant_popularity(t: Ladder) -> DataFrame:
    return popularity.popularity(_cohort(t), t.items, popularity.ENCHANTS)


@query(f"""WITH worn AS (SELECT bracket, c.spec_id, slot, socket_type, gem_id, c.character_id FROM cohort c JOIN sockets s ON s.character_id = c.character_id AND s.spec_id = c.spec_id)
    SELECT bracket, spec_id, slot, socket_type, gem_id, usage_count, total, {pct('usage_count', 'total')} AS usage_pct
    FROM (SELECT bracket, spec_id, slot, socket_type, gem_id, count(DISTINCT character_id) AS usage_count FROM worn WHERE gem_id IS NOT NULL GROUP BY ALL) JOIN (SELECT bracket, spec_id, slot, count(DISTINCT character_id) AS total FROM worn GROUP BY ALL) USING (bracket, spec_id, slot)""", "cohort", "sockets")  # fmt: skip
def gem_popularity(t: Ladder) -> DataFrame:
    return popularity.popularity(_cohort(t), t.sockets, popularity.GEMS)


_SPLIT = "TIMESTAMP '1995-01-01'"
_TRENDS = f"""WITH old_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bracket, character_id ORDER BY rating DESC NULLS FIRST, entry_id) AS k FROM entries WHERE equipment_at < (SELECT quantile_disc(snapshot_at, 0.5) FROM entries)) WHERE k = 1),
    old_cohort AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY bracket, spec_id ORDER BY rating DESC NULLS FIRST) AS spec_rank FROM old_best) WHERE spec_rank <= 10),
    now_pop AS (SELECT *, {pct('usage_count', 'total')} AS usage_pct FROM ({_SHARE.format('enchantment_id')})), old_pop AS (SELECT *, {pct('usage_count', 'total')} AS usage_pct FROM ({_SHARE.format('enchantment_id').replace('cohort c', 'old_cohort c')})),
    trended AS (SELECT n.*, o.usage_pct AS prev_usage_pct, CASE WHEN o.usage_pct IS NULL THEN 'new' WHEN n.usage_pct - o.usage_pct > 1 THEN 'up' WHEN n.usage_pct - o.usage_pct < -1 THEN 'down' ELSE 'stable' END AS trend
    FROM now_pop n LEFT JOIN old_pop o USING (bracket, spec_id, slot, enchantment_id))"""


def _trended(t: Ladder) -> DataFrame:
    half = t.table("orders").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(CAST(o_orderdate AS TIMESTAMP)))").alias("h"))
    was = F.expr("unix_micros(CAST(equipment_at AS TIMESTAMP)) < h")
    both = t.orders.crossJoin(F.broadcast(half)).withColumn("old", F.explode(F.when(was, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))  # one row
    return popularity.popularity_trend(cohort.top_cohort(both, "equipment_at", TOP_N, versions=("old",)), t.items, popularity.ENCHANTS)


@query(f"{_TRENDS} SELECT * FROM trended", "cohort", "items")
def popularity_trend(t: Ladder) -> DataFrame:
    return _trended(t)


@query(f"""{_TRENDS}, named AS (SELECT t.*, 'name ' || right(CAST(enchantment_id AS VARCHAR), 1) AS name FROM trended t),
    m AS (SELECT bracket, spec_id, slot, name, arg_max(enchantment_id, {{p: usage_pct, k: -enchantment_id}}) AS enchantment_id, CAST(sum(usage_count) AS BIGINT) AS usage_count, floor(sum(usage_pct) * 100 + 0.5) / 100 AS usage_pct, floor(sum(prev_usage_pct) * 100 + 0.5) / 100 AS prev_usage_pct FROM named GROUP BY ALL)
    SELECT *, CASE WHEN prev_usage_pct IS NULL THEN 'new' WHEN usage_pct - prev_usage_pct > 1 THEN 'up' WHEN usage_pct - prev_usage_pct < -1 THEN 'down' ELSE 'stable' END AS trend FROM m""", "cohort", "items")  # fmt: skip
def enchant_variants(t: Ladder) -> DataFrame:
    rows = _trended(t).withColumn("_id", F.col("enchantment_id").cast("string"))
    rows = read_models.localized(rows.withColumnRenamed("_id", "key_id"), t.translations, "enchantment", "key_id", "en_US")
    return popularity.merge_variants(rows, ["bracket", "spec_id", "slot", "name"], ["enchantment_id"])


@query("SELECT item_id, crafting_stats, n FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, crafting_stats) AS k FROM (SELECT item_id, crafting_stats, count(*) AS n FROM items WHERE len(crafting_stats) > 0 GROUP BY 1, 2)) WHERE k = 1", "items")
def top_crafting(t: Ladder) -> DataFrame:
    return popularity.top_crafting(t.items)


@query(f"""WITH pop AS (SELECT *, {pct('usage_count', 'total')} AS usage_pct FROM ({_SHARE.format('item_id')})), craft AS (SELECT item_id, crafting_stats FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, crafting_stats) AS k FROM (SELECT item_id, crafting_stats, count(*) AS n FROM items WHERE len(crafting_stats) > 0 GROUP BY 1, 2)) WHERE k = 1)
    SELECT bracket, spec_id, slot, p.item_id, coalesce(f.value, e.value) AS name, crafting_stats IS NOT NULL AS crafted, coalesce(array_to_string(crafting_stats, ','), '') AS top_crafting_stats, usage_count AS count, usage_pct AS pct
    FROM pop p LEFT JOIN craft c ON c.item_id = p.item_id LEFT JOIN translations f ON f.type = 'item' AND f.id = p.item_id AND f.locale = 'fr_FR' LEFT JOIN translations e ON e.type = 'item' AND e.id = p.item_id AND e.locale = 'en_US'""", "cohort", "items", "translations")  # fmt: skip
def item_read_model(t: Ladder) -> DataFrame:
    rows = item_popularity(t).withColumn("prev_usage_pct", F.lit(None).cast("double"))
    out = read_models.item_rows(rows, t.translations, popularity.top_crafting(t.items), "fr_FR")
    return out.select("bracket", "spec_id", "slot", "item_id", "name", "crafted", F.array_join("top_crafting_stats", ",").alias("top_crafting_stats"), "usage.count", "usage.pct")


# ---- ladders -------------------------------------------------------------------------------------------------------

_WINRATE = "floor(coalesce(wins * 100.0 / nullif(wins + losses, 0), 0) * 10 + 0.5) / 10"
_PLACE = ["entry_id", "character_id", "bracket", "region", "spec_id", "rating", "wins", "losses", "rank"]


@query(f"""WITH f AS (SELECT * FROM ranked WHERE bracket = '1-URGENT' AND region IN ('ASIA', 'EUROPE') AND rating BETWEEN 20000 AND 400000 AND CAST(wins AS DOUBLE) / nullif(wins + losses, 0) >= 0.5 AND name ILIKE 'Customer#0000%')
    SELECT {', '.join(_PLACE)}, {_WINRATE} AS winrate, (SELECT count(*) FROM f) AS total_rows, CAST(ceil((SELECT count(*) FROM f) / 25.0) AS BIGINT) AS total_pages FROM f ORDER BY rank, entry_id LIMIT 25 OFFSET 25""", "ranked")  # fmt: skip
def ladder_page(t: Ladder) -> DataFrame:
    page = ladder.ladder_page(t.ranked, "1-URGENT", 2, 25, region=["ASIA", "EUROPE"], rating_min=20000, rating_max=400000, min_winrate=0.5, name="customer#0000")
    return page.select(*_PLACE, "winrate", "total_rows", "total_pages")


_SCORE = "rating + least(120.0, greatest(0.0, (wr - 60) * 6)) - least(300.0, greatest(0.0, (60 - wr) * 8 * least(1.5, greatest(0.0, (wins + losses - 200) / 200.0))))"


@query(f"""WITH e AS (SELECT *, wins * 100.0 / nullif(wins + losses, 0) AS wr FROM ranked WHERE bracket = '2-HIGH' AND equipment_at >= (SELECT max(snapshot_at) FROM entries) - INTERVAL 60 DAY),
    g AS (SELECT *, count(*) FILTER (WHERE wins + losses >= 3) OVER () AS n FROM e)
    SELECT entry_id, character_id, spec_id, rating, wins, losses, floor(({_SCORE}) * 100 + 0.5) / 100 AS score FROM g WHERE n < 10 OR wins + losses >= 3 ORDER BY score DESC, entry_id LIMIT 10""", "ranked")  # fmt: skip
def top_players(t: Ladder) -> DataFrame:
    as_of = F.lit(t.table("orders").agg(F.max("o_orderdate")).first()[0])
    return ladder.top_players(t.ranked, "2-HIGH", as_of, min_games=3).select("entry_id", "character_id", "spec_id", "rating", "wins", "losses", "score")


@query("SELECT entry_id, character_id, spec_id, rating, rank FROM ranked WHERE bracket = '3-MEDIUM' AND region = 'AMERICA' ORDER BY rank, entry_id LIMIT 100", "ranked")
def top_of_ladder(t: Ladder) -> DataFrame:
    return ladder.top_of_ladder(t.ranked, "AMERICA", "3-MEDIUM", 100).select("entry_id", "character_id", "spec_id", "rating", "rank")


@query("""SELECT character_id, nullif(array_to_string(list_transform(string_split(replace(realm, '-', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' '), '') AS realm, name || '-' || array_to_string(list_transform(string_split(replace(realm, '-', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS display_name, count(*) AS n
    FROM entries WHERE name LIKE '%77%' GROUP BY ALL""", "entries")  # fmt: skip
def name_search(t: Ladder) -> DataFrame:
    rows = ladder.name_contains(t.entries, "77")
    return rows.select("character_id", X.realm_title(F.col("realm")).alias("realm"), X.display_name(F.col("name"), F.col("realm")).alias("display_name")).groupBy("character_id", "realm", "display_name").agg(F.count("*").alias("n"))


# ---- specs ---------------------------------------------------------------------------------------------------------


@query(f"SELECT bracket, spec_id, n AS count, {pct('n', 'CAST(sum(n) OVER (PARTITION BY bracket) AS BIGINT)')} AS pct FROM (SELECT bracket, spec_id, count(*) AS n FROM entries GROUP BY 1, 2)", "entries")
def spec_distribution(t: Ladder) -> DataFrame:
    return spec_stats.spec_distribution(t.entries)


@query(f"""WITH c AS (SELECT *, {pct('n', 'CAST(sum(n) OVER (PARTITION BY bracket, spec_id) AS BIGINT)')} AS pct FROM (SELECT bracket, spec_id, loadout_code, count(*) AS n FROM entries WHERE loadout_code IS NOT NULL GROUP BY ALL))
    SELECT bracket, spec_id, loadout_code, n AS count, pct, place FROM (SELECT *, row_number() OVER (PARTITION BY bracket, spec_id ORDER BY n DESC, loadout_code) AS place FROM c) WHERE place <= 3""", "entries")  # fmt: skip
def loadout_distribution(t: Ladder) -> DataFrame:
    return spec_stats.loadout_distribution(t.entries, limit=3)


def _group_share(col: str) -> str:
    return f"SELECT * FROM (SELECT bracket, spec_id, {col}, n AS count, {pct('n', 'CAST(sum(n) OVER (PARTITION BY bracket, spec_id) AS BIGINT)')} AS pct FROM (SELECT bracket, spec_id, {col}, count(*) AS n FROM entries GROUP BY ALL)) WHERE {col} IS NOT NULL"


@query(_group_share("hero_tree_id"), "entries")
def hero_distribution(t: Ladder) -> DataFrame:
    return spec_stats.hero_distribution(t.entries)


@query(_group_share("tier_set_pieces"), "entries")
def tier_distribution(t: Ladder) -> DataFrame:
    sets = t.entries.withColumns({"tier_set_id": F.col("tier_set_pieces"), "tier_set_name": F.lit("set"), "tier_4p_active": F.col("tier_set_pieces") >= 4})
    return spec_stats.tier_distribution(sets).select("bracket", "spec_id", "tier_set_pieces", "count", "pct")


_LONG = "SELECT character_id, spec_id, 'haste' AS stat, haste AS value FROM items UNION ALL SELECT character_id, spec_id, 'crit', crit FROM items UNION ALL SELECT character_id, spec_id, 'mastery', mastery FROM items"


def _totals(t: Ladder) -> DataFrame:
    gems = t.sockets.where("gem_id is not null").distinct().select("character_id", "spec_id", F.concat(F.lit("+"), F.col("gem_id").cast("string"), F.lit(" Haste and +1 crit")).alias("text"))
    enchants = t.items.where("enchantment_id is not null").select("character_id", "spec_id", F.concat(F.lit("Enchanted: +"), (F.col("enchantment_id") % 4).cast("string"), F.lit(" Versatility")).alias("text"))
    return spec_stats.stat_totals(t.items, gems, enchants)


_TOTALS = f"""SELECT character_id, spec_id, stat, CAST(sum(value) AS BIGINT) AS value FROM ({_LONG} UNION ALL SELECT character_id, spec_id, 'haste', gem_id FROM (SELECT DISTINCT * FROM sockets WHERE gem_id IS NOT NULL) UNION ALL SELECT character_id, spec_id, 'crit', 1 FROM (SELECT DISTINCT * FROM sockets WHERE gem_id IS NOT NULL)
    UNION ALL SELECT character_id, spec_id, 'versatility', enchantment_id % 4 FROM items WHERE enchantment_id IS NOT NULL) GROUP BY 1, 2, 3 HAVING sum(value) <> 0"""


@query(_TOTALS, "items", "sockets")
def stat_totals(t: Ladder) -> DataFrame:
    return _totals(t)


@query(f"""WITH totals AS ({_TOTALS}) SELECT bracket, e.spec_id, stat, floor(quantile_cont(value, 0.5) * 10 + 0.5) / 10 AS median FROM entries e JOIN totals t ON t.character_id = e.character_id GROUP BY ALL""", "entries", "items", "sockets")
def stat_priority(t: Ladder) -> DataFrame:
    return spec_stats.stat_priority(t.entries, _totals(t))


@query("""SELECT bracket, spec_id, count(*) AS players, CAST(floor(avg(level) + 0.5) AS INTEGER) AS avg_item_level, CAST(floor(avg(haste) + 0.5) AS INTEGER) AS haste, CAST(floor(avg(crit) + 0.5) AS INTEGER) AS crit, CAST(floor(avg(mastery) + 0.5) AS INTEGER) AS mastery, 0 AS versatility
    FROM (SELECT bracket, c.spec_id, c.character_id, avg(item_level) AS level, sum(haste) AS haste, sum(crit) AS crit, sum(mastery) AS mastery FROM cohort c JOIN items i ON i.character_id = c.character_id AND i.spec_id = c.spec_id GROUP BY ALL) GROUP BY ALL""", "cohort", "items")  # fmt: skip
def cohort_stats(t: Ladder) -> DataFrame:
    return spec_stats.cohort_stats(_cohort(t), t.items)


@query("SELECT bracket, spec_id, count(DISTINCT character_id) AS total_players FROM entries WHERE talents_at IS NOT NULL GROUP BY 1, 2", "entries")
def distinct_players(t: Ladder) -> DataFrame:
    return spec_stats.distinct_players(t.entries)


@query("SELECT DISTINCT c.spec_id, bracket FROM cohort c JOIN items i ON i.character_id = c.character_id AND i.spec_id = c.spec_id", "cohort", "items")
def coverage_pairs(t: Ladder) -> DataFrame:
    return spec_stats.coverage_pairs(_cohort(t), t.items)


# ---- talents -------------------------------------------------------------------------------------------------------


def _weighted(t: Ladder) -> DataFrame:
    return cohort.top_cohort(t.entries, "talents_at", TOP_N, weighted=True)


def _usage(t: Ladder) -> DataFrame:
    """Usage, commonest build and ranks in one pass, which reads the large tables once."""
    return builds.full_usage(cohort.top_cohort(t.best_with_talents, "talents_at", TOP_N, weighted=True), t.talent_dim, t.assignments)


def _stored_usage(t: Ladder) -> DataFrame:
    """_usage(), written out for what reads it more than once: a row for each talent of a bracket and spec."""
    return written(_usage(t), "usage")


_U = "bracket, spec_id, talent_id, talent_type, default_points, usage_count, usage_pct, in_top_build, top_build_rank, tier"


@query(f"SELECT {_U} FROM full_usage", "full_usage")
def weighted_usage(t: Ladder) -> DataFrame:
    return _usage(t).select(*_U.split(", "))


@query("SELECT bracket, spec_id, array_to_string(build, ',') AS build, build_weight FROM builds", "builds")
def modal_build(t: Ladder) -> DataFrame:
    return builds.modal_build(_weighted(t), t.talents).withColumn("build", F.array_join(F.col("build").cast("array<string>"), ","))


@query("SELECT * FROM ranks", "ranks")
def modal_rank(t: Ladder) -> DataFrame:
    return builds.modal_rank(_weighted(t), t.talents)


@query(f"""SELECT {_U} FROM (SELECT u.* REPLACE (max(default_points) OVER w AS default_points, bool_or(in_top_build) OVER w AS in_top_build, max(top_build_rank) OVER w AS top_build_rank), row_number() OVER (PARTITION BY bracket, spec_id, node_id, name ORDER BY usage_pct DESC, u.talent_id) AS k
    FROM full_usage u JOIN talent_dim d ON d.talent_id = u.talent_id WINDOW w AS (PARTITION BY bracket, spec_id, node_id, name)) WHERE k = 1""", "full_usage", "talent_dim")  # fmt: skip
def rank_variants(t: Ladder) -> DataFrame:
    return talents.merge_rank_variants(_stored_usage(t), t.talent_dim).select(*_U.split(", "))


_STALE = """WITH n AS (SELECT u.*, d.name, a.talent_id IS NOT NULL AS given, count(a.talent_id) OVER w AS n, count(*) OVER w AS every, row_number() OVER (PARTITION BY bracket, u.spec_id, d.name ORDER BY usage_pct DESC, u.talent_id) AS k FROM full_usage u JOIN talent_dim d ON d.talent_id = u.talent_id LEFT JOIN assignments a ON a.talent_id = u.talent_id AND a.spec_id = u.spec_id WINDOW w AS (PARTITION BY bracket, u.spec_id, d.name)),
    canon AS (SELECT spec_id, name, min(talent_id) AS target FROM assignments JOIN talent_dim USING (talent_id) GROUP BY 1, 2 HAVING count(*) = 1), stale AS (SELECT n.* REPLACE (CASE WHEN n.n = 0 AND target IS NOT NULL THEN target ELSE talent_id END AS talent_id) FROM n LEFT JOIN canon c ON c.spec_id = n.spec_id AND c.name = n.name
    WHERE CASE WHEN n.n = 1 THEN given OR every = 1 WHEN n.n = 0 AND target IS NOT NULL THEN k = 1 ELSE true END)"""


@query(f"{_STALE} SELECT {_U} FROM stale", "full_usage", "talent_dim", "assignments")
def stale_variants(t: Ladder) -> DataFrame:
    return talents.merge_stale_variants(_stored_usage(t), t.talent_dim, t.assignments).select(*_U.split(", "))


@query(f"SELECT {_U} FROM full_usage u WHERE EXISTS (SELECT 1 FROM assignments a WHERE a.talent_id = u.talent_id AND a.spec_id = u.spec_id) OR EXISTS (SELECT 1 FROM talent_dim d WHERE d.talent_id = u.talent_id AND d.icon IS NOT NULL)", "full_usage", "talent_dim", "assignments")
def drop_stale(t: Ladder) -> DataFrame:
    return talents.drop_unresolvable(_usage(t), t.talent_dim, t.assignments).select(*_U.split(", "))


_NODE = """nodes AS (SELECT u.*, node_id, name, max_rank, max(usage_pct) OVER w AS primary_pct, u.talent_id = first_value(u.talent_id) OVER (PARTITION BY bracket, spec_id, u.talent_type, node_id ORDER BY usage_pct DESC, u.talent_id) AS is_primary,
    first_value(max_rank) OVER (PARTITION BY bracket, spec_id, u.talent_type, node_id ORDER BY usage_pct DESC, u.talent_id) AS cost, bool_or(in_top_build) OVER w AS built, count(DISTINCT name) OVER w > 1 AS choice FROM full_usage u JOIN talent_dim d ON d.talent_id = u.talent_id WINDOW w AS (PARTITION BY bracket, spec_id, u.talent_type, node_id)),
    gaps AS (SELECT *, primary_pct - max(CASE WHEN NOT is_primary THEN usage_pct END) OVER (PARTITION BY bracket, spec_id, talent_type, node_id) AS gap FROM nodes)"""
_CHOICE = "CASE WHEN choice AND {t} <> 'common' THEN CASE WHEN {t} = 'bis' AND coalesce(gap <= 30, false) THEN 'situational' WHEN is_primary THEN {t} WHEN coalesce(gap <= 30, false) OR ({t} = 'bis' AND usage_pct >= 35) THEN 'situational' ELSE 'common' END ELSE {t} END"
#: With this budget the greedy buyer has to pass over nodes.
BUDGETS = {"class": 4, "spec": 5}


@query(f"""WITH {_NODE}, queue AS (SELECT *, row_number() OVER (PARTITION BY bracket, spec_id, talent_type ORDER BY p DESC, node_id) AS i FROM (SELECT DISTINCT bracket, spec_id, talent_type, node_id, primary_pct AS p, cost FROM gaps WHERE built AND talent_type IN ('class', 'spec'))),
    buy AS (SELECT bracket, spec_id, talent_type, i, node_id, p, cost <= b AS got, CASE WHEN cost <= b THEN b - cost ELSE b END AS rest FROM (SELECT *, CASE WHEN talent_type = 'class' THEN 4 ELSE 5 END AS b FROM queue) WHERE i = 1
    UNION ALL SELECT q.bracket, q.spec_id, q.talent_type, q.i, q.node_id, q.p, q.cost <= b.rest, CASE WHEN q.cost <= b.rest THEN b.rest - q.cost ELSE b.rest END FROM buy b JOIN queue q ON q.bracket = b.bracket AND q.spec_id = b.spec_id AND q.talent_type = b.talent_type AND q.i = b.i + 1),
    least AS (SELECT bracket, spec_id, talent_type, min(p) * 0.5 AS start FROM buy WHERE got GROUP BY ALL),
    tiered AS (SELECT g.*, CASE WHEN b.got THEN 'bis' WHEN primary_pct >= coalesce(l.start, 50) THEN 'situational' ELSE 'common' END AS node_tier FROM gaps g LEFT JOIN buy b ON b.bracket = g.bracket AND b.spec_id = g.spec_id AND b.talent_type = g.talent_type AND b.node_id = g.node_id LEFT JOIN least l ON l.bracket = g.bracket AND l.spec_id = g.spec_id AND l.talent_type = g.talent_type WHERE g.talent_type IN ('class', 'spec'))
    SELECT bracket, spec_id, talent_type, talent_id, node_id, usage_pct, node_tier, {_CHOICE.format(t='node_tier')} AS tier FROM tiered""", "full_usage", "talent_dim")  # fmt: skip
def budget_tiers(t: Ladder) -> DataFrame:
    return tiers.budget_tiers(_stored_usage(t), t.talent_dim, BUDGETS)


#: Every way to cut a group's sorted shares into three runs, by the sum of squared deviations within the runs.
_BREAKS = """WITH p AS (SELECT bracket, spec_id, talent_id, usage_pct, row_number() OVER (PARTITION BY bracket, spec_id ORDER BY usage_pct) AS i, count(*) OVER (PARTITION BY bracket, spec_id) AS n FROM full_usage WHERE talent_type = 'pvp'),
    runs AS (SELECT a.bracket, a.spec_id, a.i AS lo, b.i AS hi, a.n, a.usage_pct AS first, sum(c.usage_pct * c.usage_pct) - sum(c.usage_pct) * sum(c.usage_pct) / count(*) AS spread FROM p a JOIN p b ON b.bracket = a.bracket AND b.spec_id = a.spec_id AND b.i >= a.i JOIN p c ON c.bracket = a.bracket AND c.spec_id = a.spec_id AND c.i BETWEEN a.i AND b.i WHERE a.n > 3 GROUP BY ALL),
    cuts AS (SELECT x.bracket, x.spec_id, y.first AS sit, z.first AS bis, row_number() OVER (PARTITION BY x.bracket, x.spec_id ORDER BY round(x.spread + y.spread + z.spread, 8), z.lo, y.lo) AS k FROM runs x JOIN runs y ON y.bracket = x.bracket AND y.spec_id = x.spec_id AND y.lo = x.hi + 1 JOIN runs z ON z.bracket = y.bracket AND z.spec_id = y.spec_id AND z.lo = y.hi + 1 WHERE x.lo = 1 AND z.hi = z.n)
    SELECT p.bracket, p.spec_id, talent_id, usage_pct, CASE WHEN usage_pct >= coalesce(bis, 75) THEN 'bis' WHEN usage_pct >= coalesce(sit, 50) THEN 'situational' ELSE 'common' END AS tier FROM p LEFT JOIN cuts c ON c.bracket = p.bracket AND c.spec_id = p.spec_id AND k = 1"""


@query(_BREAKS, "full_usage")
def jenks_tiers(t: Ladder) -> DataFrame:
    return tiers.jenks_tiers(_usage(t))


@query(f"""WITH {_NODE}, present AS (SELECT DISTINCT bracket, spec_id, node_id FROM gaps WHERE talent_type = 'hero'), links AS (SELECT p.bracket, p.spec_id, e.node_id AS a, e.prerequisite_id AS b FROM present p JOIN edges e ON e.node_id = p.node_id JOIN present q ON q.bracket = p.bracket AND q.spec_id = p.spec_id AND q.node_id = e.prerequisite_id),
    ways AS (SELECT * FROM links UNION ALL SELECT bracket, spec_id, b, a FROM links), reach AS (SELECT bracket, spec_id, node_id, node_id AS other FROM present UNION SELECT r.bracket, r.spec_id, r.node_id, l.b FROM reach r JOIN ways l ON l.bracket = r.bracket AND l.spec_id = r.spec_id AND l.a = r.other),
    comp AS (SELECT bracket, spec_id, node_id, min(other) AS component FROM reach GROUP BY 1, 2, 3), rows AS (SELECT g.*, component FROM gaps g JOIN comp c ON c.bracket = g.bracket AND c.spec_id = g.spec_id AND c.node_id = g.node_id WHERE talent_type = 'hero'),
    means AS (SELECT *, row_number() OVER (PARTITION BY bracket, spec_id ORDER BY m DESC, component) AS k FROM (SELECT bracket, spec_id, component, avg(usage_pct) AS m FROM rows GROUP BY 1, 2, 3))
    SELECT r.bracket, r.spec_id, talent_type, talent_id, node_id, r.component, usage_pct, CASE WHEN k = 1 THEN {_CHOICE.format(t="'bis'")} WHEN m >= 30 THEN 'situational' ELSE 'common' END AS tier FROM rows r JOIN means m ON m.bracket = r.bracket AND m.spec_id = r.spec_id AND m.component = r.component""", "full_usage", "talent_dim", "edges")  # fmt: skip
def hero_components(t: Ladder) -> DataFrame:
    return tiers.hero_tiers(_stored_usage(t), t.talent_dim, t.edges)


@query("""WITH want AS (SELECT talent_id, spec_id, default_points, node_id, name, talent_type FROM (SELECT *, row_number() OVER (PARTITION BY spec_id, node_id, name ORDER BY icon IS NULL, talent_id) AS k FROM assignments JOIN talent_dim USING (talent_id)) WHERE k = 1
    UNION ALL SELECT DISTINCT d.talent_id, t.spec_id, 0, node_id, name, talent_type FROM talents t JOIN talent_dim d ON d.talent_id = t.talent_id WHERE talent_type = 'pvp' AND NOT EXISTS (SELECT 1 FROM assignments a WHERE a.talent_id = t.talent_id AND a.spec_id = t.spec_id)),
    groups AS (SELECT DISTINCT bracket, spec_id FROM full_usage), zero AS (SELECT g.bracket, g.spec_id, w.talent_id, w.talent_type, w.default_points, CAST(0 AS BIGINT) AS usage_count, CAST(0 AS DOUBLE) AS usage_pct, CASE WHEN w.default_points > 0 THEN 'bis' ELSE 'common' END AS tier FROM groups g JOIN want w ON w.spec_id = g.spec_id
    WHERE NOT EXISTS (SELECT 1 FROM full_usage u WHERE u.bracket = g.bracket AND u.spec_id = g.spec_id AND u.talent_id = w.talent_id) AND NOT EXISTS (SELECT 1 FROM full_usage u JOIN talent_dim d ON d.talent_id = u.talent_id WHERE u.bracket = g.bracket AND u.spec_id = g.spec_id AND d.node_id = w.node_id AND d.name = w.name))
    SELECT bracket, spec_id, talent_id, talent_type, default_points, usage_count, usage_pct, tier FROM full_usage UNION ALL SELECT * FROM zero""", "full_usage", "talent_dim", "assignments", "talents")  # fmt: skip
def zero_fill(t: Ladder) -> DataFrame:
    return talents.zero_fill(_stored_usage(t), t.assignments, t.talent_dim, t.talents)


@query("SELECT DISTINCT bracket, spec_id FROM usage u WHERE NOT EXISTS (SELECT 1 FROM usage v WHERE v.bracket = u.bracket AND v.spec_id = u.spec_id AND v.talent_type = 'hero' AND v.usage_pct > 15)", "usage")
def integrity_check(t: Ladder) -> DataFrame:
    u = builds.weighted_usage(_weighted(t), t.talents, t.talent_dim, t.assignments)
    return talents.integrity_check(u.withColumn("talent_type", F.when((F.col("talent_type") != "hero") | (F.col("usage_pct") > 15), F.col("talent_type"))))


@query("""SELECT bracket, spec_id, CAST(sum(usage_count) AS BIGINT) AS total_weighted, count(*) FILTER (WHERE talent_type IN ('class', 'spec') AND usage_pct < 1 AND NOT in_top_build AND tier = 'common') AS stale_count, max(p.n) AS total_players,
    CASE WHEN max(p.n) >= 100 AND count(*) FILTER (WHERE talent_type IN ('class', 'spec') AND usage_pct < 1 AND NOT in_top_build AND tier = 'common') = 0 THEN 'high' WHEN max(p.n) >= 30 AND count(*) FILTER (WHERE talent_type IN ('class', 'spec') AND usage_pct < 1 AND NOT in_top_build AND tier = 'common') <= 5 THEN 'medium' ELSE 'low' END AS confidence
    FROM full_usage u JOIN (SELECT bracket, spec_id, count(DISTINCT character_id) AS n FROM entries WHERE talents_at IS NOT NULL GROUP BY 1, 2) p USING (bracket, spec_id) GROUP BY ALL""", "full_usage", "entries")  # fmt: skip
def talent_response_meta(t: Ladder) -> DataFrame:
    return talents.response_meta(_usage(t), spec_stats.distinct_players(t.entries))


# ---- strength ------------------------------------------------------------------------------------------------------

_HALF = "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY bracket, spec_id) AS n, row_number() OVER (PARTITION BY bracket, spec_id ORDER BY rating DESC, entry_id) AS k FROM entries) WHERE k <= greatest(1, CAST(ceil(n / 2.0) AS BIGINT)) AND greatest(1, CAST(ceil(n / 2.0) AS BIGINT)) >= 3"
_ROLE = "CASE spec_id % 5 WHEN 0 THEN 'healer' WHEN 1 THEN 'tank' ELSE 'dps' END"
_STRENGTH = f"""WITH half AS ({_HALF}), g AS (SELECT bracket, spec_id, {_ROLE} AS role, count(*) AS n, max(n) AS total_in_bracket, avg(rating) AS mean_rating, coalesce(var_samp(rating), 0) AS var_rating, CAST(sum(wins) AS BIGINT) AS total_wins, CAST(sum(losses) AS BIGINT) AS total_losses FROM half GROUP BY ALL),
    r AS (SELECT *, total_wins + total_losses AS total_games, total_wins / nullif(CAST(total_wins + total_losses AS DOUBLE), 0) AS rate FROM g),
    h AS (SELECT *, avg(mean_rating) OVER w AS mu0, coalesce(var_samp(mean_rating) OVER w, 0) AS between_, avg(CASE WHEN var_rating > 0 THEN var_rating END) OVER w AS within_, avg(rate) OVER w AS rm, coalesce(var_samp(rate) OVER w, 0) AS rv FROM r WINDOW w AS (PARTITION BY bracket)),
    s AS (SELECT *, coalesce(within_, between_) AS sigma2 FROM h), t0 AS (SELECT *, greatest(0, between_ - avg(sigma2 / n) OVER (PARTITION BY bracket)) AS tau0, CASE WHEN rv > 0 AND rv < rm * (1 - rm) THEN rm * (1 - rm) / rv - 1 END AS common FROM s),
    t1 AS (SELECT *, CASE WHEN tau0 = 0 THEN sigma2 / 10 ELSE tau0 END AS tau2, coalesce(rm * common, 50) AS a0, coalesce((1 - rm) * common, 50) AS b0 FROM t0), p AS (SELECT *, tau2 / (tau2 + sigma2 / n) AS b FROM t1),
    q AS (SELECT *, b * mean_rating + (1 - b) * mu0 AS theta, sqrt(1 / (n / sigma2 + 1 / tau2)) AS sd, (a0 + total_wins) / (a0 + b0 + total_games) AS wr FROM p), z AS (SELECT *, floor(theta * 10 + 0.5) / 10 AS theta_hat, floor(wr * 10000 + 0.5) / 10000 AS wr_hat, floor(b * 10000 + 0.5) / 10000 AS b_k, ln(1.0 + n) AS lp FROM q),
    m AS (SELECT *, CASE WHEN max(theta_hat) OVER w > min(theta_hat) OVER w THEN (theta_hat - min(theta_hat) OVER w) / (max(theta_hat) OVER w - min(theta_hat) OVER w) ELSE 0.5 END AS nr, CASE WHEN max(wr_hat) OVER w > min(wr_hat) OVER w THEN (wr_hat - min(wr_hat) OVER w) / (max(wr_hat) OVER w - min(wr_hat) OVER w) ELSE 0.5 END AS nw, CASE WHEN max(lp) OVER w > min(lp) OVER w THEN (lp - min(lp) OVER w) / (max(lp) OVER w - min(lp) OVER w) ELSE 0.5 END AS np FROM z WINDOW w AS (PARTITION BY bracket)),
    strong AS (SELECT bracket, spec_id, role, n AS count, total_in_bracket, floor(mean_rating * 10 + 0.5) / 10 AS mean_rating, theta_hat, b_k, floor((theta - 1.645 * sd) * 10 + 0.5) / 10 AS rating_ci_low, floor((theta + 1.645 * sd) * 10 + 0.5) / 10 AS rating_ci_high, floor(coalesce(rate, 0.5) * 10000 + 0.5) / 10000 AS raw_winrate, wr_hat, total_games, total_wins,
    floor(((nr * CASE role WHEN 'dps' THEN 0.40::DOUBLE ELSE 0.25::DOUBLE END + nw * 0.15::DOUBLE) * b_k + np * CASE role WHEN 'dps' THEN 0.45::DOUBLE ELSE 0.60::DOUBLE END) * 10000 + 0.5) / 10000 AS score FROM m)"""


def _strength(t: Ladder) -> DataFrame:
    role = F.when(F.col("spec_id") % 5 == 0, "healer").when(F.col("spec_id") % 5 == 1, "tank").otherwise("dps")
    return strength.strength_rows(strength.top_half(t.entries.withColumn("role", role), ["bracket", "spec_id"]), ["bracket"], ["spec_id"])


@query(f"{_STRENGTH} SELECT * FROM strong", "entries")
def spec_strength(t: Ladder) -> DataFrame:
    return _strength(t)


@query(f"""{_STRENGTH}, now AS (SELECT bracket, spec_id, score, row_number() OVER (PARTITION BY bracket ORDER BY score DESC, spec_id) AS place FROM strong), before AS (SELECT bracket, spec_id, row_number() OVER (PARTITION BY bracket ORDER BY mean_rating DESC, spec_id) AS place FROM strong WHERE spec_id % 6 <> 0)
    SELECT n.bracket, n.spec_id, n.score, n.place, b.place - n.place AS change FROM now n LEFT JOIN before b USING (bracket, spec_id)""", "entries")  # fmt: skip
def rank_change(t: Ladder) -> DataFrame:
    now = _strength(t)
    before = now.where("spec_id % 6 <> 0").select("bracket", "spec_id", F.col("mean_rating").alias("score"))
    return strength.rank_change(now.select("bracket", "spec_id", "score"), before, ["bracket"])


@query("""WITH g AS (SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS wins, sum(quality) / CAST(count(*) AS DOUBLE) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1), h AS (SELECT *, avg(rate) OVER () AS m, coalesce(var_samp(rate) OVER (), 0) AS v FROM g), c AS (SELECT *, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 END AS common FROM h)
    SELECT source, n, wins, floor(rate * 1000000 + 0.5) / 1000000 AS rate, floor((coalesce(m * common, 50) + wins) / (coalesce(m * common, 50) + coalesce((1 - m) * common, 50) + n) * 1000000 + 0.5) / 1000000 AS shrunk FROM c""")  # fmt: skip
def source_quality_shrinkage(t: Ladder) -> DataFrame:
    rows = t.table("labels").join(t.table("documents").select("doc_id", "source"), "doc_id")
    return strength.beta_shrinkage(rows, "source", "quality")


# ---- health and telemetry ------------------------------------------------------------------------------------------


@query(f"""SELECT *, {pct('fully', 'total', 1)} AS pct FROM (SELECT bracket, count(*) AS total, count(*) FILTER (WHERE equipment_at IS NOT NULL AND talents_at IS NOT NULL) AS fully, count(*) FILTER (WHERE equipment_at IS NOT NULL AND talents_at IS NULL) AS eq_only, count(*) FILTER (WHERE equipment_at IS NULL AND talents_at IS NOT NULL) AS spec_only, count(*) FILTER (WHERE equipment_at IS NULL AND talents_at IS NULL) AS none FROM entries GROUP BY 1)""", "entries")
def processing_health(t: Ladder) -> DataFrame:
    return health.processing_health(t.entries)


@query("""SELECT count(*) FILTER (WHERE NOT is_private AND NOT w) AS available, count(*) FILTER (WHERE NOT is_private AND w) AS cooldown, count(*) FILTER (WHERE is_private) AS private FROM (SELECT *, coalesce(unavailable_until > TIMESTAMP '2024-01-01', false) AS w FROM characters WHERE character_id IN (SELECT character_id FROM entries))""", "characters", "entries")
def availability(t: Ladder) -> DataFrame:
    return health.availability(t.characters, t.entries, F.lit("2024-01-01").cast("timestamp"))


@query("""SELECT count(*) FILTER (WHERE age < 24) AS under_24h, count(*) FILTER (WHERE age >= 24 AND age < 168) AS under_168h, count(*) FILTER (WHERE age >= 168 AND age < 720) AS under_720h, count(*) FILTER (WHERE age >= 720) AS over_720h FROM (SELECT (epoch((SELECT max(snapshot_at) FROM entries)) - epoch(equipment_at)) / 3600 AS age FROM entries)""", "entries")
def freshness(t: Ladder) -> DataFrame:
    as_of = F.lit(t.table("orders").agg(F.max("o_orderdate")).first()[0])
    return health.freshness(t.entries, as_of, steps=(24, 168, 720))


_IDS = "SELECT DISTINCT 'item' AS type, CAST(item_id AS VARCHAR) AS id FROM items UNION SELECT DISTINCT 'enchantment', CAST(enchantment_id AS VARCHAR) FROM items WHERE enchantment_id IS NOT NULL"


def _ids(t: Ladder) -> DataFrame:
    return t.items.select(F.lit("item").alias("type"), F.col("item_id").alias("id")).union(t.items.where("enchantment_id is not null").select(F.lit("enchantment"), F.col("enchantment_id").cast("string"))).distinct()


@query(f"""SELECT type, locale, total, present, total - present AS missing, {pct('present', 'total', 1)} AS pct FROM (SELECT i.type, l.locale, count(*) AS total, count(t.value) AS present FROM ({_IDS}) i CROSS JOIN (VALUES ('en_US'), ('fr_FR')) l(locale) LEFT JOIN translations t ON t.type = i.type AND t.id = i.id AND t.locale = l.locale GROUP BY ALL)""", "items", "translations")
def translation_coverage(t: Ladder) -> DataFrame:
    return health.translation_coverage(_ids(t), t.translations, LOCALES)


@query(f"SELECT i.type, i.id, 'fr_FR' AS missing FROM ({_IDS}) i WHERE NOT EXISTS (SELECT 1 FROM translations t WHERE t.type = i.type AND t.id = i.id AND t.locale = 'fr_FR')", "items", "translations")
def missing_locales(t: Ladder) -> DataFrame:
    return health.missing_locales(_ids(t), t.translations, LOCALES).withColumn("missing", F.array_join("missing", ","))


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_COUNTS = ", ".join(f"count(*) FILTER (WHERE region = '{r}') AS \"{r}\"" for r in _REGIONS[:2])


@query(f"SELECT *, {pct('total', 'CAST(sum(total) OVER (PARTITION BY bracket) AS BIGINT)', 1)} AS pct FROM (SELECT bracket, spec_id, {_COUNTS}, count(*) AS total FROM entries WHERE region IN ('AFRICA', 'AMERICA') GROUP BY 1, 2)", "entries")
def region_distribution(t: Ladder) -> DataFrame:
    return health.region_distribution(t.entries, _REGIONS[:2])


@query("""SELECT class_slug, CAST(sum(n) AS BIGINT) AS total, string_agg(spec_id || ':' || n, ',' ORDER BY spec_id) AS specs FROM (SELECT class_slug, spec_id, count(*) AS n FROM (SELECT CASE WHEN spec_id < 5 THEN 'mage' ELSE 'death_knight' END AS class_slug, CASE WHEN spec_id < 5 THEN 62 + spec_id % 3 ELSE 250 + spec_id % 3 END AS spec_id, spec_id % 3 AS s FROM entries) GROUP BY 1, 2) GROUP BY 1""", "entries")
def shuffle_rollup(t: Ladder) -> DataFrame:
    from ..functions.catalog import catalog

    low, k = F.col("spec_id") < 5, F.col("spec_id") % 3
    spec = F.when(low, 62 + k).otherwise(250 + k)
    name = F.when(low, F.element_at(F.array(F.lit("arcane"), F.lit("fire"), F.lit("frost")), (k + 1).cast("int"))).otherwise(F.element_at(F.array(F.lit("blood"), F.lit("frost"), F.lit("unholy")), (k + 1).cast("int")))
    e = t.entries.select(F.concat(F.lit("shuffle-"), F.when(low, "mage").otherwise("death-knight"), F.lit("-"), name).alias("bracket"), spec.alias("spec_id"))
    out = health.solo_distribution(e, catalog(t.spark))
    return out.withColumn("specs", F.array_join(F.transform("specs", lambda s: F.concat(s["spec_id"].cast("string"), F.lit(":"), s["count"].cast("string"))), ","))


_SUM = f"count(*) AS total, count(*) FILTER (WHERE success) AS ok, count(*) FILTER (WHERE NOT success) AS failed, {pct('count(*) FILTER (WHERE success)', 'count(*)')} AS success_pct, floor(avg(duration) * 1000 + 0.5) / 1000 AS avg_duration, max(duration) AS max_duration, min(duration) AS min_duration"
_DAY = "ran_at > (SELECT max(ran_at) FROM metrics) - INTERVAL {0} HOUR"


def _now(t: Ladder):
    return F.lit(t.table("events").agg(F.max("ts")).first()[0])


@query(f"SELECT {_SUM} FROM metrics WHERE {_DAY.format(24)}", "metrics")
def job_summary(t: Ladder) -> DataFrame:
    return health.job_summary(t.metrics, _now(t))


@query(f"SELECT job_class, {_SUM} FROM metrics WHERE {_DAY.format(24)} GROUP BY 1", "metrics")
def job_stats(t: Ladder) -> DataFrame:
    return health.job_stats(t.metrics, _now(t))


@query(f"SELECT error_class, count(*) AS failures FROM metrics WHERE {_DAY.format(72)} AND NOT success GROUP BY 1", "metrics")
def error_distribution(t: Ladder) -> DataFrame:
    return health.error_distribution(t.metrics, _now(t), 72)


@query("SELECT job_id, job_class, duration FROM metrics WHERE duration > 150", "metrics")
def slow_jobs(t: Ladder) -> DataFrame:
    return health.slow_jobs(t.metrics, 150.0).select("job_id", "job_class", "duration")


@query(f"""SELECT queue, jobs, avg_duration, failure_rate, jobs / 86400.0::DOUBLE AS throughput, array_to_string(list_filter([CASE WHEN avg_duration > 30 THEN 'slow' END, CASE WHEN failure_rate > 10 THEN 'failing' END, CASE WHEN jobs / 86400.0 < 0.001 THEN 'behind' END], lambda x: x IS NOT NULL), ',') AS recommendations
    FROM (SELECT CASE WHEN job_class LIKE 'c%' THEN 'fast' WHEN job_class LIKE 'p%' THEN 'bulk' ELSE 'default' END AS queue, count(*) AS jobs, floor(avg(duration) * 1000 + 0.5) / 1000 AS avg_duration, {pct('count(*) FILTER (WHERE NOT success)', 'count(*)')} AS failure_rate FROM metrics WHERE {_DAY.format(24)} GROUP BY 1)""", "metrics")
def queue_health(t: Ladder) -> DataFrame:
    return health.queue_health(t.metrics, _now(t), {"^c": "fast", "^p": "bulk"}, 0.001, 24).withColumn("recommendations", F.array_join("recommendations", ","))


@query(f"""SELECT batch_id, total, ok, failed, skipped, {pct('failed', 'total')} AS failure_pct, failed = total AS all_failed, coalesce(f, '') AS failures FROM (SELECT user_id AS batch_id, count(*) AS total, count(*) FILTER (WHERE k % 10 >= 4) AS ok, count(*) FILTER (WHERE k % 10 = 0) AS failed, count(*) FILTER (WHERE k % 10 BETWEEN 1 AND 3) AS skipped FROM metrics GROUP BY 1)
    LEFT JOIN (SELECT user_id AS batch_id, string_agg(CAST(job_id AS VARCHAR), ',' ORDER BY job_id) AS f FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY job_id) AS i FROM metrics WHERE k % 10 = 0) WHERE i <= 5 GROUP BY 1) USING (batch_id)""", "metrics")
def batch_outcome(t: Ladder) -> DataFrame:
    status = F.when(F.col("k") % 10 == 0, "failed").when(F.col("k") % 10 < 4, "skipped").otherwise("ok")
    rows = t.metrics.select(F.col("user_id").alias("batch_id"), F.col("job_id").alias("id"), status.alias("status"), F.col("error_class").alias("message"))
    out = health.batch_outcome(rows)
    return out.withColumn("failures", F.coalesce(F.array_join(F.transform("failures", lambda f: f["id"].cast("string")), ","), F.lit("")))


@query("""WITH n AS (SELECT talent_type, count(*) AS n FROM talents JOIN talent_dim USING (talent_id) GROUP BY 1), b AS (SELECT talent_type, count(*) * 2 + CASE WHEN talent_type = 'pvp' THEN count(*) ELSE 0 END AS last FROM talents JOIN talent_dim USING (talent_id) GROUP BY 1)
    SELECT talent_type, last, n, CASE WHEN n < 100 THEN 'below floor' WHEN n < 0.5 * last THEN 'below last success' END AS reason FROM b JOIN n USING (talent_type) WHERE n < 100 OR n < 0.5 * last""", "talents", "talent_dim")  # fmt: skip
def regression_check(t: Ladder) -> DataFrame:
    n = t.talents.join(t.talent_dim, "talent_id").groupBy("talent_type").agg(F.count("*").alias("n"))
    return health.regression_check(n, n.withColumn("n", F.when(F.col("talent_type") == "pvp", F.col("n") * 3).otherwise(F.col("n") * 2)))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE equipment_at IS NULL OR talents_at IS NULL) AS unsynced FROM entries", "entries")
def sync_report(t: Ladder) -> DataFrame:
    return health.sync_report(t.entries)


@query("SELECT character_id, count(equipment_at) AS equipment, count(talents_at) AS talents, count(equipment_at) = 0 AS equipment_stale, count(talents_at) = 0 AS talents_stale FROM entries GROUP BY 1", "entries")
def processed_counts(t: Ladder) -> DataFrame:
    return health.processed_counts(t.entries)


@query("""WITH e AS (SELECT character_id, arg_max({e: equipment_at IS NOT NULL, t: talents_at IS NOT NULL}, {s: snapshot_at, i: entry_id}) AS l FROM entries GROUP BY 1), i AS (SELECT character_id, count(*) AS n FROM items GROUP BY 1), t AS (SELECT character_id, count(*) AS n FROM talents GROUP BY 1)
    SELECT c.character_id, coalesce(i.n, 0) AS items, coalesce(t.n, 0) AS talents, CASE WHEN l IS NULL THEN 'no entry' WHEN l.e AND l.t AND coalesce(i.n, 0) > 0 AND coalesce(t.n, 0) > 0 THEN 'ok' WHEN NOT l.e AND NOT l.t THEN 'never processed' WHEN l.e AND coalesce(i.n, 0) = 0 THEN 'items missing' WHEN l.t AND coalesce(t.n, 0) = 0 THEN 'talents missing' ELSE 'partly processed' END AS verdict
    FROM characters c LEFT JOIN e ON e.character_id = c.character_id LEFT JOIN i ON i.character_id = c.character_id LEFT JOIN t ON t.character_id = c.character_id""", "characters", "entries", "items", "talents")  # fmt: skip
def sync_diagnosis(t: Ladder) -> DataFrame:
    return health.sync_diagnosis(t.characters, t.items, t.talents, t.entries).select("character_id", "items", "talents", "verdict")


# ---- dimensions ----------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS node_id, count(*) FILTER (WHERE p_size < 12) AS c FROM part GROUP BY 1) SELECT a.node_id, CAST(sum(b.c) AS BIGINT) AS n FROM p a JOIN p b ON b.node_id BETWEEN a.node_id - 5 AND a.node_id + 5 GROUP BY 1 HAVING sum(b.c) >= 5""")
def gateway_band(t: Ladder) -> DataFrame:
    return dims.crowded_nodes(t.table("part").select(F.col("p_partkey").alias("node_id"), (F.col("p_size") < 12).alias("is_hero")), 5, 5)


@query("""WITH p AS (SELECT p_partkey AS talent_id, p_name AS name, p_type AS talent_type, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS node_id FROM part) SELECT talent_id, coalesce(node_id, (SELECT min(q.node_id) FROM p q WHERE q.name = p.name AND q.talent_type = p.talent_type)) AS node_id FROM p""")
def sibling_fill(t: Ladder) -> DataFrame:
    p = t.table("part").select(F.col("p_partkey").alias("talent_id"), F.col("p_name").alias("name"), F.col("p_type").alias("talent_type"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).alias("node_id"))
    return dims.orphan_nodes(p).select("talent_id", "node_id")


@query("""WITH r AS (SELECT talent_id, node_id FROM talent_dim WHERE max_rank > 1) SELECT r.talent_id, g.spec_id FROM r JOIN (SELECT DISTINCT node_id, spec_id FROM r JOIN assignments USING (talent_id)) g USING (node_id) WHERE NOT EXISTS (SELECT 1 FROM assignments a WHERE a.talent_id = r.talent_id AND a.spec_id = g.spec_id)""", "talent_dim", "assignments")
def sibling_assignments(t: Ladder) -> DataFrame:
    return dims.sibling_assignments(t.talent_dim, t.assignments)


@query("""SELECT a.talent_id, a.spec_id, a.default_points FROM assignments a JOIN talent_dim d ON d.talent_id = a.talent_id LEFT JOIN (SELECT talent_id, spec_id, count(*) AS n FROM talents GROUP BY 1, 2) u ON u.talent_id = a.talent_id AND u.spec_id = a.spec_id WHERE talent_type <> 'spec' OR coalesce(n, 0) >= 10""", "talents", "talent_dim", "assignments")
def prune_rare(t: Ladder) -> DataFrame:
    return dims.prune_rare(t.assignments, t.talent_dim, t.talents, 10)


@query("""SELECT node_id FROM (SELECT p_partkey // 2 AS node_id, count(*) AS v, count(DISTINCT p_type) AS names, coalesce(max(r), 0) AS top FROM part LEFT JOIN (SELECT l_partkey, max(l_linenumber) AS r FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1) WHERE v > 1 AND top <= 1 AND names = 1""")
def fake_rank_nodes(t: Ladder) -> DataFrame:
    part = t.table("part").select(F.col("p_partkey").alias("talent_id"), F.floor(F.col("p_partkey") / 2).alias("node_id"), F.col("p_type").alias("name"))
    used = t.table("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("talent_id"), F.col("l_linenumber").alias("rank"))
    return dims.fake_rank_nodes(part, used)


@query("SELECT talent_id, talent_type, CAST(count(*) OVER (PARTITION BY node_id) AS INTEGER) AS max_rank FROM talent_dim", "talent_dim")
def variant_max_rank(t: Ladder) -> DataFrame:
    return dims.variant_max_rank(t.talent_dim).select("talent_id", "talent_type", "max_rank")


@query("SELECT talent_type, count(*) AS n FROM assignments JOIN talent_dim USING (talent_id) GROUP BY 1", "assignments", "talent_dim")
def assignment_counts(t: Ladder) -> DataFrame:
    return dims.assignment_counts(t.assignments, t.talent_dim)


@query("SELECT character_id FROM characters WHERE character_id NOT IN (SELECT character_id FROM entries WHERE rating > 300000)", "characters", "entries")
def orphans(t: Ladder) -> DataFrame:
    return dims.without_entries(t.characters, t.entries.where("rating > 300000")).select("character_id")


@query("""WITH old AS (SELECT * FROM ranked WHERE rank <= 100), new AS (SELECT * FROM ranked WHERE rank <= 80 AND entry_id % 5 <> 0 AND bracket <> '5-LOW') SELECT DISTINCT bracket, character_id FROM old WHERE bracket IN (SELECT bracket FROM new) AND NOT EXISTS (SELECT 1 FROM new WHERE new.bracket = old.bracket AND new.character_id = old.character_id)""", "ranked")
def dropped_entries(t: Ladder) -> DataFrame:
    old = t.ranked.where("rank <= 100")
    new = t.ranked.where("rank <= 80 and entry_id % 5 <> 0 and bracket <> '5-LOW'")
    return dims.dropped_entries(old, new, ("bracket", "character_id")).select("bracket", "character_id").distinct()


@query("SELECT item_id, spec_id, count(*) AS n FROM (SELECT item_id, coalesce(CASE WHEN character_id % 2 = 0 THEN i.spec_id END, l.spec_id) AS spec_id FROM items i LEFT JOIN (SELECT character_id, arg_max(spec_id, {s: snapshot_at, e: entry_id}) AS spec_id FROM entries GROUP BY 1) l USING (character_id)) GROUP BY ALL", "items", "entries")
def spec_backfill(t: Ladder) -> DataFrame:
    rows = t.items.withColumn("spec_id", F.when(F.col("character_id") % 2 == 0, F.col("spec_id")))
    return dims.latest_spec(rows, t.entries).groupBy("item_id", "spec_id").agg(F.count("*").alias("n"))


@query("SELECT character_id, bracket, entry_id, snapshot_at FROM (SELECT *, row_number() OVER (PARTITION BY character_id, bracket ORDER BY snapshot_at DESC NULLS LAST, entry_id DESC) AS k FROM entries) WHERE k = 1", "entries")
def latest_per_key(t: Ladder) -> DataFrame:
    return dims.latest_per_key(t.entries, ["character_id", "bracket"], "snapshot_at", "entry_id").select("character_id", "bracket", "entry_id", "snapshot_at")


# ---- incremental ---------------------------------------------------------------------------------------------------


@query("SELECT character_id, arg_max(spec_id, {t: equipment_at, e: entry_id}) AS spec_id, arg_max(rating, {t: equipment_at, e: entry_id}) AS rating, max(equipment_at) AS equipment_at FROM entries WHERE equipment_at IS NOT NULL GROUP BY 1", "entries")
def latest_processed(t: Ladder) -> DataFrame:
    return incremental.latest_processed(t.entries, "equipment_at", ["spec_id", "rating"]).select("character_id", "spec_id", "rating", "equipment_at")


@query("SELECT bracket, character_id, entry_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY bracket, character_id ORDER BY rank, rating DESC, wins DESC, losses, entry_id) AS k FROM ranked) WHERE k = 1", "ranked")
def best_placement(t: Ladder) -> DataFrame:
    by = W.partitionBy("bracket", "character_id").orderBy("rank", F.desc("rating"), F.desc("wins"), "losses", "entry_id")
    return t.ranked.withColumn("_k", F.row_number().over(by)).where("_k = 1").select("bracket", "character_id", "entry_id", "rank")


@query("""WITH p AS (SELECT user_id AS cycle_id, job_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY job_id) AS done, count(*) OVER (PARTITION BY user_id) AS expected FROM metrics), q AS (SELECT *, CAST(done * 100 // expected AS INTEGER) AS pct FROM p), r AS (SELECT *, coalesce(lag(pct) OVER (PARTITION BY cycle_id ORDER BY seq), 0) AS before FROM q)
    SELECT cycle_id, seq, pct, array_to_string(list_filter([25, 50, 75], lambda x: before < x AND pct >= x), ',') AS milestones FROM r WHERE (before < 25 AND pct >= 25) OR (before < 50 AND pct >= 50) OR (before < 75 AND pct >= 75)""", "metrics")  # fmt: skip
def milestones(t: Ladder) -> DataFrame:
    by = W.partitionBy("user_id")
    p = t.metrics.select(F.col("user_id").alias("cycle_id"), F.col("job_id").alias("seq"), F.row_number().over(by.orderBy("job_id")).alias("done"), F.count("*").over(by).alias("expected"))
    return incremental.milestones(p).where(F.size("milestones") > 0).select("cycle_id", "seq", "pct", F.array_join(F.col("milestones").cast("array<string>"), ",").alias("milestones"))


_PRINT = "SELECT character_id, spec_id, string_agg(slot || ':' || item_id || ':' || item_level || ':' || coalesce(CAST(enchantment_id AS VARCHAR), '') || ':' || array_to_string(list_sort(crafting_stats), '+'), ',' ORDER BY slot) AS fingerprint FROM {0} GROUP BY 1, 2"


@query(f"SELECT n.* FROM ({_PRINT.format('items')}) n LEFT JOIN ({_PRINT.format('(SELECT * FROM items WHERE item_level > 3 AND character_id % 10 <> 0)')}) o USING (character_id, spec_id) WHERE o.fingerprint IS NULL OR o.fingerprint <> n.fingerprint", "items")
def fingerprint_diff(t: Ladder) -> DataFrame:
    old = incremental.item_fingerprints(t.items.where("item_level > 3 and character_id % 10 <> 0"))
    return incremental.changed_only(incremental.item_fingerprints(t.items), old, ["character_id", "spec_id"], "fingerprint")


@query("""WITH old AS (SELECT entry_id, rating, wins, losses FROM entries WHERE entry_id % 3 <> 0), new AS (SELECT entry_id, rating + 10 AS rating, wins + 1 AS wins FROM entries WHERE entry_id % 2 = 0)
    SELECT coalesce(o.entry_id, n.entry_id) AS entry_id, CASE WHEN n.entry_id IS NOT NULL THEN n.rating ELSE o.rating END AS rating, CASE WHEN o.entry_id IS NULL THEN n.wins ELSE o.wins END AS wins, o.losses FROM old o FULL JOIN new n ON o.entry_id = n.entry_id""", "entries")  # fmt: skip
def upsert(t: Ladder) -> DataFrame:
    old = t.entries.where("entry_id % 3 <> 0").select("entry_id", "rating", "wins", "losses")
    new = t.entries.where("entry_id % 2 = 0").select("entry_id", (F.col("rating") + 10).alias("rating"), (F.col("wins") + 1).alias("wins"))
    return tables.upsert(old, new, ["entry_id"], ["rating"])


@query("""WITH old AS (SELECT p_partkey, p_size, p_brand FROM part), u AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 1 END AS p_size FROM part WHERE p_partkey % 3 = 0) SELECT o.p_partkey, coalesce(u.p_size, o.p_size) AS p_size, p_brand, u.p_size IS NOT NULL AND u.p_size <> o.p_size AS changed FROM old o LEFT JOIN u USING (p_partkey)""")
def update_from(t: Ladder) -> DataFrame:
    p = t.table("part").select("p_partkey", "p_size", "p_brand")
    u = p.where("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(F.col("p_size") + 1).alias("p_size"))
    return tables.update_from(p, u, "p_partkey")


@query("SELECT entry_id, CASE WHEN sync_retry_count < 3 THEN 'requeue' ELSE 'exhausted' END AS outcome, CASE WHEN sync_retry_count < 3 THEN sync_retry_count + 1 ELSE sync_retry_count END AS sync_retry_count FROM entries WHERE equipment_at IS NULL OR talents_at IS NULL", "entries")
def retry_split(t: Ladder) -> DataFrame:
    return incremental.split_retries(t.entries).select("entry_id", "outcome", "sync_retry_count")


@query("""WITH runs AS (SELECT user_id AS run_id, min(ran_at) AS created_at, max(ran_at) AS updated_at FROM metrics GROUP BY 1), n AS (SELECT max(ran_at) - INTERVAL 1 HOUR AS t FROM metrics) SELECT run_id, CASE WHEN created_at < t - INTERVAL 696 HOUR THEN 'abort' ELSE 'recover' END AS action FROM runs, n WHERE updated_at < t - INTERVAL 120 MINUTE""", "metrics")
def stale_runs(t: Ladder) -> DataFrame:
    runs = t.metrics.groupBy(F.col("user_id").alias("run_id")).agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at")).withColumn("status", F.lit("syncing"))
    return incremental.stale_runs(runs, _now(t) - F.expr("INTERVAL 1 HOUR"), 120, 696).select("run_id", "action")


@query("SELECT job_class, count(*) AS n FROM metrics WHERE ran_at >= (SELECT max(ran_at) FROM metrics) - INTERVAL 7 DAY GROUP BY 1", "metrics")
def retained_metrics(t: Ladder) -> DataFrame:
    return incremental.retain(t.metrics, "at", _now(t), 7).groupBy("job_class").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ran_at) AS hour, job_class, count(*) AS total, count(*) FILTER (WHERE NOT success) AS failed, floor(avg(duration) * 1000 + 0.5) / 1000 AS avg_duration FROM metrics GROUP BY 1, 2", "metrics")
def job_windows(t: Ladder) -> DataFrame:
    return streams.job_windows(t.metrics).withColumn("avg_duration", X.half_up(F.col("avg_duration"), 3))


@query("""SELECT bracket, region, character_id, rank, CAST(floor(rating) AS INTEGER) AS rating, wins, losses, faction FROM (SELECT *, row_number() OVER (PARTITION BY bracket, region, character_id ORDER BY rank) AS k FROM (SELECT *, CASE entry_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS faction FROM ranked) WHERE rank <= 500) WHERE k = 1""", "ranked")
def ingest_leaderboard(t: Ladder) -> DataFrame:
    """Ladders packed as payloads, in pages of 400 by rank, and read again: the first 500 of each, a character once."""
    kind = F.when(F.col("entry_id") % 3 == 0, "ALLIANCE").when(F.col("entry_id") % 3 == 1, "HORDE").otherwise("NEUTRAL")
    e = F.struct(F.struct(F.col("character_id").alias("id"), "name", F.struct(F.col("realm").alias("slug")).alias("realm")).alias("character"), F.struct(kind.alias("type")).alias("faction"), "rank", F.col("rating").cast("int").alias("rating"), F.struct(F.col("wins").cast("int").alias("won"), F.col("losses").cast("int").alias("lost")).alias("season_match_statistics"))
    packed = t.ranked.withColumn("offset", F.floor((F.col("rank") - 1) / 400) * 400).groupBy("bracket", "region", "offset").agg(F.array_sort(F.collect_list(F.struct("rank", e.alias("e")))).alias("l"))
    p = packed.select(F.lit(1).cast("long").alias("season_id"), "bracket", "region", "offset", F.lit(None).cast("timestamp").alias("fetched_at"), F.transform("l", lambda x: x["e"]).alias("entries"))
    return ingest.leaderboard(p).select("bracket", "region", "character_id", "rank", "rating", F.col("wins").cast("long").alias("wins"), F.col("losses").cast("long").alias("losses"), "faction")


@query("""SELECT character_id, count(*) AS pieces, CAST(sum(item_level) // count(*) AS INTEGER) AS item_level, CAST(sum(haste) AS BIGINT) AS haste, count(enchantment_id) AS enchants FROM items WHERE slot <> 7 AND item_level > 0 GROUP BY 1""", "items")
def ingest_equipment(t: Ladder) -> DataFrame:
    """Worn items packed as equipment payloads and read again; slot 7 is a tabard."""
    empty = "array<struct<socket_type:struct<type:string>,item:struct<id:bigint,name:string>,display_string:string>>"
    enchant = F.struct(F.lit("Enchanted: x").alias("display_string"), F.col("enchantment_id").cast("long").alias("enchantment_id"), F.struct(F.lit("PERMANENT").alias("type")).alias("enchantment_slot"), F.struct(F.lit(None).cast("long").alias("id")).alias("source_item"))
    stat = F.struct(F.struct(F.lit("HASTE_RATING").alias("type")).alias("type"), F.try_element_at("stats", F.lit("haste")).alias("value"), F.lit(False).alias("is_negated"))
    item = F.struct(F.struct(F.col("slot").cast("long").alias("id")).alias("item"), F.struct(F.when(F.col("slot") == 7, "TABARD").otherwise(F.concat(F.lit("SLOT"), F.col("slot").cast("string"))).alias("type")).alias("slot"), F.struct(F.col("item_level").alias("value")).alias("level"), F.lit("7").alias("context"), F.array(F.lit(1)).alias("bonus_list"), F.when(F.col("enchantment_id").isNotNull(), F.array(enchant)).otherwise(F.array().cast("array<struct<display_string:string,enchantment_id:bigint,enchantment_slot:struct<type:string>,source_item:struct<id:bigint>>>")).alias("enchantments"), F.lit(None).cast(empty).alias("sockets"), F.lit(None).cast("array<struct<type:string>>").alias("modified_crafting_stat"), F.array(stat).alias("stats"))
    p = t.items.groupBy("character_id", "spec_id").agg(F.collect_list(item).alias("equipped_items"))
    rows = ingest.equipment(p)
    return rows.groupBy("character_id").agg(F.count("*").alias("pieces"), F.floor(F.sum("item_level") / F.count("*")).cast("int").alias("item_level"), F.sum(F.try_element_at("stats", F.lit("haste"))).alias("haste"), F.count("enchantment_id").alias("enchants"))


@query("""SELECT * FROM (SELECT s_suppkey AS id, s_name AS value FROM supplier WHERE s_suppkey % 2 = 0) UNION ALL (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 = 0 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0))""")
def insert_ignore(t: Ladder) -> DataFrame:
    old = t.table("supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("value"))
    return tables.insert_ignore(old, t.table("customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("value")), ["id"])


@query("""SELECT character_id, slot, item_level FROM items WHERE character_id % 4 <> 0 UNION ALL SELECT character_id, slot, item_level + 1 FROM items WHERE character_id % 4 = 0 AND slot < 3""", "items")
def replace_slice(t: Ladder) -> DataFrame:
    old = t.items.select("character_id", "slot", "item_level")
    new = old.where("character_id % 4 = 0 and slot < 3").withColumn("item_level", F.col("item_level") + 1)
    return tables.replace_slice(old, old.where("character_id % 4 = 0").select("character_id"), new)


@query("""WITH v AS (SELECT entry_id, spec_id AS season_id, CASE WHEN entry_id % 9 = 0 AND spec_id % 2 = 0 THEN 5 WHEN entry_id % 9 = 1 THEN 4 END AS cycle_id FROM entries), h AS (SELECT season_id, coalesce(bool_or(cycle_id = 5), false) AS h FROM v GROUP BY 1) SELECT entry_id, season_id FROM v JOIN h USING (season_id) WHERE CASE WHEN h THEN cycle_id = 5 ELSE cycle_id IS NULL END""", "entries")
def live_rows(t: Ladder) -> DataFrame:
    cycle = F.when((F.col("entry_id") % 9 == 0) & (F.col("spec_id") % 2 == 0), 5).when(F.col("entry_id") % 9 == 1, 4)
    return ladder.live_rows(t.entries.select("entry_id", F.col("spec_id").alias("season_id"), cycle.alias("cycle_id")), 5).select("entry_id", "season_id")


@query("""SELECT character_id, NOT is_private AND (unavailable_until IS NULL OR unavailable_until <= TIMESTAMP '2024-01-01') AS available, character_id NOT IN (SELECT character_id FROM entries WHERE equipment_at > (SELECT max(snapshot_at) FROM entries) - INTERVAL 240 HOUR) AS due FROM characters""", "characters", "entries")
def sync_candidates(t: Ladder) -> DataFrame:
    as_of = F.lit(t.table("orders").agg(F.max("o_orderdate")).first()[0])
    ready = ladder.available(t.characters, F.lit("2024-01-01").cast("timestamp")).select("character_id", F.lit(True).alias("_a"))
    due = ladder.not_recent(t.characters, t.entries, as_of, 240).select("character_id", F.lit(True).alias("_d"))
    rows = t.characters.join(ready, "character_id", "left").join(due, "character_id", "left")
    return rows.select("character_id", F.coalesce("_a", F.lit(False)).alias("available"), F.coalesce("_d", F.lit(False)).alias("due"))


@query("""SELECT talent_id, spec_id, default_points FROM (SELECT a.talent_id, a.spec_id, CASE WHEN d.talent_id % 4 = 0 THEN 3 ELSE a.default_points END AS default_points FROM assignments a JOIN talent_dim d ON d.talent_id = a.talent_id)""", "assignments", "talent_dim")
def copied_points(t: Ladder) -> DataFrame:
    points = t.talent_dim.select("talent_id", F.when(F.col("talent_id") % 4 == 0, 3).otherwise(0).alias("default_points"))
    return dims.copy_points(t.assignments, points).select("talent_id", "spec_id", "default_points")


@query("""SELECT talent_id, max(talent_type) AS talent_type FROM (SELECT d.talent_id, CASE max(CASE d.talent_type WHEN 'hero' THEN 3 WHEN 'spec' THEN 2 ELSE 1 END) OVER (PARTITION BY node_id, name) WHEN 3 THEN 'hero' WHEN 2 THEN 'spec' ELSE 'class' END AS talent_type FROM talent_dim d WHERE talent_type <> 'pvp') GROUP BY 1""", "talent_dim")
def section_types(t: Ladder) -> DataFrame:
    d = t.talent_dim.where("talent_type <> 'pvp'")
    same = d.select("node_id", "name", F.col("talent_type").alias("kind"))
    return talents.section_type(d.select("talent_id", "node_id", "name").join(same, ["node_id", "name"]).select("talent_id", F.col("kind").alias("talent_type")))


# ---- texts ---------------------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, md5(coalesce(t, '')) AS digest, length(t) AS n_chars FROM (SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<br[ \t\r\n\f]*/?>', chr(10), 'gi'), '</(p|li|tr|td|div)>', chr(10), 'gi'), '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '') AS t FROM pages)""")
def strip_html(t: Ladder) -> DataFrame:
    text = X.strip_html(F.col("html"))
    return t.table("pages").select("page_id", F.md5(F.coalesce(text, F.lit(""))).alias("digest"), F.length(text).cast("long").alias("n_chars"))


@query(r"""SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) = (SELECT min(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) FROM pages) THEN 'https://cdn.example' || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) ELSE url END AS url FROM pages""")
def host_rewrite(t: Ladder) -> DataFrame:
    pages = t.table("pages")
    host = pages.agg(F.min(F.try_parse_url("url", F.lit("HOST")))).first()[0]
    return pages.select("page_id", X.host_rewrite(F.col("url"), host or "", "https://cdn.example").alias("url"))


@query(r"""SELECT p_partkey, CAST(nullif(regexp_extract(s, '(?i)\+\s*(\d+)\s+Haste', 1), '') AS INTEGER) AS haste, CAST(nullif(regexp_extract(s, '(?i)\+\s*(\d+)\s+Crit', 1), '') AS INTEGER) AS crit FROM (SELECT p_partkey, p_name || ' +' || p_size || CASE WHEN p_size % 2 = 0 THEN ' haste' ELSE ' Critical Strike' END AS s FROM part)""")
def stat_text(t: Ladder) -> DataFrame:
    text = F.concat("p_name", F.lit(" +"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " haste").otherwise(" Critical Strike"))
    return t.table("part").select("p_partkey", X.parse_stat(text, "haste").alias("haste"), X.parse_stat(text, "crit").alias("crit"))


# ---- profiles and reports ------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT character_id, arg_max(spec_id, {r: rating, e: -entry_id}) AS primary_spec_id, count(*) AS n_entries FROM entries GROUP BY 1), i AS (SELECT character_id, spec_id, string_agg(slot || '=' || item_id, ',' ORDER BY slot) AS equipment FROM items GROUP BY 1, 2), t AS (SELECT character_id, spec_id, string_agg(talent_id || '=' || rank, ',' ORDER BY talent_id) AS talents FROM talents GROUP BY 1, 2)
    SELECT c.character_id, primary_spec_id, coalesce(n_entries, -1) AS n_entries, coalesce(equipment, '') AS equipment, coalesce(talents, '') AS talents FROM characters c LEFT JOIN s ON s.character_id = c.character_id LEFT JOIN i ON i.character_id = c.character_id AND i.spec_id = primary_spec_id LEFT JOIN t ON t.character_id = c.character_id AND t.spec_id = primary_spec_id""", "characters", "entries", "items", "talents")  # fmt: skip
def character_profile(t: Ladder) -> DataFrame:
    p = read_models.profiles(t.characters, t.entries.withColumn("rank", F.lit(0)), t.items, t.talents)
    joined = lambda c, a, b: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(x[a].cast("string"), F.lit("="), x[b].cast("string"))), ","), F.lit(""))
    return p.select("character_id", "primary_spec_id", F.coalesce(F.size("entries"), F.lit(-1)).cast("long").alias("n_entries"), joined("equipment", "slot", "item_id").alias("equipment"), joined("talents", "talent_id", "rank").alias("talents"))


@query("""SELECT 'EU' || '/' || realm || '/' || name AS line FROM characters WHERE character_id IN (SELECT character_id FROM entries WHERE equipment_at IS NULL OR talents_at IS NULL)""", "characters", "entries")
def failed_characters(t: Ladder) -> DataFrame:
    return read_models.failed_characters(t.entries, t.characters.withColumn("region", F.lit("eu")))
