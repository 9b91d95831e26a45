"""Ladder tables out of the star schema that the queries run on: the same mapping as DataFrames and as SQL text."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TALENTS = 24


class Ladder:
    """Ladder tables of a folder of the star schema. Nothing is read before it is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:  # the files' footers are read once
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def orders(self) -> DataFrame:
        """An order is an entry, its priority the bracket, its price the rating, its customer the character: all of it but wins and losses."""
        places = F.broadcast(self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))  # 25 rows in every size
        o = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        return o.select(
            F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("character_id"), F.col("o_orderpriority").alias("bracket"), F.col("r_name").alias("region"), F.col("c_nationkey").alias("spec_id"), F.col("c_mktsegment").alias("role"),
            F.col("o_totalprice").alias("rating"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("equipment_at"),
            F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("talents_at"), F.col("o_orderdate").alias("snapshot_at"), F.col("c_name").alias("name"), F.lower(F.translate("n_name", " ", "-")).alias("realm"),
            F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 3).alias("hero_tree_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 5).alias("tier_set_pieces"), (F.col("o_orderkey") % 4).alias("sync_retry_count"),
            F.when(F.col("o_orderkey") % 5 != 0, F.create_map(F.col("c_nationkey").cast("string"), F.concat(F.lit("code"), (F.col("o_orderkey") % 7).cast("string")))).otherwise(F.create_map(F.lit("-1"), F.lit("other"))).alias("loadout_codes"),
        )

    @cached_property
    def entries(self) -> DataFrame:
        games = self.table("lineitem").groupBy(F.col("l_orderkey").alias("entry_id")).agg(F.count_if(F.col("l_returnflag") == "N").alias("wins"), F.count_if(F.col("l_returnflag") == "R").alias("losses"))
        return self.orders.join(games, "entry_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("wins", "losses")})

    @cached_property
    def lined(self) -> DataFrame:
        """entries with the talents of their own lines (ids), in one pass over lines and orders."""
        wins = [F.count_if(F.col("l_returnflag") == "N").alias("wins"), F.count_if(F.col("l_returnflag") == "R").alias("losses")]
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("entry_id")).agg(*wins, F.collect_list(F.col("l_partkey") % TALENTS + 1).alias("ids"))  # few lines an order
        return self.orders.join(lines, "entry_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("wins", "losses")})

    @cached_property
    def best_with_talents(self) -> DataFrame:
        """The best entry of each character and bracket whose talents are processed, with `talents`: those of the character's newest order.

        Orders are reduced to one a bracket before a character's meet.
        """
        ready = F.col("talents_at").isNotNull() & F.col("spec_id").isNotNull()
        best = F.max_by(F.struct("entry_id", "rating", "wins", "losses", "talents_at"), F.when(ready, F.struct(F.col("rating").isNull(), "rating", -F.col("entry_id"))))
        rows = self.lined.groupBy("character_id", "spec_id", "bracket").agg(best.alias("best"), F.max(F.struct("snapshot_at", "entry_id", "ids")).alias("newest"))
        ids = F.max("newest").over(W.partitionBy("character_id"))["ids"]
        rows = rows.withColumn("ids", ids).where("best is not null").select("character_id", "spec_id", "bracket", "best.*", "ids")
        rank = lambda t: F.least(F.lit(3), F.size(F.filter("ids", lambda x: x == t))).alias("rank")
        return rows.withColumn("talents", F.transform(F.array_distinct("ids"), lambda t: F.struct(t.alias("talent_id"), rank(t)))).drop("ids")

    @cached_property
    def ranked(self) -> DataFrame:
        """entries with their place in their ladder (bracket and region)."""
        by = W.partitionBy("bracket", "region").orderBy(F.desc("rating"), "entry_id")
        return self.entries.withColumn("rank", F.row_number().over(by))

    @cached_property
    def characters(self) -> DataFrame:
        c = self.table("customer")
        start = F.lit("2024-01-01").cast("timestamp")
        return c.select(F.col("c_custkey").alias("character_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("realm"), (F.col("c_custkey") % 11 == 0).alias("is_private"), F.when(F.col("c_custkey") % 7 == 0, start + F.make_interval(days=(F.col("c_custkey") % 10).cast("int") - 5)).alias("unavailable_until"))

    @cached_property
    def lines(self) -> DataFrame:
        o = self.table("orders").join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderdate", "c_nationkey")
        return self.table("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def items(self) -> DataFrame:
        """The newest line of each character and slot (line number) is what it wears there."""
        by = W.partitionBy("o_custkey", "l_linenumber").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
        worn = self.lines.withColumn("k", F.row_number().over(by)).where("k = 1").join(self.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        stat = lambda c: F.round(F.col(c) * 100).cast("int")
        return worn.select(
            F.col("o_custkey").alias("character_id"), F.col("c_nationkey").alias("spec_id"), F.col("l_linenumber").alias("slot"), F.col("p_brand").alias("item_id"), F.when(F.col("l_discount") > 0, F.col("l_suppkey")).alias("enchantment_id"),
            F.col("l_quantity").cast("int").alias("item_level"), F.create_map(F.lit("haste"), stat("l_tax"), F.lit("crit"), stat("l_discount"), F.lit("mastery"), F.col("l_quantity").cast("int")).alias("stats"),
            F.when(F.col("l_suppkey") % 3 == 0, F.array("l_returnflag", "l_linestatus")).otherwise(F.array().cast("array<string>")).alias("crafting_stats"),
        )

    @cached_property
    def sockets(self) -> DataFrame:
        """A row for each line of a character and slot is a socket; some are empty."""
        return self.lines.select(F.col("o_custkey").alias("character_id"), F.col("c_nationkey").alias("spec_id"), F.col("l_linenumber").alias("slot"), F.col("l_returnflag").alias("socket_type"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_suppkey") % 10).alias("gem_id"))

    @cached_property
    def talents(self) -> DataFrame:
        """The parts of a customer's newest order are its talents; how often one comes, to 3, is the rank."""
        newest = self.table("orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("n"))
        lines = self.lines.join(newest, "o_custkey").where("l_orderkey = n.o_orderkey")
        return lines.groupBy(F.col("o_custkey").alias("character_id"), F.col("c_nationkey").alias("spec_id"), (F.col("l_partkey") % TALENTS + 1).alias("talent_id")).agg(F.least(F.lit(3), F.count("*")).cast("int").alias("rank"))

    @cached_property
    def talent_dim(self) -> DataFrame:
        t = self.table("part").select((F.col("p_partkey") % TALENTS + 1).alias("talent_id")).distinct()
        i = F.col("talent_id")
        kind = F.when(i <= 6, "class").when(i <= 12, "spec").when(i <= 18, "hero").otherwise("pvp")
        return t.select("talent_id", kind.alias("talent_type"), (F.floor((i + 1) / 2) + 100).alias("node_id"), F.concat(F.lit("N"), (i * 5 % 11).cast("string")).alias("name"), F.when(i % 7 != 0, F.concat(F.lit("icon"), i.cast("string"))).alias("icon"), (i % 3 + 1).cast("int").alias("max_rank"))

    @cached_property
    def assignments(self) -> DataFrame:
        s = self.table("nation").select(F.col("n_nationkey").alias("spec_id"))
        both = self.talent_dim.select("talent_id").withColumn("one", F.lit(1)).join(s.withColumn("one", F.lit(1)), "one")
        k = F.col("talent_id") + F.col("spec_id")
        return both.where(k % 3 != 0).select("talent_id", "spec_id", F.when(k % 8 == 0, 1).otherwise(0).alias("default_points"))

    @cached_property
    def edges(self) -> DataFrame:
        """Each hero node but 109 needs the one before it, if that isn't 108."""
        n = self.talent_dim.where("talent_type = 'hero'").select("node_id").distinct()
        return n.where("node_id <> 109").select("node_id", (F.col("node_id") - 1).alias("prerequisite_id"))

    @cached_property
    def translations(self) -> DataFrame:
        i = self.table("part").select(F.lit("item").alias("type"), F.col("p_brand").alias("id")).distinct()
        e = self.table("supplier").select(F.lit("enchantment").alias("type"), F.col("s_suppkey").cast("string").alias("id"))
        both = i.union(e)
        name = F.concat(F.lit("name "), F.right("id", F.lit(1)))
        en = both.select("type", "id", F.lit("en_US").alias("locale"), F.lit("name").alias("key"), name.alias("value"))
        fr = both.where(F.right("id", F.lit(1)).isin("2", "4", "6")).select("type", "id", F.lit("fr_FR").alias("locale"), F.lit("name").alias("key"), F.concat(F.lit("nom "), F.right("id", F.lit(1))).alias("value"))
        return en.union(fr)

    @cached_property
    def metrics(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("job_class"), F.col("ts").alias("at"), F.col("value").alias("duration"), (k % 10 != 0).alias("success"), F.concat(F.lit("Error"), (k % 30).cast("string")).alias("error_class"), F.col("user_id").alias("user_id"), k.alias("k"))


#: The same tables in SQL, as common table expressions; each may use those before it.
CTES = {
    "games": "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'N') AS w, count(*) FILTER (WHERE l_returnflag = 'R') AS l FROM lineitem GROUP BY 1",
    "entries": """SELECT o_orderkey AS entry_id, o_custkey AS character_id, o_orderpriority AS bracket, r_name AS region, c_nationkey AS spec_id, c_mktsegment AS role, o_totalprice AS rating,
        coalesce(w, 0) AS wins, coalesce(l, 0) AS losses, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS equipment_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS talents_at, o_orderdate AS snapshot_at, c_name AS name,
        lower(replace(n_name, ' ', '-')) AS realm, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 END AS hero_tree_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 END AS tier_set_pieces, o_orderkey % 4 AS sync_retry_count,
        CASE WHEN o_orderkey % 5 <> 0 THEN 'code' || (o_orderkey % 7) END AS loadout_code
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN games ON l_orderkey = o_orderkey""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY bracket, region ORDER BY rating DESC, entry_id) AS rank FROM entries",
    "characters": """SELECT c_custkey AS character_id, c_name AS name, c_mktsegment AS realm, c_custkey % 11 = 0 AS is_private,
        CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 10 - 5 AS INTEGER)) END AS unavailable_until FROM customer""",
    "lines": "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
    "items": """SELECT o_custkey AS character_id, c_nationkey AS spec_id, l_linenumber AS slot, p_brand AS item_id, CASE WHEN l_discount > 0 THEN l_suppkey END AS enchantment_id, CAST(l_quantity AS INTEGER) AS item_level,
        CAST(round(l_tax * 100) AS INTEGER) AS haste, CAST(round(l_discount * 100) AS INTEGER) AS crit, CAST(l_quantity AS INTEGER) AS mastery, CASE WHEN l_suppkey % 3 = 0 THEN [l_returnflag, l_linestatus] ELSE [] END AS crafting_stats
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, l_linenumber ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS k FROM lines) JOIN part ON l_partkey = p_partkey WHERE k = 1""",
    "sockets": "SELECT o_custkey AS character_id, c_nationkey AS spec_id, l_linenumber AS slot, l_returnflag AS socket_type, CASE WHEN l_partkey % 5 <> 0 THEN l_suppkey % 10 END AS gem_id FROM lines",
    "talents": """SELECT o_custkey AS character_id, c_nationkey AS spec_id, l_partkey % 24 + 1 AS talent_id, CAST(least(3, count(*)) AS INTEGER) AS rank
        FROM lines WHERE l_orderkey = (SELECT arg_max(o2.o_orderkey, {d: o2.o_orderdate, k: o2.o_orderkey}) FROM orders o2 WHERE o2.o_custkey = lines.o_custkey) GROUP BY 1, 2, 3""",
    "talent_dim": """SELECT talent_id, CASE WHEN talent_id <= 6 THEN 'class' WHEN talent_id <= 12 THEN 'spec' WHEN talent_id <= 18 THEN 'hero' ELSE 'pvp' END AS talent_type, (talent_id + 1) // 2 + 100 AS node_id, 'N' || (talent_id * 5 % 11) AS name,
        CASE WHEN talent_id % 7 <> 0 THEN 'icon' || talent_id END AS icon, CAST(talent_id % 3 + 1 AS INTEGER) AS max_rank FROM (SELECT DISTINCT p_partkey % 24 + 1 AS talent_id FROM part)""",
    "assignments": "SELECT talent_id, n_nationkey AS spec_id, CASE WHEN (talent_id + n_nationkey) % 8 = 0 THEN 1 ELSE 0 END AS default_points FROM talent_dim, nation WHERE (talent_id + n_nationkey) % 3 <> 0",
    "edges": "SELECT DISTINCT node_id, node_id - 1 AS prerequisite_id FROM talent_dim WHERE talent_type = 'hero' AND node_id <> 109",
    "translations": """SELECT type, id, 'en_US' AS locale, 'name ' || right(id, 1) AS value FROM (SELECT DISTINCT 'item' AS type, p_brand AS id FROM part UNION ALL SELECT 'enchantment', CAST(s_suppkey AS VARCHAR) FROM supplier)
        UNION ALL SELECT type, id, 'fr_FR', 'nom ' || right(id, 1) FROM (SELECT DISTINCT 'item' AS type, p_brand AS id FROM part UNION ALL SELECT 'enchantment', CAST(s_suppkey AS VARCHAR) FROM supplier) WHERE right(id, 1) IN ('2', '4', '6')""",
    "metrics": "SELECT event_id AS job_id, event_type AS job_class, ts AS ran_at, value AS duration, k % 10 <> 0 AS success, 'Error' || (k % 30) AS error_class, user_id, k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
    # cohorts: the best entry of each character and bracket, ranked in its spec, the first ten kept
    "best_eq": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bracket, character_id ORDER BY rating DESC NULLS FIRST, entry_id) AS k FROM entries WHERE spec_id IS NOT NULL AND equipment_at IS NOT NULL) WHERE k = 1",
    "cohort": "SELECT * FROM (SELECT *, rank() OVER (PARTITION BY bracket, spec_id ORDER BY rating DESC NULLS FIRST) AS spec_rank FROM best_eq) WHERE spec_rank <= 10",
    "best_talent": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bracket, character_id ORDER BY rating DESC NULLS FIRST, entry_id) AS k FROM entries WHERE spec_id IS NOT NULL AND talents_at IS NOT NULL) WHERE k = 1",
    "weighted": """SELECT *, CASE WHEN spec_rank <= spec_total * 0.15 AND wins * 100.0 / nullif(wins + losses, 0) > 60 THEN 3 WHEN spec_rank <= spec_total * 0.5 OR wins * 100.0 / nullif(wins + losses, 0) > 55 THEN 2 ELSE 1 END AS weight
        FROM (SELECT *, rank() OVER (PARTITION BY bracket, spec_id ORDER BY rating DESC NULLS FIRST) AS spec_rank, count(*) OVER (PARTITION BY bracket, spec_id) AS spec_total FROM best_talent) WHERE spec_rank <= 10""",
    "usage_base": """SELECT bracket, spec_id, talent_id, sum(weight) AS usage_count FROM weighted JOIN talents USING (character_id, spec_id) GROUP BY ALL""",
    "usage": """SELECT u.bracket, u.spec_id, u.talent_id, talent_type, coalesce(default_points, 0) AS default_points, CAST(usage_count AS BIGINT) AS usage_count, ((usage_count * 2000000 + total) // (2 * total))::DOUBLE / 10000 AS usage_pct
        FROM usage_base u JOIN talent_dim USING (talent_id) LEFT JOIN assignments a ON a.talent_id = u.talent_id AND a.spec_id = u.spec_id JOIN (SELECT bracket, spec_id, sum(weight) AS total FROM weighted GROUP BY 1, 2) t ON t.bracket = u.bracket AND t.spec_id = u.spec_id""",
    "builds": "SELECT bracket, spec_id, build, build_weight FROM (SELECT *, row_number() OVER (PARTITION BY bracket, spec_id ORDER BY build_weight DESC, build) AS k FROM (SELECT bracket, spec_id, build, CAST(sum(weight) AS BIGINT) AS build_weight FROM (SELECT bracket, spec_id, character_id, weight, list_sort(list(talent_id)) AS build FROM weighted JOIN talents USING (character_id, spec_id) WHERE rank > 0 GROUP BY ALL) GROUP BY 1, 2, 3)) WHERE k = 1",
    "ranks": "SELECT bracket, spec_id, talent_id, rank AS top_build_rank FROM (SELECT *, row_number() OVER (PARTITION BY bracket, spec_id, talent_id ORDER BY w DESC, rank) AS k FROM (SELECT bracket, spec_id, talent_id, talents.rank AS rank, sum(weight) AS w FROM weighted JOIN talents USING (character_id, spec_id) WHERE talents.rank > 0 GROUP BY ALL)) WHERE k = 1",
    "full_usage": """SELECT u.*, CASE WHEN default_points > 0 OR usage_pct > 75 THEN 'bis' WHEN usage_pct > 50 THEN 'situational' ELSE 'common' END AS tier, EXISTS (SELECT 1 FROM builds b WHERE b.bracket = u.bracket AND b.spec_id = u.spec_id AND list_contains(b.build, u.talent_id)) AS in_top_build, coalesce(r.top_build_rank, 0) AS top_build_rank
        FROM usage u LEFT JOIN ranks r ON r.bracket = u.bracket AND r.spec_id = u.spec_id AND r.talent_id = u.talent_id""",
}
_NEEDS = {
    "entries": ["games"], "ranked": ["entries"], "items": ["lines"], "sockets": ["lines"], "talents": ["lines"], "assignments": ["talent_dim"], "edges": ["talent_dim"], "best_eq": ["entries"], "cohort": ["best_eq"], "best_talent": ["entries"], "weighted": ["best_talent"],
    "usage_base": ["weighted", "talents"], "usage": ["usage_base", "talent_dim", "assignments", "weighted"], "builds": ["weighted", "talents"], "ranks": ["weighted", "talents"], "full_usage": ["usage", "builds", "ranks"],
}


def sql(body: str, *ctes: str) -> str:
    """body with the common table expressions it names, and those that these need."""
    wanted: set[str] = set()

    def want(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for n in _NEEDS.get(name, []):
                want(n)

    for c in ctes:
        want(c)
    parts = [f"{c} AS MATERIALIZED ({text})" for c, text in CTES.items() if c in wanted]
    if not parts:
        return body
    # a body that brings expressions of its own goes on with the list
    return "WITH RECURSIVE " + ",\n".join(parts) + (", " + body.lstrip()[5:] if body.lstrip().upper().startswith("WITH ") else "\n" + body)
