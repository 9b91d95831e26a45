"""Queries of several steps: streams run to their end in several batches, and whole refreshes."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import ladder_store, name_index
from ..sources import ingest, schemas, tables
from ..sources.scratch import shared_dir, written
from ..streaming import streams
from . import build_all
from .build_all import LadderTables
from .payload_queries import TWO_SNAPSHOTS, ladder_payloads
from .queries import _STALE, TOP_N
from .registry import pct, query
from .testdata import Ladder

def _folder(t: Ladder, name: str) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(TWO_SNAPSHOTS, "ranked")
def ladder_stream(t: Ladder) -> DataFrame:
    """Payload files of all ladders, and then newer ones of all regions but one, with fewer entries; the second batch ends
    between its note and its overwrite, and is repeated."""
    spark, files, out = t.spark, _folder(t, "payloads"), _folder(t, "ladders")
    checkpoint = f"{out}/checkpoint"

    def arrive(rows: DataFrame, at: str) -> None:
        ladder_payloads(rows, at).repartition(4).write.mode("append").json(files)

    def crash(batch: int) -> None:
        raise RuntimeError("stopped before the overwrite")

    source = lambda: streams.ladder_stream(spark, files)
    arrive(t.ranked, "2024-01-01 00:00:00")
    streams.ladder_sink(source(), out, checkpoint).awaitTermination()
    arrive(t.ranked.where("region <> 'ASIA' and entry_id % 3 <> 0"), "2024-01-01 06:00:00")
    try:
        streams.ladder_sink(source(), out, checkpoint, crash).awaitTermination()
    except StreamingQueryException:
        streams.ladder_sink(source(), out, checkpoint).awaitTermination()
    return streams.stored_ladders(spark, out).select("bracket", "region", "character_id", "rank", "rating")


def arriving(t: Ladder, parts: list[DataFrame], name: str):
    """Writes a table's parts one after the other, and yields the folder after each."""
    folder = _folder(t, name)
    for rows in parts:
        rows.write.mode("append").parquet(folder)
        yield folder


@query("""WITH cut AS (SELECT to_timestamp(CAST(floor((epoch_us(min(ran_at)) + epoch_us(max(ran_at))) / 2) AS BIGINT) / 1e6) AT TIME ZONE 'UTC' AS c FROM metrics),
    a AS (SELECT m.*, date_trunc('hour', ran_at) AS hour, ran_at < c AND job_id % 7 <> 0 AS first FROM metrics m, cut), w AS (SELECT max(ran_at) FILTER (WHERE first) - INTERVAL 2 HOUR AS one, max(ran_at) - INTERVAL 2 HOUR AS two FROM a)
    SELECT hour, job_class, count(*) AS total, count(*) FILTER (WHERE NOT success) AS failed, floor(avg(duration) * 1000 + 0.5) / 1000 AS avg_duration FROM a, w WHERE (first OR hour + INTERVAL 1 HOUR > one) AND hour + INTERVAL 1 HOUR <= two GROUP BY 1, 2""", "metrics")  # fmt: skip
def job_window_stream(t: Ladder) -> DataFrame:
    """job_windows() of a stream in two batches. The second has late rows: those of hours that the first batch's watermark has
    closed are dropped. Hours that the last watermark hasn't closed aren't given yet."""
    m = t.metrics.select("job_id", "job_class", F.col("at").cast("timestamp").alias("at"), "duration", "success", "error_class")
    middle = F.floor((F.min(F.unix_micros("at")) + F.max(F.unix_micros("at"))) / 2).alias("_cut")
    m = m.crossJoin(F.broadcast(m.agg(middle))).withColumn("_first", (F.unix_micros("at") < F.col("_cut")) & (F.col("job_id") % 7 != 0)).drop("_cut")  # one row
    out = _folder(t, "hours")
    for folder in arriving(t, [m.where("_first").drop("_first"), m.where("not _first").drop("_first")], "metrics"):
        stream = t.spark.readStream.schema(schemas.METRICS).parquet(folder)
        streams.run_once(streams.job_windows(stream), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").withColumn("avg_duration", X.half_up(F.col("avg_duration"), 3))


@query("""WITH p AS (SELECT user_id AS cycle_id, row_number() OVER (PARTITION BY user_id ORDER BY job_id) AS done, count(*) OVER (PARTITION BY user_id) AS expected FROM metrics), s AS (SELECT cycle_id, max(CAST(done * 100 // expected AS INTEGER)) AS pct FROM p WHERE done * 5 <= expected * (cycle_id % 5 + 1) GROUP BY 1)
    SELECT cycle_id, CAST(step AS INTEGER) AS milestone FROM s, (VALUES (25), (50), (75)) x(step) WHERE pct >= step""", "metrics")  # fmt: skip
def milestone_stream(t: Ladder) -> DataFrame:
    """Milestones of a stream in three batches; cycles end at a fifth to all of their jobs."""
    by = W.partitionBy("user_id")
    p = t.metrics.select(F.col("user_id").cast("long").alias("cycle_id"), F.col("at").cast("timestamp").alias("at"), F.row_number().over(by.orderBy("job_id")).alias("done"), F.count("*").over(by).alias("expected"))
    p = p.where(F.col("done") * 5 <= F.col("expected") * (F.col("cycle_id") % 5 + 1))
    third = F.floor(F.col("done") * 3 / (F.col("expected") + 1))
    schema, out = "cycle_id long, at timestamp, done long, expected long", _folder(t, "milestones")
    p = p.select("cycle_id", "at", F.col("done").cast("long").alias("done"), "expected")
    with streams.rocksdb_state(t.spark):
        for folder in arriving(t, [p.where(third == k) for k in range(3)], "progress"):
            stream = t.spark.readStream.schema(schema).parquet(folder)
            streams.run_once(streams.milestone_stream(stream, late="10000 days"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.schema("cycle_id long, milestone int").parquet(f"{out}/rows")


# ---- stored tables -------------------------------------------------------------------------------------------------


@query("""WITH old AS (SELECT entry_id, rating, wins, losses FROM entries WHERE entry_id % 3 <> 0), new AS (SELECT entry_id, rating + 10 AS rating, wins + 1 AS wins FROM entries WHERE entry_id % 2 = 0)
    SELECT coalesce(o.entry_id, n.entry_id) AS entry_id, CASE WHEN n.entry_id IS NOT NULL THEN n.rating ELSE o.rating END AS rating, CASE WHEN o.entry_id IS NULL THEN n.wins ELSE o.wins END AS wins, o.losses FROM old o FULL JOIN new n ON o.entry_id = n.entry_id""", "entries")  # fmt: skip
def stored_upsert(t: Ladder) -> DataFrame:
    path, e = _folder(t, "entries"), t.entries
    tables.upsert_stored(path, e.where("entry_id % 3 <> 0").select("entry_id", "rating", "wins", "losses"), ["entry_id"], buckets=16)
    tables.upsert_stored(path, e.where("entry_id % 2 = 0").select("entry_id", (F.col("rating") + 10).alias("rating"), (F.col("wins") + 1).alias("wins")), ["entry_id"], ["rating"])
    return tables.stored(t.spark, path)


_PAGED = "SELECT '{0}' AS page, entry_id, region, spec_id, rank, total_rows, CAST(ceil(total_rows / {1}.0) AS BIGINT) AS total_pages FROM (SELECT *, row_number() OVER (ORDER BY rank, entry_id) AS k, count(*) OVER () AS total_rows FROM ranked WHERE {2}) WHERE {3}"


@query(" UNION ALL ".join([
    _PAGED.format("filtered", 25, "bracket = '1-URGENT' AND region IN ('ASIA', 'EUROPE') AND rating BETWEEN 20000 AND 400000 AND CAST(wins AS DOUBLE) / nullif(wins + losses, 0) >= 0.5 AND name ILIKE 'Customer#0000%'", "k BETWEEN 26 AND 50"),
    _PAGED.format("last", 50, "bracket = '2-HIGH' AND region IN ('AFRICA', 'AMERICA')", "k > (ceil(total_rows / 50.0) - 1) * 50"),
    _PAGED.format("spec", 40, "bracket = '3-MEDIUM' AND spec_id = 7", "k BETWEEN 41 AND 80"),
]), "ranked")
def stored_ladder_pages(t: Ladder) -> DataFrame:
    """Pages of stored ladders: one of several filters, the last of two regions, and the second of a spec."""
    path, regions = _folder(t, "stored-ladders"), ["AFRICA", "AMERICA"]
    ladder_store.store_ladders(t.ranked, path, width=100)
    last = ladder_store.stored_page(t.spark, path, "2-HIGH", 1, 50, region=regions).first()
    pages = {
        "filtered": ladder_store.stored_page(t.spark, path, "1-URGENT", 2, 25, region=["ASIA", "EUROPE"], rating_min=20000, rating_max=400000, min_winrate=0.5, name="customer#0000"),
        "last": ladder_store.stored_page(t.spark, path, "2-HIGH", last["total_pages"] if last else 1, 50, region=regions),
        "spec": ladder_store.stored_page(t.spark, path, "3-MEDIUM", 2, 40, spec_id=7),
    }
    out = None
    for name, rows in pages.items():
        rows = rows.select(F.lit(name).alias("page"), "entry_id", "region", "spec_id", "rank", "total_rows", "total_pages")
        out = rows if out is None else out.unionByName(rows)
    return out


_TEXTS = ("77", "R#0000000", "7", "omer#00000001", "_", "r#", "nobody")


@query(f"SELECT text, character_id, count(*) AS n FROM entries, (VALUES {', '.join(f'($${x}$$)' for x in _TEXTS)}) x(text) WHERE contains(lower(name), lower(text)) GROUP BY ALL", "entries")
def indexed_name_search(t: Ladder) -> DataFrame:
    """Entries whose name holds a text, for several texts, by the stored pieces of names."""
    path = _folder(t, "names")
    name_index.store_names(t.entries.select("entry_id", "character_id", "name"), path)
    out = None
    for text in _TEXTS:
        rows = name_index.search(t.spark, path, text).groupBy("character_id").agg(F.count("*").alias("n")).select(F.lit(text).alias("text"), "character_id", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT CASE o_orderkey % 7 WHEN 0 THEN 'no JSON object' WHEN 1 THEN 'wrong type' WHEN 2 THEN 'without season_id' WHEN 3 THEN 'no JSON object' ELSE 'good' END AS reason, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 7 > 4 THEN o_orderkey END) AS BIGINT) AS ids
    FROM orders WHERE o_orderkey % 7 <> 4 GROUP BY 1""")
def rejected_payloads(t: Ladder) -> DataFrame:
    """Orders as payloads, of which some are cut off, mistyped, without their id, no objects, or blank: what is read and what is rejected."""
    files, k = _folder(t, "season-files"), F.col("o_orderkey")
    whole = F.to_json(F.struct(k.alias("season_id"), F.col("o_orderpriority").alias("season_name"), F.lit(0).alias("more")))
    line = F.when(k % 7 == 0, F.substr(whole, F.lit(1), F.length(whole) - 1)).when(k % 7 == 1, F.concat(F.lit('{"season_id": "x'), k.cast("string"), F.lit('"}')))
    line = line.when(k % 7 == 2, F.lit('{"season_name": "s"}')).when(k % 7 == 3, F.lit("[1]")).when(k % 7 == 4, F.lit("  ")).otherwise(whole)
    t.table("orders").select(line.alias("value")).write.text(files)
    good, bad = ingest.read_payloads(t.spark, files, schemas.SEASON, ("season_id",))
    read = good.agg(F.lit("good").alias("reason"), F.count("*").alias("n"), F.sum("season_id").alias("ids"))
    return read.union(bad.groupBy("reason").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("ids")))


# ---- whole refreshes -----------------------------------------------------------------------------------------------

_ROWS = "SELECT '{0}' AS frame, bracket, spec_id, CAST(slot AS VARCHAR) AS slot, CAST(NULL AS VARCHAR) AS socket_type, CAST({1} AS VARCHAR) AS id, usage_count, {2} AS usage_pct FROM (SELECT *, CAST(sum(usage_count) OVER (PARTITION BY bracket, spec_id, slot) AS BIGINT) AS total FROM (SELECT bracket, c.spec_id, slot, {1}, count(*) AS usage_count FROM cohort c JOIN items i ON i.character_id = c.character_id AND i.spec_id = c.spec_id WHERE {1} IS NOT NULL GROUP BY ALL))"
_SHARE = pct("usage_count", "total")
_REFRESH = f"""WITH worn AS (SELECT bracket, c.spec_id, slot, socket_type, gem_id, c.character_id FROM cohort c JOIN sockets s ON s.character_id = c.character_id AND s.spec_id = c.spec_id),
    rv AS (SELECT u.* FROM (SELECT u.* REPLACE (max(default_points) OVER w AS default_points, bool_or(in_top_build) OVER w AS in_top_build, max(top_build_rank) OVER w AS top_build_rank), row_number() OVER (PARTITION BY bracket, spec_id, node_id, name ORDER BY usage_pct DESC, u.talent_id) AS k FROM full_usage u JOIN talent_dim d ON d.talent_id = u.talent_id WINDOW w AS (PARTITION BY bracket, spec_id, node_id, name)) u WHERE k = 1),
    {_STALE.removeprefix('WITH ').replace('full_usage', 'rv')}
    {_ROWS.format('items', 'item_id', _SHARE)} UNION ALL {_ROWS.format('enchants', 'enchantment_id', _SHARE)}
    UNION ALL SELECT 'gems', bracket, spec_id, CAST(slot AS VARCHAR), socket_type, CAST(gem_id AS VARCHAR), usage_count, {_SHARE} FROM (SELECT bracket, spec_id, slot, socket_type, gem_id, count(DISTINCT character_id) AS usage_count FROM worn WHERE gem_id IS NOT NULL GROUP BY ALL) JOIN (SELECT bracket, spec_id, slot, count(DISTINCT character_id) AS total FROM worn GROUP BY ALL) USING (bracket, spec_id, slot)
    UNION ALL SELECT 'talents', bracket, spec_id, NULL, NULL, CAST(talent_id AS VARCHAR), usage_count, usage_pct FROM stale u WHERE EXISTS (SELECT 1 FROM assignments a WHERE a.talent_id = u.talent_id AND a.spec_id = u.spec_id) OR EXISTS (SELECT 1 FROM talent_dim d WHERE d.talent_id = u.talent_id AND d.icon IS NOT NULL)"""
_PARTS = ("cohort", "items", "sockets", "full_usage", "talent_dim", "assignments")


def _tables(t: Ladder, **changed: DataFrame) -> LadderTables:
    own = {"entries": t.entries, "items": t.items, "sockets": t.sockets, "talents": t.talents, "dim": t.talent_dim, "assignments": t.assignments, "edges": t.edges}
    return LadderTables(**(own | changed))


def _published(t: Ladder, path: str) -> DataFrame:
    """The live frames of a refresh as one table."""
    out = None
    for name, item in (("items", "item_id"), ("enchants", "enchantment_id"), ("gems", "gem_id"), ("talents", "talent_id")):
        df = tables.published(t.spark, path, name)
        column = lambda c: (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c)  # noqa: B023, E731
        rows = df.select(F.lit(name).alias("frame"), "bracket", "spec_id", column("slot"), column("socket_type"), F.col(item).cast("string").alias("id"), "usage_count", F.col("usage_pct").cast("double").alias("usage_pct"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_REFRESH, *_PARTS)
def full_refresh(t: Ladder) -> DataFrame:
    """All frames of a refresh, as they are published."""
    path = _folder(t, "refresh")
    build_all.build_all(_tables(t), path, 1, TOP_N)
    return _published(t, path)


@query(_REFRESH, *_PARTS)
def changed_refresh(t: Ladder) -> DataFrame:
    """The same out of an older refresh, in which the cohort was another, a seventh of the characters had other items and sockets, and an eighth other talents."""
    path, id_ = _folder(t, "refresh"), F.col("character_id")
    now = _tables(t)
    then = _tables(
        t,
        entries=t.entries.where("entry_id % 4 <> 0"),
        items=t.items.withColumn("item_id", F.when(id_ % 7 == 0, F.lit("Brand#00")).otherwise(F.col("item_id"))),
        sockets=t.sockets.where((id_ % 7 != 0) | (F.col("slot") > 2)),
        talents=t.talents.where((id_ % 8 != 0) | (F.col("talent_id") % 2 == 0)),
    )
    old = build_all.snapshot(then, TOP_N)
    before = {name: written(df, name) for name, df in build_all.counted(old).items()}
    build_all.publish_counts(then, before, path, 1)
    changed = t.table("customer").where((F.col("c_custkey") % 7 == 0) | (F.col("c_custkey") % 8 == 0)).select(F.col("c_custkey").alias("character_id"), F.col("c_nationkey").alias("spec_id"))
    build_all.build_changed(now, before, old, changed, path, 2, TOP_N)
    return _published(t, path)
