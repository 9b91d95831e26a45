"""Structured Streaming forms: ladder files, job telemetry, milestones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.dims import dropped_entries
from ..sources import ingest, schemas
from ..sources.tables import upsert

_KEYS = ["season_id", "bracket", "region", "character_id"]


def ladder_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Ladder payloads as they arrive in a folder."""
    return spark.readStream.schema(schemas.LADDER).option("maxFilesPerTrigger", files_per_batch).json(path)


def merge_ladders(target: DataFrame | None, payloads: DataFrame) -> DataFrame:
    """The entries after a batch of payloads: best placements are upserted, and entries that the newest payload of their ladder lacks go."""
    by = ["season_id", "bracket", "region"]
    newest = payloads.groupBy(*by).agg(F.max("fetched_at").alias("fetched_at"))
    rows = ingest.leaderboard(payloads.join(newest, [*by, "fetched_at"], "left_semi"))
    if target is None:
        return rows
    ladder = F.concat_ws("|", F.col("season_id").cast("string"), "bracket", "region")
    merged = upsert(target, rows, _KEYS)
    gone = dropped_entries(merged.withColumn("leaderboard", ladder), rows.withColumn("leaderboard", ladder)).select(*_KEYS)
    return merged.join(gone, _KEYS, "left_anti")


_LADDER = ["season_id", "bracket", "region"]


def stored_ladders(spark: SparkSession, path: str) -> DataFrame | None:
    """What ladder_sink() keeps at path; None where there is nothing yet."""
    rows = _read(lambda: spark.read.parquet(f"{path}/entries"))
    return rows and rows.withColumns({"season_id": F.col("season_id").cast("long"), "bracket": F.col("bracket").cast("string"), "region": F.col("region").cast("string")})


def _read(table: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return table()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def ladder_sink(stream: DataFrame, path: str, checkpoint: str, before_overwrite: Callable[[int], None] | None = None) -> StreamingQuery:
    """Keeps the entries at path, partitioned by ladder: a batch rewrites the ladders that it has payloads of, and no others.

    What becomes of them is written aside first and noted, and from there over their partitions: a batch that is
    repeated after a crash is taken from there, and gives the same. before_overwrite is called with the batch's number
    between the two; an error in it ends the query there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, aside = batch.sparkSession, f"{path}/batch"
        noted = _read(lambda: spark.read.schema("batch long").json(f"{path}/noted"))
        if noted is None or noted.where(F.col("batch") == batch_id).isEmpty():
            stored = stored_ladders(spark, path)
            if stored is not None:
                stored = stored.join(batch.select(*_LADDER).distinct(), _LADDER, "left_semi")
            merge_ladders(stored, batch).write.mode("overwrite").parquet(aside)
            spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("overwrite").json(f"{path}/noted")
        if before_overwrite:
            before_overwrite(batch_id)
        out = spark.read.parquet(aside).repartition(*_LADDER)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_LADDER).parquet(f"{path}/entries")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_windows(metrics: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Jobs, failures and mean duration of each class and hour of event time; rows later than `late` are left out."""
    m = metrics.withWatermark("at", late) if metrics.isStreaming else metrics
    out = m.groupBy(F.window("at", width), "job_class").agg(F.count("*").alias("total"), F.count_if(~F.col("success")).alias("failed"), F.avg("duration").alias("avg_duration"))
    return out.select(F.col("window.start").alias("hour"), "job_class", "total", "failed", "avg_duration")


class Milestones(StatefulProcessor):
    """The highest share of each cycle so far, as typed state, and a timer that ends a finished cycle's state."""

    def __init__(self, steps: tuple[int, ...], keep_ms: int):
        self.steps, self.keep_ms = steps, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.share = handle.getValueState("share", StructType([StructField("pct", IntegerType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        before = self.share.get()[0] if self.share.exists() else 0
        now, last = before, 0
        for r in rows:
            if r["expected"] and r["expected"] > 0 and r["done"] is not None:
                now = max(now, int(r["done"] * 100 // r["expected"]))
            if r["at"] is not None:
                last = max(last, int(r["at"].timestamp() * 1000))
        self.share.update((now,))
        if before < 100 <= now:
            self.handle.registerTimer(last + self.keep_ms)
        return iter([Row(cycle_id=key[0], milestone=s) for s in self.steps if before < s <= now])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.share.clear()
        return iter([])

    def close(self) -> None:
        pass


_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which typed state needs."""
    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER[0], before) if before else spark.conf.unset(_PROVIDER[0])


def milestone_stream(progress: DataFrame, steps: tuple[int, ...] = (25, 50, 75), late: str = "1 hour", keep_hours: int = 24) -> DataFrame:
    """cycle_id, milestone: each milestone of a cycle once, when its share of done is first seen to reach it. progress:
    cycle_id, at, done, expected. Start it inside rocksdb_state().

    The state is a number a cycle, and goes keep_hours of event time after the cycle is done; rows that come
    later than `late` are left out, so that a cycle whose state has gone doesn't begin again.
    """
    out = StructType([StructField("cycle_id", LongType()), StructField("milestone", IntegerType())])
    rows = progress.withWatermark("at", late).select("cycle_id", "at", "done", "expected")
    return rows.groupBy("cycle_id").transformWithState(Milestones(steps, keep_hours * 3_600_000), out, "append", "eventTime")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes what has arrived to Parquet at path, and stops."""
    out = each(stream) if each else stream
    return out.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
