"""Tables on plain Parquet: upserts and slices as new frames, and versions that are published by moving one pointer."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import written


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], update_only: list[str] | None = None) -> DataFrame:
    """target with updates by keys: rows it has get the columns of update_only (all of the updates' by default), others
    are added whole. Columns that the updates lack keep what they had, or are null in added rows. Keys are unique in updates."""
    new = [c for c in updates.columns if c not in keys]
    written = [c for c in new if update_only is None or c in update_only]
    u = updates.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[F.col(c).alias(f"_new_{c}") for c in new], F.lit(True).alias("_there"))
    both = target.withColumn("_had", F.lit(True)).join(u, _same(keys), "full")
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.when(F.col("_had").isNull(), F.col(f"_key_{c}")).otherwise(F.col(c)).alias(c))
        elif c not in new:
            cols.append(F.col(c))
        elif c in written:
            cols.append(F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.when(F.col("_had").isNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*cols)


#: Beginning of the name of the column by which a stored table is partitioned; the number of buckets follows.
_BUCKET = "key_bucket_of_"


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What upsert_stored() keeps at path; None where there is nothing yet."""
    df = _read_or_none(spark, path)
    return None if df is None else df.drop(*[c for c in df.columns if c.startswith(_BUCKET)])


def upsert_stored(path: str, updates: DataFrame, keys: list[str], update_only: list[str] | None = None, buckets: int = 256) -> None:
    """upsert() into the table at path, which is partitioned by a bucket of its keys: only the buckets that updates have
    keys in are read and written again, the files of the others stay.

    The first updates make the table, with its columns and number of buckets. Touched buckets are written aside first.
    After a crash some buckets have the updates and some don't: the same call again gives the whole.
    """
    old = _read_or_none(updates.sparkSession, path)
    column = f"{_BUCKET}{buckets}" if old is None else next(c for c in old.columns if c.startswith(_BUCKET))
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(int(column.removeprefix(_BUCKET)))).cast("int")
    merged = updates.withColumn(column, bucket)
    if old is not None:
        touched = [r[0] for r in merged.select(column).distinct().collect()]  # no more numbers than buckets
        merged = upsert(old.where(F.col(column).isin(touched)).drop(column), updates, keys, update_only).withColumn(column, bucket)
        merged = written(merged, "upsert")
    merged.repartition(column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def _same(keys: list[str]) -> list[Column]:
    """Keys and their _key_ copies are alike; null is a key like any other."""
    return [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]


def _keys_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*[F.col(k).alias(f"_key_{k}") for k in keys]).distinct()


def write_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes df in a folder for each value of `by`, and its schema beside the rows, so that tables without rows can be read."""
    df.write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).partitionBy(*by).parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").json(f"{path}/schema")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """What write_parts() wrote, with the types it had."""
    schema = StructType.fromJson(json.loads(spark.read.schema("schema string").json(f"{path}/schema").first()[0]))
    return spark.read.schema(schema).parquet(f"{path}/rows")


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target and the rows whose keys it lacks, one a key; null is a key like any other."""
    return target.unionByName(rows.dropDuplicates(keys).join(_keys_of(target, keys), _same(keys), "left_anti"), allowMissingColumns=True)


def replace_slice(target: DataFrame, slices: DataFrame, rows: DataFrame) -> DataFrame:
    """target without the slices (key values, one row a slice; null is a key like any other) and with rows in their place."""
    return target.join(_keys_of(slices, slices.columns), _same(slices.columns), "left_anti").unionByName(rows)


def update_from(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """target with the columns of updates where they differ, nulls counting as values; `changed` tells which rows did."""
    cols = [c for c in updates.columns if c != key]
    u = updates.select(F.col(key).alias(f"_key_{key}"), *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_there"))
    rows = target.join(u, _same([key]), "left")
    there = F.coalesce("_there", F.lit(False))
    differs = [there & ~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in cols]
    changed = differs[0]
    for d in differs[1:]:
        changed = changed | d
    out = [F.when(there, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in target.columns]
    return rows.select(*out, changed.alias("changed"))


def replace_groups(target: DataFrame, rows: DataFrame, groups: list[str], keys: list[str]) -> DataFrame:
    """Upsert by keys, and then only the rows' keys stay in the groups that rows have; an empty `rows` changes nothing.
    Null is a group and a key like any other."""
    rest = target.join(_keys_of(rows, groups), _same(groups), "left_anti")
    return rest.unionByName(rows.dropDuplicates([*groups, *keys]))


def _version(path: str, name: str, cycle: int) -> str:
    return f"{path}/{name}/cycle_id={cycle}"


_LOG = "seq long, cycle_id long, state string"


def _log(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """What has become of the cycles, oldest first: rows (seq, cycle_id, state), one for each publishing and purge."""
    try:
        return sorted(tuple(r) for r in spark.read.schema(_LOG).json(f"{path}/live").collect())
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # before the first
            return []
        raise


def _note(spark: SparkSession, path: str, cycle: int, state: str) -> None:
    """Adds one file to the log; nothing that is there changes, so that a crash leaves the live cycle as it was. The file's
    name is the place in the log, and is made only if no one else has: of two publishers one comes after the other."""
    seq = max([r[0] for r in _log(spark, path)], default=0) + 1
    while not _made(spark, f"{path}/live/{seq:012d}.json", f'{{"seq": {seq}, "cycle_id": {cycle}, "state": "{state}"}}\n'):
        seq += 1


def _made(spark: SparkSession, file: str, text: str) -> bool:
    """Makes a small file of text; False, and nothing is done, if it is there already."""
    place = spark._jvm.org.apache.hadoop.fs.Path(file)
    try:
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    except Py4JJavaError as e:
        if "already exists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def live_cycle(spark: SparkSession, path: str) -> int | None:
    """The published cycle; None before the first."""
    return next((c for _, c, state in reversed(_log(spark, path)) if state == "live"), None)


def publish(frames: dict[str, DataFrame], path: str, cycle: int, keep_old: bool = False) -> int | None:
    """Writes all frames as versions of the cycle; only when all are written does the pointer move and the version
    before go. If one fails, what was written of the draft goes, the pointer stays, and the error is raised.
    Returns the cycle that was live before."""
    spark = next(iter(frames.values())).sparkSession
    before = live_cycle(spark, path)
    if cycle == before:
        raise ValueError(f"cycle {cycle} is live: its version can't be written again")
    done: list[str] = []
    try:
        for name, df in frames.items():
            done.append(name)
            df.write.mode("overwrite").parquet(_version(path, name, cycle))
    except Exception:
        purge(spark, path, done, cycle)
        raise
    _note(spark, path, cycle, "live")
    if before is not None and not keep_old:
        purge(spark, path, list(frames), before)
    return before


def rollback(spark: SparkSession, path: str, cycle: int) -> None:
    """Makes an older version the live one; it must have been published, and not purged since."""
    state = next((s for _, c, s in reversed(_log(spark, path)) if c == cycle), None)
    if state != "live":
        raise ValueError(f"cycle {cycle} was " + ("purged" if state else "never published"))
    _note(spark, path, cycle, "live")


def purge(spark: SparkSession, path: str, names: list[str], cycle: int) -> None:
    """Empties the versions of a cycle that isn't live; it can't be rolled back to any more."""
    if cycle == live_cycle(spark, path):
        raise ValueError(f"cycle {cycle} is live")
    _note(spark, path, cycle, "purged")
    for name in names:
        version = _version(path, name, cycle)
        if (rows := _read_or_none(spark, version)) is not None:
            spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(version)


def published(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The live version of a frame, with its cycle_id."""
    cycle = live_cycle(spark, path)
    return None if cycle is None else spark.read.parquet(_version(path, name, cycle)).withColumn("cycle_id", F.lit(cycle).cast("long"))


def write_report(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)
