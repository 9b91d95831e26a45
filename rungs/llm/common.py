"""What the operators of this subpackage share: written tables, names and words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

#: Words are runs of anything but the six ASCII white-space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
#: Setting by which Spark drops the shuffle files of a query that is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that written() has made inside the innermost scope().
_made: ContextVar[list[tuple[str, DataFrame]] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: the lineage ends there, and a lost executor costs nothing."""
    spark, schema, path = df.sparkSession, df.schema, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # planned anew, under that setting
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    if (made := _made.get()) is not None:
        made.append((path, out))
    return out


@contextmanager
def scope() -> Iterator[list[tuple[str, DataFrame]]]:
    """The tables that written() makes inside, for emptied()."""
    token = _made.set([])
    try:
        yield _made.get()
    finally:
        _made.reset(token)


def emptied(made: list[tuple[str, DataFrame]], *keep: DataFrame) -> None:
    """Overwrites tables that nothing reads any more with no rows: all of made but those in keep."""
    for path, df in made:
        if not any(df is k for k in keep):
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
    made[:] = [m for m in made if any(m[1] is k for k in keep)]
    if (outer := _made.get()) is not None and outer is not made:
        outer.extend(made)


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores in front until no column of taken has it (columns are compared without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """did, th, doc_id, text: did is doc_id with null as the least long, th a hash of the text (null as empty).

    Rows that agree in did and th are copies of one row; whatever is found for one holds for all.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(t).alias("th"), F.col(doc_id).alias("doc_id"), t.alias("text"))
