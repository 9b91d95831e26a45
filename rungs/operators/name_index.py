"""A table of the three-letter pieces of names, which finds the names that hold a text without reading all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_parts, write_parts
from .ladder import name_contains

#: Stands twice after a name, so that its last letters begin a piece too.
_END = "\x00"
#: Pieces of a text that are looked up: those with the fewest names.
_LOOKED_UP = 3


def store_names(rows: DataFrame, path: str, column: str = "name", buckets: int = 64) -> None:
    """Writes rows in a folder for each bucket of their name, and for each different name, in lower case, a row a piece: the
    three letters from each of its places on. Pieces are stored in order, so that a look-up reads few row groups.

    Rows without a name are kept in the bucket of null, and never found.
    """
    spread = rows.withColumn("name_bucket", F.pmod(F.xxhash64(F.lower(column)), F.lit(buckets)).cast("int"))
    write_parts(spread.repartition("name_bucket").sortWithinPartitions("name_bucket", column), path, ["name_bucket"])
    names = rows.select(F.lower(column).alias("name")).where("name is not null and name <> ''").distinct()
    # a name that is one letter many times over has a piece once
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr(F.concat("name", F.lit(_END * 2)), i, F.lit(3))))
    posted = names.select(F.explode(pieces).alias("piece"), "name", F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int").alias("bucket"))
    posted.repartitionByRange("piece", "name").sortWithinPartitions("piece", "name").write.mode("overwrite").parquet(f"{path}/pieces")
    counts = posted.groupBy("piece").agg(F.count("*").alias("n"))
    counts.repartitionByRange("piece").sortWithinPartitions("piece").write.mode("overwrite").parquet(f"{path}/counts")


def names_with(spark: SparkSession, path: str, text: str) -> DataFrame:
    """name, bucket: the different stored names, in lower case, that hold the text in any case.

    Of the text's pieces the three with the fewest names are looked up, and a name that has them all is compared with the
    text itself. Texts of one or two letters are the beginning of a piece.
    """
    pieces = spark.read.parquet(f"{path}/pieces")
    low = spark.range(1).select(F.lower(F.lit(text))).first()[0]  # as Spark folds names
    if len(low) < 3:
        return pieces.where(F.col("piece").startswith(low)).select("name", "bucket").distinct()
    own = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    sizes = {r["piece"]: r["n"] for r in spark.read.parquet(f"{path}/counts").where(F.col("piece").isin(own)).collect()}  # a row a piece of the text
    if len(sizes) < len(own):  # a piece that no name has
        return pieces.where(F.lit(False)).select("name", "bucket")
    rare = sorted(own, key=lambda p: (sizes[p], p))[:_LOOKED_UP]
    met = pieces.where(F.col("piece").isin(rare)).groupBy("name", "bucket").agg(F.count("*").alias("_n")).where(F.col("_n") == len(rare))
    return met.where(F.contains("name", F.lit(low))).select("name", "bucket")


def search(spark: SparkSession, path: str, text: str, column: str = "name") -> DataFrame:
    """The stored rows whose name holds the text in any case, as name_contains() finds them; only the buckets that hold such
    a name are read. An empty text finds all rows with a name."""
    rows = read_parts(spark, path)
    if text:
        names = names_with(spark, path, text)
        touched = [r[0] for r in names.select("bucket").distinct().collect()]  # no more numbers than buckets
        rows = rows.where(F.col("name_bucket").isin(touched) if touched else F.lit(False))
        rows = rows.withColumn("_low", F.lower(column)).join(names.select(F.col("name").alias("_low")), "_low", "left_semi").drop("_low")
    return name_contains(rows, text, column).drop("name_bucket")
