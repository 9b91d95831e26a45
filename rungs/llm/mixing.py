"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions alone."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, written

#: Documents a bucket of the running sums holds, about.
BUCKET_ROWS = 4_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Sources in order of code points (null last) take the weights in turn and share `share` times all sizes. A target
    stops at `most` times its source's size; the excess goes to the others by weight until none is above. Filling up
    is one pass: sources in order of size / weight are capped until the level that is left fits under the next cap.
    The table has one row a source.
    """
    # one row a source from here on; the sort key of a source with no name comes last
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1).alias("w"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fill", F.col("cap") / F.col("w"))
    by = W.orderBy("fill", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumns({
        "capped": F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "open_w": F.sum("w").over(by.rowsBetween(W.currentRow, W.unboundedFollowing)),
        "budget": total * F.lit(float(share)),
    })
    s = s.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_w"))
    # the first source that isn't capped sets the level; with none, every source stops at its cap
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["level"]
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def running(df: DataFrame, group: list[str], bucket: str, order: list, size: str, out: str, place: str) -> DataFrame:
    """out: sum of size up to and with the row, in order of bucket and then order, within group; place: its number in the bucket.

    Buckets are summed first and only their sums are put in one order, so that no group has to fit in one task.
    """
    base = df.groupBy(*group, bucket).agg(F.sum(size).alias("_sum"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    base = base.select(*[F.col(c).alias(f"_{c}") for c in [*group, bucket]], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    by = W.partitionBy(*group, bucket).orderBy(*order)
    within = F.sum(size).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, bucket]]
    return df.withColumns({"_within": within, place: F.row_number().over(by)}).join(base, on, "left").withColumn(out, F.col("_within") + F.col("_before")).drop("_within", "_before", *[f"_{c}" for c in [*group, bucket]])


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, tag: str | None = None) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    docs has doc_id, text, source. Every source puts its documents, `most` times over, in an order shuffled by the md5
    of doc_id; a document's virtual finish time is its source's words so far over the source's target. All are put in
    order of finish time, in ranges, and taken until `share` times all words are used up.

    Returns doc_id, source, size, source_size, target, copies (times it is taken) and taken (words). Null texts and
    texts without words have size 0, no turn in the queue and 0 copies; null sources are one source, null ids
    come first in a tie, repeated rows are documents of their own, an empty table gives an empty result. Other
    columns of docs are not read.
    """
    more = [tag] if tag else []  # a column that is kept, and parts rows that are otherwise equal
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *more)
    d = written(d.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes")
    targets = source_targets(d, weights, share, most)
    whole = d.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    budget = int(share * whole["words"])
    # buckets follow the number of documents: hexadecimal digits of the key in front
    digits = max(1, len(f"{whole['n'] // BUCKET_ROWS:x}"))
    # null ids share a key: their rows go to buckets by size, between those of lesser and of greater keys
    null_key, front = md5(b"").hexdigest(), F.substring("key", 1, digits)
    after = F.when((front == null_key[:digits]) & (F.col("key") > null_key), "~").otherwise("")
    bucket = F.when(F.col("doc_id").isNull(), F.concat(front, F.lit("="), F.lpad(F.col("size").cast("string"), 19, "0"))).otherwise(F.concat(front, after))
    d = d.withColumn("bucket", bucket).withColumn("g", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    d = running(d, ["g"], "bucket", ["key", F.col("doc_id").asc_nulls_first(), "size", *more], "size", "cum", "place")
    d = d.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    # one row for each time that a document stands in the queue; those without words don't stand there
    q = d.withColumn("turn", F.explode_outer(F.when(F.col("size") > 0, F.array(*[F.lit(i) for i in range(most)]))))
    finish = F.try_divide(F.col("source_size") * F.col("turn") + F.col("cum"), F.col("target"))
    slices = max(1, whole["n"] * most // BUCKET_ROWS)
    # ranges of finish times: even ones up to 2, then as many for each doubling, as a source of a small weight ends late
    late = F.lit(2 * slices) + F.floor(F.log2(F.greatest(F.col("finish"), F.lit(2.0)) / 2) * slices)
    piece = F.when(F.col("finish") < 2, F.floor(F.col("finish") * slices)).otherwise(late)
    idle = -1 - F.pmod(F.xxhash64("key", "g", "place"), F.lit(slices))
    q = q.withColumn("finish", finish).withColumn("slice", F.when(F.col("turn").isNull(), idle).otherwise(piece).cast("long"))
    q = running(q.withColumn("queue", F.lit(0)), ["queue"], "slice", ["finish", "key", F.col("doc_id").asc_nulls_first(), "g", "place", "turn"], "size", "used", "at")
    # the turns of a row meet again by its place in the queue of its source
    row = ["doc_id", "source", "size", "source_size", "target", *more]
    rows = q.groupBy("g", "bucket", "place", *row).agg(F.sum((F.col("turn").isNotNull() & (F.col("used") <= budget)).cast("long")).alias("copies"))
    return rows.select(*row, "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs, each row as often as mix() takes it, and none that it does not take; all columns of docs are kept.

    Rows find their own by a hash of all columns but those that hold maps; of rows alike in these, any takes the place
    of any. Documents without words are not taken.
    """
    tag, n, copies = (fresh(c, docs.columns) for c in ("tag", "n", "copies"))
    alike = W.partitionBy(tag)
    tagged = docs.withColumn(tag, F.xxhash64(*[f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]))
    taken = mix(tagged.select("doc_id", "text", "source", F.col(tag).alias("tag")), weights, share, most, tag="tag").where("copies > 0")
    taken = taken.select(F.col("tag").alias(tag), F.col("copies").cast("int").alias(copies)).withColumn(n, F.row_number().over(alike.orderBy(F.desc(copies))))
    tagged = tagged.withColumn(n, F.row_number().over(alike.orderBy("doc_id")))
    return tagged.join(taken, [tag, n]).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
