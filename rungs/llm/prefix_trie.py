"""Prefix trie of conversations: nodes with their members and what the subtrees below them hold, by a rollup in depth bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

#: Depths of a band.
BAND = 16
#: Places of a conversation that are summed in one group, and range of conversation ids whose text is made in one.
_BLOCK, _RUN = 16 * 256, 4096
#: Words of the hash of a prefix: each is a running sum, of 32-bit numbers, so that it takes 2^31 turns.
_WORDS = ("s1", "s2", "s3", "s4")


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), d1, d2 (a 128-bit hash of role and text), bytes (of the text): turns in the order of turn (null first), role and text.

    Rows are dealt by range, so that a conversation of any length is split over tasks; a task numbers its own, and
    a conversation's rows in earlier tasks are added. Each task ends at most one conversation that the next one has
    too, so that the table of what to add has two rows a task at most, and is broadcast.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"))
    # equal rows can stand in any order: a number of their own lets ranges cut through them
    rows = rows.withColumn("own", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("own")]
    dealt = rows.repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    kept = dealt.select("conv_id", F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(1), "text", "role").alias("d2"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at"))
    kept = written(kept.withColumn("part", F.shiftright("at", 33)), "turns")
    counts = kept.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    parts = counts.groupBy("conv_id").agg(F.count("*").alias("k"), F.min("part").alias("first")).where("k > 1").select("conv_id")
    cut = counts.join(F.broadcast(parts), "conv_id")
    cut = cut.withColumn("before", F.sum("n").over(W.partitionBy("conv_id").orderBy("part")) - F.col("n")).select("conv_id", "part", "before")
    pos = F.row_number().over(W.partitionBy("conv_id", "part").orderBy("at"))
    out = kept.withColumn("rn", pos).join(F.broadcast(cut), ["conv_id", "part"], "left")
    return out.select("conv_id", (F.col("rn") + F.coalesce("before", F.lit(0))).alias("pos"), "d1", "d2", "bytes")


def rebuilt(turns: DataFrame, siblings: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n), and (conv_id, pos, d1, d2, bytes): every conversation c with its first h turns taken from conversation c - c % siblings.

    h is the CRC-32 of c's decimal digits, modulo `most`. All turns of the other one are taken if it has fewer, none
    if there is none; c's own follow from its h-th on. % rounds towards zero, as in SQL.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    sizes = sizes.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")).withColumn("base", F.col("conv_id") - F.col("conv_id") % siblings)
    theirs = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_n"))
    sizes = sizes.join(theirs, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    sizes = written(sizes.withColumn("n", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "convs")
    kept = turns.join(sizes.select("conv_id", "h", "lent"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "d1", "d2", "bytes")
    front = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    lent = front.join(sizes.where("lent > 0").select("base", "conv_id", "lent"), "base").where("pos <= lent").select("conv_id", "pos", "d1", "d2", "bytes")
    return sizes.select("conv_id", "n"), kept.unionByName(lent)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, bytes: a row for each place of each conversation, with a 128-bit hash of all turns up to there.

    The hash is a sum over the turns of hashes of place and turn, so that blocks of a long conversation are summed apart.
    """
    a, b = F.xxhash64("pos", "d1", "d2"), F.xxhash64("d2", "pos", "d1")
    words = [a.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(a, 32), b.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(b, 32)]
    rows = turns.select("conv_id", "pos", "bytes", F.floor(F.col("pos") / _BLOCK).alias("block"), *[w.alias(s) for s, w in zip(_WORDS, words, strict=True)])
    inside = W.partitionBy("conv_id", "block").orderBy("pos")
    sums = rows.select("conv_id", "pos", "bytes", "block", *[F.sum(s).over(inside).alias(s) for s in _WORDS])
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(s).alias(s) for s in _WORDS])
    # a conversation of one block adds nothing; the others have a row for each of thousands of turns here
    blocks = blocks.withColumn("last", F.max("block").over(W.partitionBy("conv_id"))).where("last > 0").select("conv_id", "block", *[F.sum(s).over(earlier).alias(f"before_{s}") for s in _WORDS])
    rows = sums.join(blocks, ["conv_id", "block"], "left")
    key = F.unhex(F.md5(F.concat_ws(",", "pos", *[F.col(s) + F.coalesce(f"before_{s}", F.lit(0)) for s in _WORDS])))
    return rows.select("conv_id", F.col("pos").alias("depth"), key.alias("key"), "bytes")


def _sum(name: str) -> Column:
    return F.sum(name).alias(name)


def rollup(paths: DataFrame, values: DataFrame, names: list[str], band: int = BAND) -> DataFrame:
    """key and, for each of names, the sum of values (key, names) over the nodes of its subtree.

    paths (conv, depth, key) names the nodes on the way to every node, from the root at depth 0. A node adds to its
    ancestors down from the last depth that `band` divides, and there are at most `band` of these. Nodes at such depths
    then have totals of their band; summed up by the same function, as a trie of their own with a depth of 1 / band,
    these become whole, and each adds its whole total to the nodes of the band above it. A depth of D takes
    log(D) / log(band) rounds, and no node makes more than 2 * band rows in one.
    """
    own = paths.withColumn("band", F.floor(F.col("depth") / band))
    # a node that begins a band is also the last of the band above
    ends = own.where((F.col("depth") > 0) & (F.col("depth") % band == 0)).withColumn("band", F.col("band") - 1)
    up = F.collect_list("key").over(W.partitionBy("conv", "band").orderBy("depth"))
    lists = own.unionByName(ends).withColumn("up", up)
    tail = (F.col("depth") % band == 0) & (F.col("band") * band != F.col("depth"))
    # all conversations with this prefix have the same list
    lists = lists.groupBy("key").agg(F.min("depth").alias("depth"), F.first(F.when(~tail, F.col("up")), ignorenulls=True).alias("up"), F.first(F.when(tail, F.slice("up", 1, band)), ignorenulls=True).alias("above"))
    lists = written(lists.join(values, "key"), "bands")

    def added(rows: DataFrame, to: str) -> DataFrame:
        return rows.select(F.explode(to).alias("key"), *names).groupBy("key").agg(*map(_sum, names))

    inside = added(lists, "up")
    if lists.where(F.col("above").isNotNull()).isEmpty():
        return inside
    inside = written(inside, "inside")
    roots = paths.where(F.col("depth") % band == 0).withColumn("depth", (F.col("depth") / band).cast("long"))
    totals = written(rollup(roots, inside.join(lists.where(F.col("depth") % band == 0).select("key"), "key"), names, band), "totals")
    below = added(lists.where(F.col("above").isNotNull()).select("key", "above").join(totals, "key"), "above")
    return inside.unionByName(below).groupBy("key").agg(*map(_sum, names))


def ends_digest(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the conv_ids of each key, ascending, joined by commas.

    Ids are joined in runs of a bounded range first; the runs of one key then pass one task in order, which keeps
    only the state of the hash.
    """
    runs = ends.groupBy("key", F.floor(F.col("conv_id") / _RUN).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    runs = runs.repartition("key").sortWithinPartitions("key", "run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        out[0].append(key), out[1].append(state.hexdigest())
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.record_batch([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return runs.select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def trie(sizes: DataFrame, turns: DataFrame, band: int = BAND) -> DataFrame:
    """A row for each node of the trie of conversations (conv_id, n) and their turns (conv_id, pos, d1, d2, bytes).

    conv_id: the smallest member; depth; parent_conv_id; n_convs: members; n_children; n_leaves: childless nodes of the subtree;
    saved_tokens: over the subtree, (n_convs - 1) times the bytes of the node's last text; ends_sha256: of the members
    that end here. An empty table has no root. Two prefixes are one node if their 128-bit hashes agree.
    """
    root = F.lit(bytearray(16))
    sizes = sizes.select("conv_id", "n")
    start = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(0).cast("long").alias("bytes"))
    places = written(prefixes(turns).unionByName(start), "places")
    before = F.lag("key").over(W.partitionBy("conv_id", F.floor(F.col("depth") / _BLOCK)).orderBy("depth"))
    # the first place of a block has its parent in the block before
    ends = places.where(F.col("depth") % _BLOCK == _BLOCK - 1).select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"))
    linked = places.withColumn("near", before)
    crossing = (F.col("depth") % _BLOCK == 0) & (F.col("depth") > 0)
    first = linked.where(crossing).join(ends, ["conv_id", "depth"], "left").withColumn("near", F.col("parent")).drop("parent")
    linked = linked.where(~crossing).unionByName(first)
    nodes = written(linked.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("near").alias("parent")), "nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    values = nodes.join(children, "key", "left").select("key", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    values = written(values, "values")
    # every node lies on the way of its smallest member; conversations that are smallest nowhere have no way of their own
    ways = places.join(nodes.select("conv_id").distinct(), "conv_id", "left_semi").select(F.col("conv_id").alias("conv"), "depth", "key")
    totals = rollup(ways, values.select("key", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"], band)
    ends = places.join(sizes, "conv_id").where("depth = n").select("key", "conv_id")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(values.select("key", "n_children"), "key").join(totals, "key").join(ends_digest(ends), "key", "left").join(parents, "parent", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, siblings: int = 5, most: int = 9, band: int = BAND) -> DataFrame:
    """trie() of the rebuilt() conversations of turns (conv_id, turn, role, text).

    Null roles and texts are empty; a null turn comes first; turns of one number follow in the order of role and text,
    and repeated rows are turns of their own. Rows without a conv_id belong to no conversation. Texts of any length
    enter as a hash and a number of bytes; other columns are not read. An empty table gives no rows.
    """
    return trie(*rebuilt(written(numbered(turns), "numbered"), siblings, most), band)
