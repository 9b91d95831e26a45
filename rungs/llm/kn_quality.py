"""Text quality by the perplexity of an interpolated modified Kneser-Ney model, trained on trusted text.

Texts are read as bytes, all 256 of them, and the model grows with the trusted text. Its counts are Spark's, sharded by
gram, and so are the joins that turn them into discounts, back-off weights and probabilities, an order at a time. Tasks
read the documents whole and where they are, with the most frequent gram of each of SLOTS slots at hand; a document's
other grams are joined with the sharded model, whether it has seen them or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Classes are those of the small model that log_table() lays out whole; quality() reads bytes as they are.
ORDER, CLASSES = 4, 64
#: Slots of grams that the tasks have at hand (12 bytes each), as a power of two.
SLOTS = 21
#: Parts of a natural logarithm in whole numbers, so that sums don't depend on their order.
FINE = 1 << 30
#: Of the trusted documents that the model is not trained on, the share in each language that stays; and how far a
#: perplexity may lie above theirs, so that clean documents stay where few are trusted.
QUANTILE, SLACK = 0.995, 1.2
#: Steps of the logarithm of a perplexity in which quantiles are found.
STEP = 0.001


def _classes() -> np.ndarray:
    """Class of each byte: letters are their own, white space, digits and marks are a few, other alphabets six."""
    out = np.full(256, 57, np.uint8)
    out[97:123], out[65:91], out[48:58] = np.arange(26), np.arange(26, 52), 54
    out[[9, 11, 12, 13, 32]], out[10], out[46], out[44] = 52, 53, 55, 56
    high = np.arange(128, 256)
    out[128:] = np.where(high >= 192, 58 + (high & 1), 60 + (high & 3))
    return out


_CLASS = _classes()


def grams(text: bytes, bits: int = 6) -> np.ndarray:
    """The gram of each byte with the three before it, in units of 6 bits (classes) or 8 (bytes as they are); three line feeds stand before a text."""
    s = np.frombuffer(b"\n" * (ORDER - 1) + text, np.uint8)
    s = (_CLASS[s] if bits == 6 else s).astype(np.uint32)
    return (s[:-3] << 3 * bits) | (s[1:-2] << 2 * bits) | (s[2:-1] << bits) | s[3:]


def gram_counts(texts: DataFrame, bits: int = 6) -> DataFrame:
    """gram, c over all texts (a column text)."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        gram, c = np.unique(np.concatenate(parts), return_counts=True)
        return pa.record_batch([pa.array(gram.astype(np.int64)), pa.array(c.astype(np.int64))], names=["gram", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            for t in b["text"].cast(pa.binary()).to_pylist():
                if t:
                    parts.append(grams(t, bits))
                    size += len(t)
                if size >= 4 << 20:
                    yield counted(parts)
                    parts, size = [], 0
        if parts:
            yield counted(parts)

    return texts.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """Discounts of grams counted once, twice and more often, by the counts of counts (halves where one is missing)."""
    n = counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]


def probabilities(counts: DataFrame, bits: int = 6) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, p, c) of the grams seen, p interpolated over all lower orders, and (context, rest),
    the share of a context that goes to the lower order."""
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):  # lower orders count the different bytes before a gram
        shorter = tables[0].select(F.col("gram").bitwiseAND((1 << bits * order) - 1).alias("gram")).groupBy("gram").agg(F.count("*").alias("c"))
        tables.insert(0, written(shorter, f"grams{order}"))
    out: list[tuple[DataFrame, DataFrame]] = []
    lower = None
    for order, table in enumerate(tables, 1):
        d = discounts(table)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        t = table.withColumn("context", F.shiftright("gram", bits)).withColumn("cut", F.least(cut, F.col("c").cast("double")))
        rest = written(t.groupBy("context").agg(F.sum("c").alias("all"), (F.sum("cut") / F.sum("c")).alias("rest")), f"contexts{order}")
        t = t.join(rest, "context").withColumn("own", (F.col("c") - F.col("cut")) / F.col("all"))
        if lower is None:
            t = t.withColumn("below", F.lit(1.0 / (1 << bits)))
        else:
            t = t.withColumn("suffix", F.col("gram").bitwiseAND((1 << bits * (order - 1)) - 1)).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        lower = written(t.select("gram", (F.col("own") + F.col("rest") * F.col("below")).alias("p"), "c"), f"chances{order}")
        out.append((lower, rest.select("context", "rest")))
    return out


def log_table(tables: list[tuple[DataFrame, DataFrame]]) -> np.ndarray:
    """Natural logarithm of the probability of each of the 64**4 grams of a model of classes, seen or not."""
    p = np.full(1, 1.0 / CLASSES, np.float32)
    for order, (seen, contexts) in enumerate(tables, 1):
        rest = np.ones(CLASSES ** (order - 1), np.float32)
        c = contexts.toPandas()
        rest[c["context"].to_numpy()] = c["rest"].to_numpy()
        # of a gram that was not seen, the context's rest goes by the gram without its first byte
        below = np.tile(p, CLASSES) if order > 1 else np.repeat(p, CLASSES)
        p = np.repeat(rest, CLASSES)
        p *= below
        s = seen.toPandas()
        p[s["gram"].to_numpy()] = s["p"].to_numpy()
    np.maximum(p, np.float32(1e-12), out=p)  # with little text, a discount of 0 leaves nothing to unseen grams
    return np.log(p, out=p)


def chances(wanted: DataFrame, tables: list[tuple[DataFrame, DataFrame]], bits: int = 8) -> DataFrame:
    """gram, p of the distinct grams wanted, seen or not: of one that was not seen, its context's rest goes by the gram without its first unit."""
    t = wanted.select("gram", F.col("gram").alias("suffix"), F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("p"))
    for order in range(len(tables), 0, -1):
        seen, contexts = tables[order - 1]
        t = t.join(seen.select(F.col("gram").alias("suffix"), F.col("p").alias("own")), "suffix", "left")
        t = t.withColumns({"p": F.coalesce("p", F.col("weight") * F.col("own")), "context": F.shiftright("suffix", bits)}).drop("own")
        t = t.join(contexts, "context", "left").withColumns({"weight": F.col("weight") * F.coalesce("rest", F.lit(1.0)), "suffix": F.col("suffix").bitwiseAND((1 << bits * (order - 1)) - 1)})
        t = written(t.select("gram", "suffix", "weight", "p"), f"wanted{order}")
    return t.select("gram", F.coalesce("p", F.col("weight") / (1 << bits)).alias("p"))


def _slot(gram, slots: int):
    """The slot of 2**slots of a gram, of a Column or an array of 64-bit integers alike."""
    mixed = gram * 0x1E3779B1
    return F.shiftright(mixed.bitwiseAND(0xFFFFFFFF), 32 - slots) if isinstance(gram, Column) else (mixed & 0xFFFFFFFF) >> (32 - slots)


def at_hand(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent gram of each slot and its logarithm; an empty slot has a gram of another."""
    best = seen.groupBy(_slot(F.col("gram"), SLOTS).alias("slot")).agg(F.max(F.struct("c", "gram", "p")).alias("g")).select("slot", "g.gram", _log(F.col("g.p")).alias("log")).toArrow()
    keys, logs = np.zeros(1 << SLOTS, np.uint32), np.zeros(1 << SLOTS, np.int64)
    keys[0] = 0xFFFFFFFF  # slot 0 is that of gram 0
    at = best["slot"].to_numpy()
    keys[at], logs[at] = best["gram"].to_numpy(), best["log"].to_numpy()
    return keys, logs


def _log(p: Column) -> Column:
    """The natural logarithm in FINE parts; with little text, a discount of 0 leaves nothing to unseen grams."""
    return F.round(F.log(F.greatest(p, F.lit(1e-12))) * FINE).cast("long")


def perplexities(docs: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """doc_id, lang, n (bytes), perplexity of each whole text; null where there is none. tables: probabilities() of bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(at_hand(tables[-1][0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = shared.value
        slots = len(keys).bit_length() - 1
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part, sizes, sums, others, counts = b.slice(i, 500), [], [], [], []
                for t in part["text"].cast(pa.binary()).to_pylist():
                    g = grams(t or b"", 8)
                    at = _slot(g.astype(np.int64), slots)
                    hit = keys[at] == g
                    other, c = np.unique(g[~hit], return_counts=True)
                    sizes.append(len(g)), sums.append(int(logs[at[hit]].sum())), others.append(other.astype(np.int64)), counts.append(c)
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (others, counts)]
                yield pa.record_batch([part["doc_id"], part["lang"], pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), *lists], names=["doc_id", "lang", "n", "log", "grams", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, f"doc_id {kind}, lang string, n long, log long, grams array<long>, counts array<long>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    others = rows.select("row", F.explode(F.arrays_zip("grams", "counts")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.counts").alias("times"))
    priced = written(chances(others.select("gram").distinct(), tables).select("gram", _log(F.col("p")).alias("each")), "others")
    sums = others.join(priced.hint("merge"), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("more"))
    out = rows.select("row", "doc_id", "lang", "n", "log").join(sums, "row", "left")
    mean = (F.col("log") + F.coalesce("more", F.lit(0))) / FINE / F.col("n")
    return out.select("doc_id", "lang", "n", F.when(F.col("n") > 0, F.exp(-mean)).alias("perplexity"))


def thresholds(scored: DataFrame, quantile: float, slack: float) -> DataFrame:
    """lang, threshold: slack times the least step under which the share `quantile` of the language's rows lies; and one row for all, lang null.

    Rows are counted by step first, so that no language's rows meet in one task.
    """
    bins = scored.where("perplexity is not null").select("lang", F.floor(F.log("perplexity") / STEP).alias("bin")).groupBy("lang", "bin").agg(F.count("*").alias("n"))
    both = bins.where("lang is not null").union(bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n"))
    by = W.partitionBy("lang")
    both = both.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "all": F.sum("n").over(by)})
    return both.where(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg((slack * F.exp((F.min("bin") + 1) * STEP)).alias("threshold"))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep of every row of docs.

    Trusted are the documents that labels (doc_id, quality) gives a 1. Four fifths of them, by the hash of their id,
    train the model; the perplexities of the rest set each language's threshold, and that of all languages together
    for a null language or one without trusted documents. keep: no perplexity above the threshold. Null and empty
    texts have a null perplexity and are not kept; with no trusted text there is no threshold, and all others are
    kept. Null ids are never trusted; repeated rows and labels count once a row (a document with any label of 1 is
    trusted); an empty table gives an empty result. Other columns are not read.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().withColumn("_train", F.pmod(F.xxhash64("_id"), F.lit(5)) > 0)
    rows = docs.select("doc_id", "lang", "text")
    train = rows.join(trusted.where("_train").hint("merge"), rows["doc_id"] == trusted["_id"], "left_semi")
    counts = written(gram_counts(train, 8), "grams")
    scored = written(perplexities(rows, probabilities(counts, 8)), "perplexity")
    judged = scored.join(trusted.where("not _train").hint("merge"), scored["doc_id"] == trusted["_id"], "left_semi")
    limits = written(thresholds(judged, quantile, slack), "thresholds")
    own = limits.where("lang is not null").select(F.col("lang").alias("_lang"), F.col("threshold").alias("_own"))
    of_all = limits.where("lang is null").agg(F.max("threshold")).first()[0]
    out = scored.join(own, scored["lang"] == own["_lang"], "left").withColumn("threshold", F.coalesce("_own", F.lit(of_all).cast("double")))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "perplexity", "threshold", keep.alias("keep"))
