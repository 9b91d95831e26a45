"""Language of a text: averaged embeddings of hashed subwords under a linear softmax, fitted by gradient descent in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, written

#: Hash bits, embedding width, and the bound on labelled rows that a model is fitted on: so many a language, so many in all
#: (every language keeps a few), and so many bytes of counts, shared evenly by the languages.
BITS, WIDTH, ROWS_A_LANGUAGE, ROWS, LEAST_ROWS, BYTES = 14, 16, 400, 102_400, 5, 256 << 20
#: Languages up to which a table with a row for each is broadcast (some 5 MB).
_BROADCAST = 100_000
#: Share of rightly labelled validation documents that may fall under the rejection threshold.
REJECTED = 0.002
UNDETERMINED = "und"


def subwords(text: str) -> np.ndarray:
    """Hashes of the 3- and 4-byte pieces of the lower-cased words of a text, a space before and after each word."""
    line = b" " + b" ".join(text.lower().encode("utf-8", "replace").split()) + b" "
    b = np.frombuffer(line, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    space = b == 32
    three = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    four = three[:-1] | (b[3:] << np.uint32(24))
    inner = space[1:-1]
    keep3, keep4 = ~inner, ~(inner[:-1] | inner[1:])
    h3, h4 = three[keep3] * np.uint32(2654435761), (four[keep4] ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)
    h = np.concatenate([h3 ^ (h3 >> np.uint32(15)), h4 ^ (h4 >> np.uint32(13))])
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Model:
    """Languages, what each subword adds to each language's score, and the temperature and threshold of the calibration."""

    languages: list[str]
    scores: np.ndarray  # embeddings times the softmax's weights: the mean of a sum is the sum of means
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, hashes: np.ndarray) -> np.ndarray:
        return self.scores[hashes].mean(axis=0, dtype=np.float64) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; UNDETERMINED and 0 for no letter, or with nothing learned."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        h = subwords(text)
        z = (self.logits(h) if len(h) else self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, p[k] / p.sum()))


def training_rows(labelled: DataFrame, lang: str = "lang") -> pd.DataFrame:
    """lang, hashes, counts of a sample for fit(): at most ROWS_A_LANGUAGE of each language, and fewer where there are so many languages that these exceed ROWS.

    The sample goes by the hash of text and id: the least hashes of each language set a limit, and only rows under it
    have their whole texts turned into counts, where they are. Only rows under a first, rougher limit, by the number
    of a language's rows, are put in order, so that no language's rows meet in one task. Repeated rows count once.
    Of a language whose counts take more than its share of BYTES the rows of the largest hashes are left out.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col(lang).cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h"))
    # hashes are even over the longs: under this limit lie about twice the rows wanted, whatever a language has
    named = written(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("d")), "languages")
    many = max(1, named.count())
    wanted = max(LEAST_ROWS, min(ROWS_A_LANGUAGE, ROWS // many))
    small = F.broadcast if many <= _BROADCAST else lambda df: df
    share = F.least(F.lit(1.0), 2.0 * wanted / F.col("d"))
    rows = rows.join(small(named.select("lang", (share * 2.0**64 - 2.0**63).alias("about"))), "lang").where(F.col("h").cast("double") <= F.col("about")).drop("about")
    first = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= wanted)
    rows = rows.join(small(first.groupBy("lang").agg(F.max("h").alias("limit"))), "lang").where("h <= limit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [np.unique(subwords(t), return_counts=True) for t in b["text"].to_pylist()]
            yield pa.record_batch([b["lang"], b["h"], pa.array([x.astype(np.int32).tobytes() for x, _ in pairs], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in pairs], pa.binary())], names=["lang", "h", "hashes", "counts"])

    sample = rows.select("lang", "h", "text").mapInArrow(count, "lang string, h long, hashes binary, counts binary").dropDuplicates(["lang", "h"])
    size = F.octet_length("hashes") + F.octet_length("counts")
    before = F.sum(size.cast("long")).over(W.partitionBy("lang").orderBy("h")) - size  # of a bounded number of rows
    return sample.withColumn("before", before).where(F.col("before") < BYTES // many).drop("before").toPandas().sort_values(["h", "lang"], ignore_index=True)


def fit(sample: pd.DataFrame, epochs: int = 12, rate: float = 2.0, batch: int = 64, seed: int = 7) -> Model:
    """Fits embeddings and softmax on four fifths of the sample; temperature and threshold on the rest. The same sample, the same model."""
    languages = sorted(sample["lang"].unique())
    k = len(languages)
    rng = np.random.default_rng(seed)
    if k < 2:
        return Model(languages, np.zeros((1 << BITS, k), np.float32), np.zeros(k), 1.0, 0.0)
    y = np.array([languages.index(x) for x in sample["lang"]])
    bags = [(np.frombuffer(h, np.int32), np.frombuffer(c, np.int32)) for h, c in zip(sample["hashes"], sample["counts"], strict=True)]

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), 1 << BITS), np.float32)
        for i, r in enumerate(rows):
            x[i, bags[r][0]] = bags[r][1] / max(1, bags[r][1].sum())
        return x

    held = np.arange(len(y)) % 5 == 4
    train, valid = np.flatnonzero(~held), np.flatnonzero(held)
    e = rng.normal(0, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    w, bias = np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32)
    weight = (len(train) / (k * np.maximum(1, np.bincount(y[train], minlength=k)))).astype(np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            x = dense(rows)
            hidden = x @ e
            z = hidden @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[y[rows], None] / len(rows)
            back = p @ w.T
            w -= step * (hidden.T @ p)
            bias -= step * p.sum(axis=0)
            e -= step * 100 * (x.T @ back)  # a subword is a small part of each text
    scores = (e @ w).astype(np.float32)
    if not len(valid):
        return Model(languages, scores, bias.astype(float), 1.0, 0.0)
    z = np.concatenate([dense(rows) @ scores for rows in np.array_split(valid, max(1, len(valid) // batch))]) + bias

    def chance(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    loss = {t: -np.log(np.maximum(chance(t)[np.arange(len(valid)), y[valid]], 1e-12)).mean() for t in np.geomspace(0.05, 5, 40)}
    t = float(min(loss, key=loss.get))
    p = chance(t)
    right = p.max(axis=1)[p.argmax(axis=1) == y[valid]]
    # half of what the least sure of the rightly labelled had, and never over an even chance
    threshold = min(0.5, 0.5 * float(np.quantile(right, REJECTED))) if len(right) else 0.0
    return Model(languages, scores, bias.astype(float), t, threshold)


def classify(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, Column]:
    """docs and a column lang_pred, score, rejected of it for every row, from the text alone.

    Rejected are texts that are null or have no letter, and those with a score under the model's threshold.
    """
    name = fresh("language", docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64 KB a language

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        out = pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])
        out["rejected"] = (out["lang_pred"] == UNDETERMINED) | (out["score"] < m.threshold)
        return out

    return docs.withColumn(name, predict(F.col(text))), F.col(name)


def held_out(doc_id: Column) -> Column:
    """True for a quarter of the ids, by CRC-32 of the id as text; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_rows(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row; learned from the rows with a language that aren't held out.

    Null texts and texts without a letter are `und` with score 0; rows with a null id are never learned from; with no
    labelled row everything is `und`; repeated rows get the same answer.
    """
    model = fit(training_rows(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())))
    rows, found = classify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found["lang_pred"].alias("lang_pred"), found["score"].alias("score"), found["rejected"].alias("rejected"))


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without those that the model rejects; it is fitted on the rows of docs that have a language."""
    model = fit(training_rows(docs))
    rows, found = classify(docs, model)
    return rows.where(~found["rejected"]).select(*docs.columns)
