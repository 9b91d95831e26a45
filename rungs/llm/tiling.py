"""Benchmark decontamination by greedy string tiling: reordered passages count as much as whole ones.

Seeds, the runs of a few words that documents and benchmark items share, are joined in Spark; only the words of a
document under its seeds go on from there, and each document and item that share enough seeds are tiled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import emptied, fresh, scope, written

#: Words of a tile at least, and the share of an item's words under tiles from which a document counts as contaminated.
LEAST, COVERAGE = 5, 0.8
#: Bits of the filter of the benchmark's seeds (two to this power: 8 MB), whatever the benchmark's size.
FILTER_BITS = 26
#: ASCII but for letters and digits becomes a space.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain(text: str | None) -> bytes:
    """Lower-case words of a text without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN)


def _grams(tokens: np.ndarray, n: int) -> np.ndarray:
    i = np.arange(max(0, len(tokens) - n + 1))
    return rolling.spans(rolling.sums(tokens), i, i + n)


def seeds(tokens: np.ndarray, least: int) -> np.ndarray:
    """Hashes of all runs of `least` words; of fewer words, one of them all; of none, none."""
    return _grams(tokens, min(least, len(tokens))) if len(tokens) else np.zeros(0, np.uint64)


def tiles(a: list[int], b: list[int], least: int) -> list[tuple[int, int, int]]:
    """(place in a, place in b, words) of greedy string tiling: the longest common runs of unmarked words first.

    Karp-Rabin hashes of runs of s words of b find the matches; s goes from long to `least` by halves. Negative words
    never match.
    """
    free_a, free_b = [x >= 0 for x in a], [x >= 0 for x in b]
    out: list[tuple[int, int, int]] = []
    s = max(least, min(len(a), 32))
    while True:
        places: dict[int, list[int]] = {}
        for j, h in _rolled(b, free_b, s):
            places.setdefault(h, []).append(j)
        found: list[tuple[int, int, int]] = []
        for i, h in _rolled(a, free_a, s):
            for j in places.get(h, ()):
                if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                    continue  # a part of the match one word before
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k >= s:
                    found.append((k, i, j))
        longest = max(found, default=(0, 0, 0))[0]
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_a[i : i + k]) and all(free_b[j : j + k]):
                out.append((i, j, k))
                free_a[i : i + k] = [False] * k
                free_b[j : j + k] = [False] * k
            else:
                again = True  # what is left of it may still be long enough
        if again:
            continue
        if s == least:
            return out
        s = s // 2 if s > 2 * least else least


def _rolled(x: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """Place and rolling hash of each run of s unmarked words."""
    base, mod = 1_000_003, (1 << 61) - 1
    top = pow(base, s - 1, mod)
    h = n = 0
    for j, v in enumerate(x):
        if not free[j]:
            h = n = 0
            continue
        if n == s:
            h = (h - x[j - s] * top) % mod
            n -= 1
        h = (h * base + v) % mod
        n += 1
        if n == s:
            yield j - s + 1, h


def tiling(own: np.ndarray, words: np.ndarray, places: np.ndarray, coverage: float, least: int) -> tuple[float, list[tuple[int, int, int]]] | None:
    """Share of the words of an item (own) under tiles, and the tiles, in words of item and text; None under `coverage`.

    words, places: the words of a text that may be in a tile, and where they stand.
    """
    least = min(least, len(own))
    if np.isin(own, words).sum() < coverage * len(own):
        return None  # too few of its words are there at all
    # no match has words outside the seeds of the item
    i = np.arange(max(0, len(words) - least + 1))
    whole = places[i + least - 1] - places[i] == least - 1
    at = i[whole][np.isin(_grams(words, least)[whole], _grams(own, least))]
    under = np.zeros(len(words) + 1, np.int64)
    np.add.at(under, at, 1)
    np.add.at(under, at + least, -1)
    near = np.flatnonzero(under.cumsum()[:-1] > 0)
    words, places = words[near], places[near]
    names = {w: k for k, w in enumerate(np.unique(own).tolist())}
    b, where, last = [], [], None
    for w, x in zip(words.tolist(), places.tolist(), strict=True):
        if last is not None and x != last + 1:
            b.append(-1), where.append(-1)
        b.append(names.get(w, -1)), where.append(x)
        last = x
    found = tiles([names[w] for w in own.tolist()], b, least)
    share = sum(t[2] for t in found) / len(own)
    return (share, [(k, where[j], m) for k, j, m in sorted(found)]) if share >= coverage else None


def item_table(benchmark: DataFrame, least: int, item_id: str, text: str) -> DataFrame:
    """item (a number of its own), item_id, n, words (word hashes) and seeds of every row of a benchmark that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for b in batches:
            tokens = [rolling.words(plain(t))[2] for t in b["text"].to_pylist()]
            keep = [i for i, x in enumerate(tokens) if len(x)]
            own = [tokens[i] for i in keep]
            found = [seeds(x, least).view(np.int64) for x in own]
            yield pa.record_batch([pa.array(np.arange(number, number + len(own))), b["item_id"].take(pa.array(keep, pa.int64())), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["item", "item_id", "n", "words", "seeds"])
            number += len(own)

    kind = benchmark.schema[item_id].dataType.simpleString()
    rows = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, f"item long, item_id {kind}, n long, words binary, seeds array<long>"), "items")


def seed_filter(found: DataFrame) -> np.ndarray:
    """A bit for each value of the first FILTER_BITS bits that a seed (h) has; its size does not depend on found."""
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = found.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << max(0, FILTER_BITS - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def seeded(docs: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """row (a number of its own), doc_id, th, words, places and seeds of every document with a seed that the filter lets through.

    words, places: only those under such seeds. Documents are read where they are; nothing else of them moves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # of a fixed size
    below = 64 - FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 33, shared.value
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                keep, words, places, hashes = [], [], [], []
                for i, t in enumerate(part["text"].to_pylist()):
                    tokens = rolling.words(plain(t))[2]
                    h = seeds(tokens, least)
                    slot = h >> np.uint64(below)
                    at = np.flatnonzero((held[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
                    if not len(at):
                        continue
                    under = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(under, at, 1)
                    np.add.at(under, at + min(least, len(tokens)), -1)
                    near = np.flatnonzero(under.cumsum()[:-1] > 0)
                    keep.append(i), words.append(tokens[near].tobytes()), places.append(near.astype(np.int32).tobytes()), hashes.append(np.unique(h[at]).view(np.int64))
                if keep:
                    rows = pa.array(keep, pa.int64())
                    yield pa.record_batch([pa.array(np.arange(number, number + len(keep))), part["doc_id"].take(rows), part["th"].take(rows), pa.array(words, pa.binary()), pa.array(places, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], names=["row", "doc_id", "th", "words", "places", "seeds"])
                    number += len(keep)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"row long, doc_id {kind}, th long, words binary, places binary, seeds array<long>"), "seeded")


def telling(found: np.ndarray, docs: np.ndarray, n: int, coverage: float) -> np.ndarray:
    """The seeds of an item by which it is looked up: its rarest, as many as leave less than `coverage` of its n words under the others.

    found, docs: the item's seeds in the order of its words, and how many documents have each. A document that has none
    of these seeds can't cover the item.
    """
    order = np.lexsort((found, docs))
    turn = np.empty(len(found), np.int64)  # equal seeds go together
    turn[order] = np.concatenate([[0], np.cumsum(np.diff(found[order].view(np.int64)) != 0)])
    least = n - len(found) + 1
    lasts = np.full(n, -1)  # a word is under a seed until the last of its seeds has gone
    for k in range(least):
        lasts[k : k + len(found)] = np.maximum(lasts[k : k + len(found)], turn)
    under = n - np.cumsum(np.bincount(lasts, minlength=turn.max() + 1))
    enough = np.flatnonzero(under / n < coverage)
    return np.unique(found[turn <= (enough[0] if len(enough) else turn.max())])


def lookup(items: DataFrame, hits: DataFrame, coverage: float) -> DataFrame:
    """item, h: the seeds by which each item is looked up among hits (seeded)."""
    times = hits.select(F.explode("seeds").alias("h")).groupBy("h").agg(F.count("*").alias("docs"))
    placed = items.select("item", "n", F.posexplode("seeds").alias("place", "h")).join(times, "h", "left")
    own = placed.groupBy("item", "n").agg(F.sort_array(F.collect_list(F.struct("place", "h", F.coalesce("docs", F.lit(0)).alias("docs")))).alias("s"))  # one item's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, docs, n in zip(b["h"], b["docs"], b["n"].to_pylist(), strict=True):
                found = h.values.to_numpy(zero_copy_only=False).view(np.uint64)
                out.append(telling(found, docs.values.to_numpy(zero_copy_only=False), n, coverage).view(np.int64))
            yield pa.record_batch([b["item"], pa.array(out, pa.list_(pa.int64()))], names=["item", "h"])

    chosen = own.select("item", "n", F.col("s.h").alias("h"), F.col("s.docs").alias("docs")).mapInArrow(run, "item long, h array<long>")
    return written(chosen.select("item", F.explode("h").alias("h")), "lookup")


def _tiled(docs: DataFrame, benchmark: DataFrame, coverage: float, least: int) -> DataFrame:
    """doc_id, th, item_id, coverage, tiles.

    Items are joined by their rarest seeds alone (telling): a phrase that many items and documents share brings a
    document and an item together only where it makes up so much of the item that the document may cover it.
    """
    with scope() as made:
        out = written(_tiles_of(docs, benchmark, coverage, least), "tiled")
    emptied(made, out)
    return out


def _tiles_of(docs: DataFrame, benchmark: DataFrame, coverage: float, least: int) -> DataFrame:
    items = item_table(benchmark, least, "item_id", "text")
    hits = seeded(docs, seed_filter(items.select(F.explode("seeds").alias("h"))), least)
    met = hits.select("row", F.explode("seeds").alias("h")).join(lookup(items, hits, coverage), "h")
    met = written(met.select("row", "item").distinct(), "shared_seeds")
    pairs = met.join(items.select("item", "item_id", F.col("words").alias("own")), "item").join(hits.select("row", "doc_id", "th", "words", "places"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("item_word", "text_word", "words")]))
        for b in batches:
            keep, shares, marks = [], [], []
            for i, (x, w, p) in enumerate(zip(b["own"], b["words"], b["places"], strict=True)):
                found = tiling(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(w.as_py(), np.uint64), np.frombuffer(p.as_py(), np.int32).astype(np.int64), coverage, least)
                if found:
                    keep.append(i), shares.append(found[0])
                    marks.append([{"item_word": k, "text_word": j, "words": m} for k, j, m in found[1]])
            rows = pa.array(keep, pa.int64())
            yield pa.record_batch([*[b[c].take(rows) for c in ("doc_id", "th", "item_id")], pa.array(shares, pa.float64()), pa.array(marks, kind)], names=["doc_id", "th", "item_id", "coverage", "tiles"])

    doc_kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((hits, "doc_id"), (items, "item_id")))
    schema = f"doc_id {doc_kind}, th long, item_id {item_kind}, coverage double, tiles array<struct<item_word:int,text_word:int,words:int>>"
    return pairs.select("doc_id", "th", "item_id", "own", "words", "places").mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, coverage, tiles: every document that covers an item's words to `coverage` at least, by tiles of `least` words.

    Words are lower-cased and split at white space and ASCII punctuation. Each place of a text and of an item is under
    one tile at most, so that repeating a part of an item does not cover the rest. An item of fewer than `least` words
    is covered by a text of just these words. Null and empty texts and items match nothing; repeated rows and items
    are each on their own; an empty table gives an empty result. Ids may be of any type. Other columns of either table
    are not read.
    """
    return _tiled(docs, benchmark, coverage, least).drop("th")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """docs without those that contaminated() would name; all columns of docs are kept."""
    bad = written(_tiled(docs.select("doc_id", "text"), benchmark, coverage, least).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "contaminated")
    th = fresh("th", [*docs.columns, "_id", "_th"])
    rows = docs.withColumn(th, F.xxhash64("text"))
    return rows.join(bad, (rows[th] == bad["_th"]) & rows["doc_id"].eqNullSafe(bad["_id"]), "left_anti").select(*docs.columns)
