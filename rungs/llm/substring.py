"""Removal of word sequences that an earlier document has, by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import emptied, keyed, scope, written


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _upper(h: np.ndarray) -> pa.Array:
    """The upper 32 bits."""
    return pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _chosen(data: bytes, length: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, hashes of the windows of `short` words, and the runs of windows of `length` words that choose one of these."""
    h = rolling.words(data)[2]
    n = len(h) - short + 1
    if len(h) < length:
        none = np.zeros(0, np.int64)
        return h, none, none, none, none
    i = np.arange(n)
    seeds = rolling.spans(rolling.sums(h), i, i + short)
    return h, seeds, *rolling.runs(rolling.least_of(seeds, length - short + 1))


def seeds_of(rows: DataFrame, length: int, lengths: list[int]) -> DataFrame:
    """did, th, place, h, and a column r and l for each length between: of each window of `length` words one inner window
    of lengths[0] words stands for it, the one with the least hash, so that equal windows choose alike.

    h: its hash; r<n>, l<n>: those of the n words from its start on and up to its end, where one of the windows that it
    stands for holds them, else null. All have 48 bits: more would be no help, as the last level checks.
    """
    short = lengths[0]
    names = ["did", "th", "place", "h", *[f"{side}{n}" for n in lengths[1:-1] for side in "rl"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                made: list[list[np.ndarray]] = []
                for d, th, t in zip(part["did"].to_pylist(), part["th"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                    h, seeds, place, first, after = _chosen(t, length, short)
                    if not len(place):
                        continue
                    row = [np.full(len(place), d, np.int64), np.full(len(place), th, np.int64), place, _cut(seeds[place])]
                    sums = rolling.sums(h)
                    for n in lengths[1:-1]:
                        # a window of `length` that starts late enough holds the n words from the place on; an earlier one those up to the place's end
                        right, back = after - 1 + length >= place + n, first <= place + short - n
                        for fit, at in ((right, place), (back, place + short - n)):
                            fit &= (at >= 0) & (at + n <= len(h))
                            at = np.where(fit, at, 0)
                            row += [_cut(rolling.spans(sums, at, np.minimum(at + n, len(h)))), fit]
                    made.append(row)
                if made:
                    did, th, place, h, *more = (np.concatenate(x) for x in zip(*made, strict=True))
                    cols = [pa.array(did), pa.array(th), pa.array(place.astype(np.int32)), pa.array(h)]
                    yield pa.record_batch([*cols, *[pa.array(v, mask=~fit) for v, fit in zip(more[::2], more[1::2], strict=True)]], names=names)

    kinds = ["long", "long", "int", *["long"] * (len(names) - 3)]
    return rows.select("did", "th", "text").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def _cut(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(16)).view(np.int64)


def _in_two(rows: DataFrame, key: str) -> DataFrame:
    """rows whose key two documents have."""
    keys = rows.groupBy(key).agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi").select(key)
    return rows.join(written(keys, "repeated").hint("merge"), key)  # on its own, so that the join's hot keys can be split


def repeated_places(rows: DataFrame, length: int, lengths: list[int]) -> DataFrame:
    """did, th, places: those that are left when windows seen in one document alone are out, level by level."""
    with scope() as made:
        kept = _in_two(written(seeds_of(rows, length, lengths), "seeds"), "h").drop("h")
        for n in lengths[1:-1]:
            later = [c for c in kept.columns if c[0] in "rl" and int(c[1:]) > n]
            grown = written(kept, "kept").select("did", "th", "place", *later, F.explode(F.array(f"r{n}", f"l{n}")).alias("h")).where("h is not null")
            kept = _in_two(grown, "h").drop("h")
            kept = kept.dropDuplicates(["did", "th", "place"]) if later else kept
        out = written(kept.groupBy("did", "th").agg(F.collect_set("place").alias("places")), "places")
    emptied(made, out)
    return out


def repeated_windows(rows: DataFrame, length: int = 13, short: int = 7) -> DataFrame:
    """did, th, first, n: runs of n windows of `length` words, from word `first` on, that also start in a document with a smaller did.

    rows: did, th, text. Level one keeps the windows of `short` words that two documents have; only these are extended to
    twice their length (or to `length`, if that is less), and so on until `length` is reached and none is left to be
    doubled. At the last level, neighbouring windows that were extended from one seed are first compared as one
    string, which settles most of them; at all places of the least document that has the string, its windows are
    compared one by one. The hashes of the last level have 96 bits: of 10**13 windows, two different ones share a hash with a chance under a thousandth.
    """
    lengths = [length]
    while lengths[0] > short:
        lengths.insert(0, -(-lengths[0] // 2))
    kept = repeated_places(rows, length, lengths)
    found = written(_strings(rows, kept, length, lengths[0]), "strings")
    first = found.groupBy("f1", "f2").agg(F.min(F.struct("did", "th", "first", "n")).alias("at"))
    first = written(first, "firsts")
    # every other place of a string: in a later document it is whole a repeat, in the least one it is as new as the first place
    other = found.join(first.hint("merge"), ["f1", "f2"]).where(F.struct("did", "th", "first") != F.struct("at.did", "at.th", "at.first"))
    other = written(other.select("did", "th", "first", "n", F.col("at.did").alias("least")), "places")
    whole = other.where("least < did").select("did", "th", "first", "n")
    # where a string is new, its windows are looked up one by one, among those of all strings
    new = first.select("at.did", "at.th", "at.first", "at.n").union(other.where("least = did").select("did", "th", "first", "n"))
    new = new.groupBy("did", "th").agg(F.collect_set(F.struct("first", "n")).alias("places"))
    windows = written(_windows(rows, new, length), "windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min("did").alias("least"), F.max("did").alias("last")).where("least < last").select("w1", "w2", "least")
    single = windows.join(written(earliest, "earliest").hint("merge"), ["w1", "w2"]).where("least < did").select("did", "th", "first", F.lit(1).alias("n"))
    return whole.union(single)


def _over_text(rows: DataFrame, kept: DataFrame, each, schema: str) -> DataFrame:
    """each(did, th, text, places) for every row that has places left, in batches. The places are those of one text, whatever its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                made = [each(d, h, t, p) for d, h, t, p in zip(part["did"].to_pylist(), part["th"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), part["places"].to_pylist(), strict=True)]
                made = [m for m in made if m is not None]
                if made:
                    yield pa.concat_batches(made) if len(made) > 1 else made[0]

    return rows.select("did", "th", "text").join(kept.hint("merge"), ["did", "th"]).select("did", "th", "text", "places").mapInArrow(run, schema)


def _strings(rows: DataFrame, kept: DataFrame, length: int, short: int) -> DataFrame:
    """did, th, first, n, f1, f2: the runs of n windows that chose a place that is left, and the hash of all words under them."""

    def each(d: int, th: int, text: bytes, left: list) -> pa.RecordBatch | None:
        h, _, place, first, after = _chosen(text, length, short)
        own = np.isin(place, left)
        first, after = first[own], after[own]
        if not len(first):
            return None
        f = [rolling.spans(rolling.sums(h, k), first, after + length - 1, k) for k in (0, 1)]
        return pa.record_batch([pa.array(np.full(len(first), d, np.int64)), pa.array(np.full(len(first), th, np.int64)), pa.array(first.astype(np.int32)), pa.array((after - first).astype(np.int32)), _signed(f[0]), _upper(f[1])], names=["did", "th", "first", "n", "f1", "f2"])

    return _over_text(rows, kept, each, "did long, th long, first int, n int, f1 long, f2 int")


def _windows(rows: DataFrame, new: DataFrame, length: int) -> DataFrame:
    """did, th, first, w1, w2: each window of the runs in new (did, th, places)."""

    def each(d: int, th: int, text: bytes, places: list) -> pa.RecordBatch:
        h = rolling.words(text)[2]
        first, n = np.array([[p["first"], p["n"]] for p in places], np.int64).T
        p = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        w = [rolling.spans(rolling.sums(h, k), p, p + length, k) for k in (0, 1)]
        return pa.record_batch([pa.array(np.full(len(p), d, np.int64)), pa.array(np.full(len(p), th, np.int64)), pa.array(p.astype(np.int32)), _signed(w[0]), _upper(w[1])], names=["did", "th", "first", "w1", "w2"])

    return _over_text(rows, new, each, "did long, th long, first int, w1 long, w2 int")


def drop_repeats(docs: DataFrame, length: int = 13, short: int = 7) -> DataFrame:
    """doc_id, text (the words that stay, joined by a space), n_words, n_removed, spans of every row of docs.

    A word goes if a window of `length` words over it also starts in a row with a smaller doc_id; windows are judged
    on the input. spans: [start, end) in words, in order, apart. Null texts have no words; a null doc_id is below
    every other and not below itself; rows that share a doc_id are never each other's earlier document; an empty
    table gives an empty result. Other columns of docs are not read.
    """
    rows = keyed(docs)
    with scope() as made:
        found = repeated_windows(rows, length, short)
        marks = written(found.groupBy("did", "th").agg(F.collect_set(F.struct("first", "n")).alias("runs")), "spans")
    emptied(made, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts, n_words, n_gone, spans = [], [], [], []
                for t, marked in zip(part["text"].cast(pa.binary()).to_pylist(), part["runs"].to_pylist(), strict=True):
                    w = t.split()
                    edge = np.zeros(len(w) + 1, np.int64)
                    for r in marked or ():
                        edge[r["first"]] += 1
                        edge[r["first"] + r["n"] + length - 1] -= 1
                    gone = np.concatenate([[0], edge.cumsum()[:-1] > 0, [0]]).astype(np.int8)
                    turn = np.flatnonzero(np.diff(gone))
                    cut = list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))
                    for a, z in reversed(cut):
                        del w[a:z]
                    texts.append(b" ".join(w).decode()), n_words.append(len(edge) - 1), n_gone.append(len(edge) - 1 - len(w))
                    spans.append([{"start": a, "end": z} for a, z in cut])
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.record_batch([part["doc_id"], pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(spans, span)], names=["doc_id", "text", "n_words", "n_removed", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(marks.hint("merge"), ["did", "th"], "left").select("doc_id", "text", "runs").mapInArrow(run, f"doc_id {kind}, text string, n_words long, n_removed long, spans array<struct<start:int,end:int>>")
