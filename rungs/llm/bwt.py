"""Removal of byte strings that occur more than once, by Burrows-Wheeler orders of shards that are merged by refinement.

Only suffixes at anchors are put in order. Every window of `length` bytes chooses an anchor inside itself by content
alone, so that equal windows choose equal places. A shard orders its anchors by what follows them, and keeps with
each the bytes before it: the symbols of its transform. Merging interleaves the shards' orders: all suffixes of one
anchor begin as one block, and each round reads eight more bytes of the blocks that are still shared and splits them,
stably, so that a shard's own order is never sorted again; the round in which two neighbours part gives their common
prefix. The same, read backwards, orders the symbols before the anchors. Two windows are equal if they lie in one
interval of either order, at depths that add up to `length`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import emptied, keyed, scope, shuffle_partitions, written

#: Bytes of a text that are looked at together.
PART = 1 << 20
#: Suffixes that are merged together, about; anchors with more different surroundings go the other way, window by window.
MERGE, MOST = 20_000, 20_000
_NEVER = 1 << 30


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def _shape(length: int) -> tuple[int, int]:
    """Anchors that a window chooses from, and the bytes of each that are compared."""
    width = max(1, length // 2)
    return width, max(1, min(16, length - width + 1))


def anchors(rows: DataFrame, length: int, span: int = PART) -> DataFrame:
    """did, th, core, f1, f2, place, first, after: the windows first..after - 1 that choose the anchor at `place`.

    core: hash of the bytes from the anchor on that are in each of its windows; f1, f2: of all bytes of its windows.
    """
    width, short = _shape(length)
    inner = length - width + 1

    def of(text: bytes) -> list[np.ndarray]:
        found = []
        for at in range(0, max(1, len(text) - length + 1), span):
            values = rolling.byte_values(text[at : at + span + length - 1])
            if len(values) < length:
                continue
            prefix = [rolling.sums(values, k) for k in (0, 1)]
            i = np.arange(len(values) - short + 1)[: len(values) - length + width]
            place, first, after = rolling.runs(rolling.least_of(rolling.spans(prefix[0], i, i + short), width))
            lead = (place - first).astype(np.uint64)
            f = [rolling.mixed(rolling.spans(prefix[k], first, after - 1 + length, k) + lead) for k in (0, 1)]
            found.append([rolling.spans(prefix[1], place, place + inner, 1), *f, place + at, first + at, after + at])
        return [np.concatenate(x) for x in zip(*found, strict=True)] if found else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                made = []
                for d, t, x in zip(part["did"].to_pylist(), part["th"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                    a = of(x)
                    if a:
                        n = len(a[0])
                        made.append([np.full(n, d, np.int64), np.full(n, t, np.int64), *a])
                if made:
                    did, th, core, f1, f2, place, first, after = (np.concatenate(x) for x in zip(*made, strict=True))
                    yield pa.record_batch([pa.array(did), pa.array(th), _signed(core), _signed(f1), _signed(f2), *[pa.array(x.astype(np.int32)) for x in (place, first, after)]], names=["did", "th", "core", "f1", "f2", "place", "first", "after"])

    return rows.select("did", "th", "text").mapInArrow(run, "did long, th long, core long, f1 long, f2 long, place int, first int, after int")


def shard_orders(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """core, f1, f2, shard, rank, lead, low, left, right, kinds: the suffixes of each shard (a task's rows) in their order.

    left: the bytes before the anchor, the nearest first (what the transform would give, step by step, backwards);
    right: those from it on; lead, low: how many of the left ones the first and the last window take; kinds: different
    suffixes of the anchor. wanted: core, f1, f2, at (one place that has them), kinds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                made = []
                part = b.slice(i, 256)
                for text, places in zip(part["text"].cast(pa.binary()).to_pylist(), part["places"].to_pylist(), strict=True):
                    for p in places:
                        q, lo, end = p["place"], p["first"], p["after"] - 1 + length
                        made.append((p["core"], text[q:end], p["f1"], p["f2"], q - lo, q - p["after"] + 1, text[lo:q][::-1], p["kinds"]))
                made.sort(key=lambda m: m[:2])
                if made:
                    core, right, f1, f2, lead, low, left, kinds = zip(*made, strict=True)
                    yield pa.record_batch([pa.array(core, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(np.full(len(made), shard * 1_000_003 + i, np.int64)), pa.array(np.arange(len(made), dtype=np.int32)), pa.array(lead, pa.int32()), pa.array(low, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(kinds, pa.int64())], names=["core", "f1", "f2", "shard", "rank", "lead", "low", "left", "right", "kinds"])

    places = wanted.groupBy("at.did", "at.th").agg(F.collect_list(F.struct("core", "f1", "f2", "at.place", "at.first", "at.after", "kinds")).alias("places"))
    firsts = rows.select("did", "th", "text").join(places.hint("merge"), ["did", "th"])
    return firsts.mapInArrow(run, "core long, f1 long, f2 long, shard long, rank int, lead int, low int, left binary, right binary, kinds long")


def interleave(blocks: np.ndarray, symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of suffixes and the common prefix of each with the one before it (-1: another block).

    blocks: what is known to be equal up to depth, in ascending order; symbols: the bytes after that, eight to a word,
    a row a suffix. Each round reads a word of the suffixes that still share a block and splits the blocks, keeping
    the order of equals.
    """
    order = np.arange(len(blocks))
    common = np.full(len(blocks), _NEVER, np.int64)
    start = np.concatenate([[True], blocks[1:] != blocks[:-1]]) if len(blocks) else np.zeros(0, bool)
    common[start] = -1
    for k in range(symbols.shape[1]):
        shared = ~start
        shared[:-1] |= ~start[1:]
        at = np.flatnonzero(shared)
        if not len(at):
            break
        block, word = np.cumsum(start)[at], symbols[order[at], k]
        by = np.lexsort((word, block))
        order[at] = order[at[by]]
        word = word[by]
        apart = np.flatnonzero(~start[at[1:]] & (word[1:] != word[:-1]))
        bits = np.frexp((word[1:] ^ word[:-1])[apart].astype(np.float64))[1]  # of the highest bit that differs, or one more by rounding
        top = (word[1:] ^ word[:-1])[apart]
        bits -= (top >> np.minimum(bits - 1, 63).clip(0).astype(np.uint64)) == 0
        common[at[apart + 1]] = depth + 8 * k + (64 - bits) // 8
        start[at[apart + 1]] = True
    return order, common


def _words(strings: list[bytes], skip: int, most: int) -> np.ndarray:
    """Bytes skip..most of each string as big-endian words, zeros behind its end."""
    n = -(-(most - skip) // 8)
    return np.frombuffer(b"".join(s[skip:most].ljust(8 * n, b"\0") for s in strings), ">u8").reshape(len(strings), n).astype(np.uint64)


def repeated_windows(core: np.ndarray, left: list[bytes], right: list[bytes], lead: np.ndarray, low: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each suffix (cores in ascending order), the runs [a, b] of bytes before the anchor at which its window is another's, too."""
    width, _ = _shape(length)
    skip = (length - width + 1) // 8 * 8
    m = len(core)
    orders = [interleave(core, _words(right, skip, length), skip), interleave(core, _words(left, 0, width), 0)]
    size = np.array([len(r) for r in right])

    def intervals(which: int, depth: int) -> np.ndarray:
        order, common = orders[which]
        out = np.empty(m, np.int64)
        out[order] = np.cumsum(common < depth)
        return out

    hit = np.zeros((m, width + 1), bool)
    for x in range(width):
        own = np.flatnonzero((low <= x) & (x <= lead) & (size >= length - x))
        if len(own) > 1:
            key = intervals(0, length - x)[own] * (m + 1) + intervals(1, x)[own]
            _, at, n = np.unique(key, return_inverse=True, return_counts=True)
            hit[own, x] = n[at] > 1
    edge = np.diff(np.concatenate([np.zeros((m, 1), np.int8), hit.view(np.int8)], axis=1), axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for (i, a), (_, b) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist(), strict=True):
        out[i].append((a, b - 1))
    return out


_FOUND = "core long, f1 long, f2 long, xs array<struct<a:int,b:int>>"


def merged(suffixes: DataFrame, length: int) -> DataFrame:
    """core, f1, f2, xs: what the merge of the shards' orders finds for each suffix that has a repeated window."""

    def solve(held: pa.Table) -> Iterator[pa.RecordBatch]:
        if not held.num_rows:
            return
        core, lead, low = (held[c].to_numpy() for c in ("core", "lead", "low"))
        xs = repeated_windows(core, held["left"].to_pylist(), held["right"].to_pylist(), lead, low, length)
        keep = np.array([bool(x) for x in xs])
        rows = [[{"a": a, "b": b} for a, b in x] for x in xs if x]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for part in held.select(["core", "f1", "f2"]).filter(pa.array(keep)).append_column("xs", pa.array(rows, kind)).combine_chunks().to_batches():
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= MERGE:
                table = pa.Table.from_batches(held)
                core = table["core"].to_numpy()
                cut = int(np.searchsorted(core, core[-1]))  # the last anchor may go on
                yield from solve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                n -= cut
        if held:
            yield from solve(pa.Table.from_batches(held))

    return suffixes.repartition(shuffle_partitions(suffixes.sparkSession), "core").sortWithinPartitions("core", "shard", "rank").select("core", "f1", "f2", "lead", "low", "left", "right").mapInArrow(run, _FOUND)


def one_by_one(suffixes: DataFrame, length: int) -> DataFrame:
    """core, f1, f2, xs, as merged(), from the hash of each window: for anchors that are too common to be merged in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                text, x = r["left"][::-1] + r["right"], np.arange(r["low"], r["lead"] + 1)
                values, p = rolling.byte_values(text), r["lead"] - x
                h = [rolling.spans(rolling.sums(values, k), p, p + length, k) for k in (0, 1)]
                same = [pa.array(np.full(len(x), r[c], np.int64)) for c in ("core", "f1", "f2")]
                yield pa.record_batch([*same, pa.array(x.astype(np.int32)), _signed(h[0]), _signed(h[1])], names=["core", "f1", "f2", "x", "w1", "w2"])

    windows = suffixes.select("core", "f1", "f2", "lead", "low", "left", "right").mapInArrow(run, "core long, f1 long, f2 long, x int, w1 long, w2 long")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    return windows.join(twice, ["w1", "w2"]).groupBy("core", "f1", "f2").agg(F.collect_list(F.struct(F.col("x").alias("a"), F.col("x").alias("b"))).alias("xs"))


def repeated_runs(rows: DataFrame, length: int = 400, most: int = MOST) -> DataFrame:
    """did, th, first, n: runs of n windows of `length` bytes, from byte `first` on, that also start anywhere else.

    rows: did, th, text. Anchors whose windows agree in all their bytes with another's are settled by that; only where
    surroundings differ are the suffixes of the different ones put in order, by shards, and merged.
    """
    found = anchors(rows, length)
    twice = found.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    twice = written(twice, "twice")  # on its own, so that the join's hot keys can be split
    left = written(found.join(twice.hint("merge"), "core"), "anchors")
    strings = left.groupBy("core", "f1", "f2").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "place", "first", "after")).alias("at"))
    strings = written(strings, "strings")
    several = written(strings.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    suffixes = written(shard_orders(rows, strings.join(several.hint("merge"), "core"), length), "suffixes")
    # a string that is there twice is settled, but others may have one of its windows
    parts = merged(suffixes.where(F.col("kinds") <= most), length).union(one_by_one(suffixes.where(F.col("kinds") > most), length))
    single = strings.where("n = 1").select("core", "f1", "f2")
    parts = written(parts.join(single.hint("merge"), ["core", "f1", "f2"], "left_semi"), "parts")
    whole = left.join(strings.where("n > 1").select("core", "f1", "f2").hint("merge"), ["core", "f1", "f2"]).select("did", "th", "first", (F.col("after") - F.col("first")).alias("n"))
    part = left.join(parts.hint("merge"), ["core", "f1", "f2"]).select("did", "th", "place", F.explode("xs").alias("x"))
    return whole.union(part.select("did", "th", (F.col("place") - F.col("x.b")).alias("first"), (F.col("x.b") - F.col("x.a") + 1).alias("n")))


def drop_repeats(docs: DataFrame, length: int = 400, most: int = MOST) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, spans of every row of docs.

    A byte of the UTF-8 text goes if a string of `length` bytes over it also starts anywhere else, in another row or in
    the same one; strings are judged on the input, may overlap and never run over the end of a text. spans: [start,
    end) in bytes, in order, apart. Null texts are empty; null and repeated ids and repeated rows are rows of their
    own (a repeated row is elsewhere); an empty table gives an empty result. Other columns of docs are not read.
    """
    rows = keyed(docs)
    with scope() as made:
        marks = repeated_runs(rows, length, most)  # rows that are alike have the same runs
        marks = written(marks.groupBy("did", "th").agg(F.collect_set(F.struct("first", "n")).alias("runs")), "spans")
    emptied(made, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                kept, n_bytes, n_gone, spans = [], [], [], []
                for t, marked in zip(part["text"].cast(pa.binary()).to_pylist(), part["runs"].to_pylist(), strict=True):
                    cut: list[list[int]] = []
                    for a, z in sorted((r["first"], r["first"] + r["n"] + length - 1) for r in marked or ()):
                        if cut and a <= cut[-1][1]:
                            cut[-1][1] = max(z, cut[-1][1])
                        else:
                            cut.append([a, z])
                    edges = [0, *[x for c in cut for x in c], len(t)]
                    kept.append(b"".join(t[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                    n_bytes.append(len(t)), n_gone.append(len(t) - len(kept[-1])), spans.append([{"start": a, "end": z} for a, z in cut])
                yield pa.record_batch([part["doc_id"], pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(spans, span)], names=["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(marks.hint("merge"), ["did", "th"], "left").select("doc_id", "text", "runs").mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>")
