"""Removal of runs of lines that stand earlier, found by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import keyed, written

#: Lines of a run at least: each run of so many lines has a fingerprint.
RUN = 2


def lines(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The lines of a text, the numbers of those that aren't blank, and the hashes of these without white space around."""
    every = text.split(b"\n")
    bare = [x.strip() for x in every]
    ink = [i for i, x in enumerate(bare) if x]
    return every, np.array(ink, np.int64), np.array([xxhash.xxh64_intdigest(bare[i]) for i in ink], np.uint64)


def fingerprints(rows: DataFrame, run: int) -> DataFrame:
    """did, th, h, windows (k1, k2, first): the least line hash of each window of `run` lines, and the windows that chose it.

    Equal windows choose equal lines, so that a run of `run` lines never goes without a fingerprint. A window is its
    fingerprint extended to both sides; k1, k2 are the 128 bits of all its lines.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32())]))
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for d, th, t in zip(part["did"].to_pylist(), part["th"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                    _, _, h = lines(t)
                    place, first, after = rolling.runs(rolling.least_of(h, run))
                    if not len(place):
                        continue
                    p = np.arange(len(h) - run + 1)
                    k1, k2 = (rolling.spans(rolling.sums(h, k), p, p + run, k).view(np.int64).tolist() for k in (0, 1))
                    out[0].extend([d] * len(place)), out[1].extend([th] * len(place)), out[2].extend(h[place].view(np.int64).tolist())
                    out[3].extend([{"k1": k1[j], "k2": k2[j], "first": j} for j in range(a, z)] for a, z in zip(first.tolist(), after.tolist(), strict=True))
                if out[0]:
                    yield pa.record_batch([*[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], window)], names=["did", "th", "h", "windows"])

    return rows.select("did", "th", "text").mapInArrow(make, "did long, th long, h long, windows array<struct<k1:long,k2:long,first:int>>")


def drop_repeats(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, text (without the lines that went), n_lines, n_removed, spans of every row of docs.

    Lines are cut at line feeds and compared without white space around them; blank ones count for nothing and stay.
    A line goes if a run of `run` lines (blank ones passed over) over it also starts earlier: in a smaller doc_id
    (null first, equal ids by a hash of the text), or further up in the same text. Runs are judged on the input.
    n_lines: lines that aren't blank; spans: [start, end) among these. Null texts have no lines; rows alike in id and
    text are one document, and get the same answer; an empty table gives an empty result. Other columns are not read.
    """
    rows = keyed(docs)
    found = written(fingerprints(rows, run), "fingerprints")
    twice = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    windows = found.join(twice.hint("merge"), "h").select("did", "th", F.explode("windows").alias("w")).select("did", "th", "w.k1", "w.k2", "w.first")
    windows = written(windows, "windows")
    earliest = windows.groupBy("k1", "k2").agg(F.min(F.struct("did", "th", "first")).alias("e"), F.count("*").alias("n")).where("n > 1")
    earliest = written(earliest.select("k1", "k2", "e"), "earliest")  # on its own, so that the join's hot keys can be split
    later = windows.join(earliest.hint("merge"), ["k1", "k2"]).where(F.struct("did", "th", "first") > F.col("e"))
    marks = written(later.groupBy("did", "th").agg(F.collect_set("first").alias("firsts")), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts, counts, gone, spans = [], [], [], []
                for t, firsts in zip(part["text"].cast(pa.binary()).to_pylist(), part["firsts"].to_pylist(), strict=True):
                    every, ink, _ = lines(t)
                    under = np.zeros(len(ink) + 1, np.int64)
                    for f in firsts or ():
                        under[f] += 1
                        under[f + run] -= 1
                    off = np.concatenate([[0], under.cumsum()[:-1] > 0, [0]]).astype(np.int8)
                    out = set(ink[off[1:-1] > 0].tolist())
                    turn = np.flatnonzero(np.diff(off))
                    texts.append(b"\n".join(x for j, x in enumerate(every) if j not in out).decode() if out else t.decode())
                    counts.append(len(ink)), gone.append(len(out)), spans.append([{"start": a, "end": z} for a, z in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)])
                yield pa.record_batch([part["doc_id"], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span)], names=["doc_id", "text", "n_lines", "n_removed", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(marks.hint("merge"), ["did", "th"], "left").select("doc_id", "text", "firsts").mapInArrow(cut, f"doc_id {kind}, text string, n_lines long, n_removed long, spans array<struct<start:int,end:int>>")
