"""SimHash fingerprints and their near pairs, found by a binary trie joined with itself."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import fresh, shuffle_partitions, written
from .components import components

#: Fingerprints of one piece of a trie: pairs of pieces are what one step of a task joins.
PIECE = 4096
#: Fingerprints that share the first bits of a trie, about, at most.
CROWD = 64
SEED = 42
#: Bands of a sketch and least hashes in each: of pairs of a similarity of 0.8, 1 - (1 - 0.8**4)**24 (all but 3 in a million) share a band's key.
BANDS, ROWS = 24, 4
#: Texts up to which those of one band's key are compared with more than two of them, and slots that they are dealt into.
SMALL, SLOTS = 64, 16
#: Texts, about, of one piece of a band, of which pairs are compared at once; and columns of the table in which they are.
TEXTS, COLUMNS = 128, 4096


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash over the shingles of `words` words of a text; fewer words are one shingle, none give 0."""
    w = text.lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) < words:
        h = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.fromiter(map(len, w), np.int64, len(w)).cumsum() + np.arange(len(w))
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest, n = xxhash.xxh64_intdigest, len(w) - words + 1
        h = [digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)]
    a = np.array(h, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(a), 16_384):
        ones += np.unpackbits(a[i : i + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(a), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, bands: bool = False) -> DataFrame:
    """doc_id, th (hash of the text, null as empty), fp (the 64 bits as a long) of every row of docs, and with bands, the
    text's sketch (none where it has fewer than `words` words); letters A-Z count as a-z; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b["text"].cast(pa.binary()).to_pylist()
            out = [b["doc_id"], b["th"], pa.array(np.array([fingerprint(t, words) for t in data], np.uint64).view(np.int64))]
            if bands:
                out.append(pa.array([sketch(s).view(np.int64) if len(s) else None for s in (shingles(t, words) for t in data)], pa.list_(pa.int64())))
            yield pa.record_batch(out, names=["doc_id", "th", "fp", "bands"][: len(out)])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long" + ", bands array<long>" * bands)


def trie_join(a: np.ndarray, b: np.ndarray | None, bits: int, depth: int = 0, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of a and b (sorted uint64; None: a with itself, each pair once) that differ in `bits` or fewer.

    Pairs of trie nodes go down together, bit by bit from depth, up to which all of a and b agree or differ alike; the
    bits in which their paths differ are counted, and a pair of nodes ends where the count is over the budget. Nodes
    with few leaves are compared leaf by leaf. With cuts (places in a), the nodes between two cuts, which agree up to
    depth, each start with themselves, and nothing is compared over a cut.
    """
    same = b is None
    b = a if same else b
    lo_a, hi_a = (np.array([0]), np.array([len(a)])) if cuts is None else (cuts[:-1], cuts[1:])
    lo_b, hi_b = (lo_a, hi_a) if same else (np.array([0]), np.array([len(b)]))
    top = np.uint64(a[0] ^ b[0]) >> np.uint64(64 - depth) if depth else np.uint64(0)
    diff = np.full(len(lo_a), 0 if same else int(top).bit_count())
    found_a, found_b = [], []
    for bit in range(63 - depth, -1, -1):
        small = ((hi_a - lo_a) * (hi_b - lo_b) <= 16) & (diff <= bits)
        if small.any():
            x, y = _leaves(lo_a[small], hi_a[small], lo_b[small], hi_b[small])
            near = np.bitwise_count(a[x] ^ b[y]) <= bits
            found_a.append(x[near]), found_b.append(y[near])
        go = ~small & (diff <= bits)
        lo_a, hi_a, lo_b, hi_b, diff = lo_a[go], hi_a[go], lo_b[go], hi_b[go], diff[go]
        if not len(diff):
            break
        one, mask = np.uint64(1 << bit), np.uint64((1 << 64) - (2 << bit) if bit < 63 else 0)
        mid_a, mid_b = (_middle(v, lo, hi, (v[lo] & mask) | one) for v, lo, hi in ((a, lo_a, hi_a), (b, lo_b, hi_b)))
        kids = [(lo_a, mid_a, lo_b, mid_b, diff), (mid_a, hi_a, mid_b, hi_b, diff), (lo_a, mid_a, mid_b, hi_b, diff + 1), (mid_a, hi_a, lo_b, mid_b, diff + 1)]
        if same:  # of a node with itself, one of the two mixed pairs
            kids[3] = tuple(x[lo_a != lo_b] for x in kids[3])
        lo_a, hi_a, lo_b, hi_b, diff = (np.concatenate(x) for x in zip(*kids, strict=True))
        full = (lo_a < hi_a) & (lo_b < hi_b) & (diff <= bits)
        lo_a, hi_a, lo_b, hi_b, diff = lo_a[full], hi_a[full], lo_b[full], hi_b[full], diff[full]
    if len(diff):  # the last bit is behind: equal but for diff
        x, y = _leaves(lo_a, hi_a, lo_b, hi_b)
        found_a.append(x), found_b.append(y)
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (found_a, found_b))
    if same:
        x, y = x[x < y], y[x < y]
    return x, y


def _middle(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The first place in each lo..hi of v with `value` at least: v is sorted in each, not as a whole."""
    lo, hi = lo.copy(), hi.copy()
    while len(at := np.flatnonzero(lo < hi)):
        mid = (lo[at] + hi[at]) // 2
        less = v[mid] < value[at]
        lo[at[less]] = mid[less] + 1
        hi[at[~less]] = mid[~less]
    return lo


def trie_pairs(a: np.ndarray, b: np.ndarray | None, bits: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """trie_join() in pieces of a, so that the node pairs of a larger budget stay in memory."""
    step = 4096 if bits <= 2 else 512
    found = []
    for i in range(0, len(a), step):
        piece = a[i : i + step]
        if b is not None:
            x, y = trie_join(piece, b, bits, depth)
            found.append((x + i, y))
            continue
        x, y = trie_join(piece, None, bits, depth)
        found.append((x + i, y + i))
        if i + step < len(a):
            x, y = trie_join(piece, a[i + step :], bits, depth)
            found.append((x + i, y + i + step))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _leaves(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of leaves of each pair of nodes."""
    n_b = hi_b - lo_b
    n = (hi_a - lo_a) * n_b
    k = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
    each = np.repeat(n_b, n)
    return np.repeat(lo_a, n) + k // each, np.repeat(lo_b, n) + k % each


def spanning(nodes: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node that each of the nodes is linked with, over any number of links."""
    root = np.arange(nodes)
    while len(x):
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    return root


def tries(bits: int, n: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bits in front, blocks as (shift, width) in their new order) of the tries in which every pair that differs in `bits` bits or
    fewer agrees in front in one at least: the 64 bits are cut into blocks, of which such a pair has all but `bits` alike.

    There are as few blocks as leave about CROWD of n even fingerprints that agree in front.
    """
    blocks = next((m for m in range(bits + 1, 16) if (n / CROWD) <= 2.0 ** (64 * (m - bits) // m)), 16)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    cut = list(zip(edges, np.diff(edges).tolist()))
    out = []
    for front in combinations(range(blocks), blocks - bits):
        order = [*front, *[k for k in range(blocks) if k not in front]]
        out.append((sum(cut[k][1] for k in front), [cut[k] for k in order]))
    return out


def _turned(fp: Column, order: list[tuple[int, int]]) -> Column:
    """The blocks of fp in another order, the first at the top."""
    out, at = F.lit(0).cast("long"), 64
    for shift, width in order:
        at -= width
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)), at))
    return out


def _turned_back(v: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out, at = np.zeros(len(v), np.uint64), 64
    for shift, width in order:
        at -= width
        out |= ((v >> np.uint64(at)) & np.uint64((1 << width) - 1)) << np.uint64(shift)
    return out


def near_pairs(fps: DataFrame, bits: int = 2, forest: bool = False) -> DataFrame:
    """a, b (fp of a below fp of b, as unsigned): all pairs of the distinct longs `fp` that differ in 1 to `bits` bits.

    Each trie (see tries()) has the bits in another order. Spark brings together what agrees in front, and below that,
    pairs of nodes go down together (trie_join). Of a node with many fingerprints Spark deals out pairs of pieces.
    With forest, links are thinned to those that keep fingerprints connected; no connection is lost.
    """
    spark = fps.sparkSession
    distinct = written(fps.select("fp").where("fp is not null").distinct(), "fingerprints")
    made = tries(bits, distinct.count())
    tagged = [F.struct(F.lit(k).alias("trie"), F.shiftrightunsigned(_turned(F.col("fp"), order), 64 - front).alias("path"), _turned(F.col("fp"), order).alias("v")) for k, (front, order) in enumerate(made)]
    rows = distinct.select(F.explode(F.array(*tagged)).alias("t")).select("t.*")
    several = written(rows.groupBy("trie", "path").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
    rows = rows.join(several.hint("merge"), ["trie", "path"]).withColumn("pieces", F.ceil(F.col("n") / PIECE))
    whole = rows.where("pieces = 1").groupBy("trie", "path").agg(F.collect_list("v").alias("v"))

    def links(trie: int, v: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        if forest:
            root = spanning(len(v), x, y)
            y = np.flatnonzero(root != np.arange(len(v)))
            x = root[y]
        p, q = (_turned_back(v[z], made[trie][1]) for z in (x, y))
        if len(p):
            yield pa.record_batch([pa.array(np.minimum(p, q).view(np.int64)), pa.array(np.maximum(p, q).view(np.int64))], names=["a", "b"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b["trie"].to_numpy(zero_copy_only=False)
            size = b["v"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            v = b["v"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            node = np.repeat(np.arange(len(size)), size)
            v, ends = v[np.lexsort((v, node))], np.cumsum(size)
            i = 0
            while i < len(size):  # nodes of one trie, some thousand fingerprints of them at a time
                first, j = ends[i] - size[i], i + 1
                while j < len(size) and kind[j] == kind[i] and ends[j] - first <= PIECE:
                    j += 1
                part = v[first : ends[j - 1]]
                yield from links(int(kind[i]), part, *trie_join(part, None, bits, made[kind[i]][0], np.concatenate([[0], ends[i:j] - first])))
                i = j

    pieces = rows.where("pieces > 1").withColumn("piece", F.pmod(F.xxhash64("v"), F.col("pieces"))).groupBy("trie", "path", "piece").agg(F.collect_list("v").alias("v"))
    pieces = written(pieces, "pieces")
    other = pieces.select("trie", "path", F.col("piece").alias("piece_b"), F.col("v").alias("w"))
    met = pieces.hint("shuffle_merge").join(other, ["trie", "path"]).where("piece_b >= piece").repartition(shuffle_partitions(spark))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                trie = b["trie"][k].as_py()
                one, two = (np.sort(b[c][k].values.to_numpy(zero_copy_only=False).view(np.uint64)) for c in ("v", "w"))
                if b["piece"][k] == b["piece_b"][k]:
                    yield from links(trie, one, *trie_pairs(one, None, bits, made[trie][0]))
                else:
                    x, y = trie_pairs(one, two, bits, made[trie][0])
                    yield from links(trie, np.concatenate([one, two]), x, y + len(one))

    found = whole.mapInArrow(within, "a long, b long").union(met.select("trie", "piece", "piece_b", "v", "w").mapInArrow(across, "a long, b long"))
    return found if forest else found.distinct()


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of the shingles of `words` words of a text, in order; none where it has fewer words."""
    w = text.lower().split()
    if len(w) < words:
        return np.zeros(0, np.uint64)
    h = rolling.words(b" ".join(w))[2]
    i = np.arange(len(h) - words + 1)
    return np.unique(rolling.spans(rolling.sums(h), i, i + words))


def sketch(s: np.ndarray) -> np.ndarray:
    """A key for each band of the sorted distinct hashes s: of ROWS least hashes. Sets of a Jaccard similarity j share a band's with a chance of j**ROWS.

    The hashes are cut into BANDS * ROWS bins by their upper bits, each with a least hash; an empty bin takes that of
    another, tried in an order of its own until one is not empty.
    """
    n = BANDS * ROWS
    edges = (np.arange(n, dtype=np.float64) / n * 2.0**64).astype(np.uint64)
    at = np.searchsorted(s, edges)
    filled = np.diff(np.append(at, len(s))) > 0
    donor = np.arange(n)
    for tries_ in range(1, 1 << 16):
        empty = np.flatnonzero(~filled[donor])
        if not len(empty):
            break
        donor[empty] = (rolling.mixed(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tries_)) % np.uint64(n)).astype(np.int64)
    least = s[at[donor]].reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = rolling.mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return key


def _sets(docs: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """t (hash of a text), s (the hashes of its shingles, as bytes) of the texts that named (t) names."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.record_batch([part["t"], pa.array([shingles(t, words).tobytes() for t in part["text"].cast(pa.binary()).to_pylist()], pa.binary())], names=["t", "s"])

    text = F.coalesce("text", F.lit(""))
    held = docs.select(F.xxhash64(text).alias("t"), text.alias("text")).join(named.hint("merge"), "t", "left_semi")
    return written(held.mapInArrow(sets, "t long, s binary").groupBy("t").agg(F.any_value("s").alias("s")), "sets")


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each set of a and each of b, how many members both have."""
    va, vb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(va, vb)
    held = []
    for sets, v in ((a, va), (b, vb)):
        at = np.minimum(np.searchsorted(both, v), max(0, len(both) - 1))
        hit = both[at] == v if len(both) else np.zeros(len(v), bool)
        held.append((np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit], at[hit]))
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, len(both), COLUMNS):
        x, y = (np.zeros((len(sets), min(COLUMNS, len(both) - k)), np.float32) for sets in (a, b))
        for m, (i, at) in zip((x, y), held, strict=True):
            here = (at >= k) & (at < k + COLUMNS)
            m[i[here], at[here] - k] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def other_links(docs: DataFrame, members: DataFrame, roots: DataFrame, words: int, share: float) -> DataFrame:
    """a, b: roots of texts that share a band's key, have a similarity of `share` or more and are not in one class so far.

    members: band, t (a struct of t, f) of the keys that several texts have; roots: node, root of the links so far. A key whose
    texts are all in one class needs nothing. Of another, all texts outside its largest class are compared with one another and with
    those of that class, in pairs of pieces that Spark deals out; keys with the same texts are taken once. Nothing is left out.
    """
    spark = docs.sparkSession
    m = members.select("band", F.col("t.t").alias("t"), F.col("t.f").alias("f")).join(roots.hint("merge"), F.col("f") == F.col("node"), "left")
    m = written(m.select("band", "t", F.coalesce("root", "f").alias("root")), "members")
    whole = "decimal(20,0)"
    parts = m.groupBy("band", "root").agg(F.count("*").alias("k"), F.sum(F.col("t").cast(whole)).alias("s1"), F.sum(F.xxhash64("t", F.lit(1)).cast(whole)).alias("s2"))
    several = parts.groupBy("band").agg(F.count("*").alias("classes"), F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("most"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).where("classes > 1")
    several = written(several.groupBy("n", "s1", "s2").agg(F.min(F.struct("band", "most")).alias("b")).select("b.band", "n", F.col("b.most.k").alias("k"), F.col("b.most.root").alias("largest")), "open")
    odd = F.col("root") != F.col("largest")
    pieces = F.ceil(F.when(odd, F.col("n") - F.col("k")).otherwise(F.col("k")) / TEXTS)
    rows = written(m.join(several.hint("merge"), "band").select("band", odd.alias("odd"), F.pmod(F.xxhash64("band", "t"), pieces).alias("piece"), "t", "root"), "dealt")
    held = _sets(docs, rows.select("t").distinct(), words)
    dealt = rows.join(held.hint("merge"), "t").groupBy("band", "odd", "piece").agg(F.collect_list("root").alias("r"), F.collect_list("s").alias("s"))
    dealt = written(dealt, "dealt_sets")
    left = dealt.where("odd").select("band", "piece", F.col("r").alias("r1"), F.col("s").alias("s1"))
    right = dealt.select("band", F.col("odd").alias("odd2"), F.col("piece").alias("piece2"), F.col("r").alias("r2"), F.col("s").alias("s2"))
    met = left.hint("merge").join(right, "band").where("not odd2 or piece2 >= piece").select("r1", "s1", "r2", "s2").repartition(shuffle_partitions(spark))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one, two = ([np.frombuffer(x.as_py(), np.uint64) for x in b[c][k].values] for c in ("s1", "s2"))
                r1, r2 = (b[c][k].values.to_numpy() for c in ("r1", "r2"))
                both = shared(one, two)
                size = np.array([len(x) for x in one])[:, None] + np.array([len(x) for x in two])[None, :]
                i, j = np.nonzero((both >= share * (size - both)) & (r1[:, None] != r2[None, :]))
                if len(i):
                    found = np.unique(np.stack([r1[i], r2[j]]), axis=1)
                    yield pa.record_batch([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64")  # a row holds the sets of two pieces
    try:
        return written(met.mapInArrow(compared, "a long, b long"), "other")
    finally:
        spark.conf.set(key, before)


def similar_links(docs: DataFrame, prints: DataFrame, words: int, share: float, bits: int) -> tuple[DataFrame, DataFrame]:
    """a, b: fingerprints of texts whose shingles have a Jaccard similarity of `share` or more, by their exact sets; and the
    members of the bands' keys that several texts have, for other_links(), which compares what these links leave apart.

    prints: what fingerprints() gives for docs, with bands. Candidates are the different texts that share a band's key.
    A key's texts are dealt into SLOTS slots, differently for each key; where a key has no more than SMALL texts, each is
    compared with the least and the greatest of every slot: a pair shares some ten keys, and one of them brings it together.
    In a larger one, each is compared with the least and the greatest of the key, and with its most central text, that
    whose keys have most texts altogether, from which the copies of a text were made if it is there: n texts make 3 * n
    pairs then. Left out are pairs that the trie links at `bits` bits. Texts of fewer than `words` words have no shingles here.
    """
    texts = written(prints.where("bands is not null").groupBy("th").agg(F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")), "texts")
    each = texts.select(F.struct(F.col("th").alias("t"), F.col("fp").alias("f")).alias("t"), F.explode("bands").alias("band"))
    slots = each.groupBy("band", F.pmod(F.xxhash64("band", "t.t"), F.lit(SLOTS)).alias("slot")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    ends = slots.groupBy("band").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_distinct(F.concat(F.collect_list("lo"), F.collect_list("hi"))).alias("all")).where("n > 1")
    ends = written(ends.select("band", "n", F.when(F.col("n") <= SMALL, F.col("all")).otherwise(F.array("lo", "hi")).alias("others")), "ends")
    members = written(each.join(ends.select("band", "n").hint("merge"), "band"), "band_members")
    crowd = members.where(F.col("n") > SMALL)
    weight = crowd.groupBy(F.col("t").alias("m")).agg(F.sum("n").alias("weight"))
    heads = written(crowd.join(weight.hint("merge"), F.col("t") == F.col("m")).groupBy("band").agg(F.max(F.struct("weight", "t"))["t"].alias("o")), "heads")
    met = members.drop("n").join(ends.hint("merge"), "band").select("t", F.explode("others").alias("o")).union(crowd.join(heads.hint("merge"), "band").select("t", "o"))
    met = met.where((F.col("t") != F.col("o")) & (F.bit_count(F.col("t.f").bitwiseXOR(F.col("o.f"))) > bits))
    pairs = written(met.select(F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y")).distinct().select(F.col("x.t").alias("x"), F.col("x.f").alias("a"), F.col("y.t").alias("y"), F.col("y.f").alias("b")), "candidates")
    named = written(pairs.select(F.explode(F.array("x", "y")).alias("t")).distinct(), "candidate_texts")
    held = _sets(docs, named, words)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for p, q in zip(b["p"], b["q"], strict=True):
                u, v = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(both >= share * (len(u) + len(v) - both))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(held.select(F.col("t").alias("x"), F.col("s").alias("p")).hint("merge"), "x")
    two = one.join(held.select(F.col("t").alias("y"), F.col("s").alias("q")).hint("merge"), "y")
    return two.select("a", "b", "p", "q").mapInArrow(confirm, "a long, b long"), members


def _classes(docs: DataFrame, words: int, bits: int, share: float | None) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of docs, and fp, root: the least fingerprint (as a long) that is linked with each over any number of links."""
    prints = written(fingerprints(docs, words, share is not None), "simhash")
    links = near_pairs(prints, bits, forest=True)
    if share is not None:
        similar, members = similar_links(docs, prints, words, share, bits)
        links = links.union(written(similar, "similar"))
    roots = components(links)  # node, root
    if share is not None:
        more = components(other_links(docs, members, roots, words, share)).select(F.col("node").alias("r"), F.col("root").alias("over"))
        nodes = roots.union(more.select(F.col("r").alias("node"), F.col("r").alias("root"))).distinct()  # of texts without a link before, too
        roots = written(nodes.join(more, F.col("root") == F.col("r"), "left").select("node", F.coalesce("over", "root").alias("root")), "roots")
    ids = prints.select("fp").distinct().join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return prints.select("doc_id", "th", "fp"), written(ids, "classes")


def near_classes(docs: DataFrame, words: int = 3, bits: int = 2, share: float | None = None) -> DataFrame:
    """doc_id, fp, component_id: the class of every row of docs over links of `bits` differing bits or fewer, and with
    share, of texts of a similarity of `share` or more (similar_links).

    component_id is the smallest doc_id of the class; rows without words have fingerprint 0 and are linked like any
    other; a class of null ids alone has a null component_id; repeated rows are returned as often as they come; an
    empty table gives an empty result. Other columns of docs are not read.
    """
    prints, ids = _classes(docs, words, bits, share)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = ids.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(ids.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, words: int = 3, bits: int = 2, share: float | None = None) -> DataFrame:
    """docs with one row of each class: that with the smallest doc_id (null last), then with the least hash of its text;
    of rows alike in both, any one. All columns of docs are kept."""
    prints, ids = _classes(docs.select("doc_id", "text"), words, bits, share)
    one = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"))
    keep = ids.join(one, "fp").groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.th").alias("_th"))
    times = prints.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.count("*").alias("_n"))
    keep = written(keep.join(times, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t"))).select("_id", "_th", "_n"), "kept")
    th = fresh("th", [*docs.columns, "_id", "_th"])
    rows = docs.withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    own = lambda k: (rows[th] == k["_th"]) & rows["doc_id"].cast("long").eqNullSafe(k["_id"])
    single, repeated = keep.where("_n = 1"), keep.where("_n > 1")
    out = rows.join(keep, own(keep), "left_semi")
    if not repeated.isEmpty():  # rows alike in id and text: one of them stays
        out = rows.join(single, own(single), "left_semi").union(rows.join(repeated, own(repeated), "left_semi").dropDuplicates(["doc_id", th]))
    return out.select(*docs.columns)


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
