"""Nearest neighbours from robust-pruned graphs: one directed graph a shard, searched with a beam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

#: Vectors a shard (on average, by hash), edges a node, beam while building and searching, relaxation.
SHARD, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 4096, 24, 40, 96, 1.2
_INDEX = "dim int, shard int, vectors binary, graph binary, entries binary, owners array<array<long>>"


def usable(v: Column) -> Column:
    """False for vectors that are null, empty, zero, or hold a null, a NaN or an infinity."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def exponent(*arrays: np.ndarray) -> int:
    """The power of two over all numbers of arrays: divided by it, none is greater than 1, and squares and their sums stay in range."""
    return max(int(np.frexp(np.abs(a).max(initial=0.0))[1]) for a in arrays)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x to q in doubles, whatever their size: scaled by powers of two, which doesn't change a digit."""
    diff = x - q
    by = np.frexp(np.abs(diff).max(axis=1, initial=0.0))[1]
    scaled = np.ldexp(diff, -by[:, None])
    return np.ldexp(np.sqrt((scaled**2).sum(axis=1)), by)


def square_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of each q (m, d) to its own x (m, k, d)."""
    return np.einsum("mkd,mkd->mk", d := x - q[:, None, :], d)


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances (m, beam; -1 and infinity where fewer were met) of the nearest that a greedy search meets.

    The searches of all queries go on together: each step opens the `wide` nearest unopened nodes of every beam.
    """
    m, n = len(q), len(x)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf)
    opened = np.zeros((m, beam), bool)
    seen = np.zeros(m * n, bool)
    stamp = np.zeros(m * n, np.int32)
    row = np.arange(m)
    new = np.broadcast_to(entries, (m, len(entries)))
    while True:
        flat = row[:, None] * n + new
        ok = (new >= 0) & ~seen[np.where(new >= 0, flat, 0)]
        flat, order = flat[ok], np.arange(int(ok.sum()), dtype=np.int32)
        stamp[flat] = order
        ok[ok] = stamp[flat] == order  # once, if two opened nodes share a neighbour
        r, c = np.nonzero(ok)
        seen[r * n + new[r, c]] = True
        far = np.full(new.shape, np.inf)
        diff = x[new[r, c]] - q[row[r]]
        far[r, c] = np.einsum("kd,kd->k", diff, diff)
        all_ids = np.concatenate([ids, np.where(ok, new, -1)], axis=1)
        all_dist = np.concatenate([dist, far], axis=1)
        all_open = np.concatenate([opened, np.zeros(new.shape, bool)], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids, dist, opened = (np.take_along_axis(a, best, axis=1) for a in (all_ids, all_dist, all_open))
        rank = np.cumsum(~opened & np.isfinite(dist), axis=1)
        go = ~opened & np.isfinite(dist) & (rank <= wide)
        if not go.any():
            return ids, dist
        opened |= go
        at = np.argsort(~go, axis=1, kind="stable")[:, :wide]
        node = np.where(np.take_along_axis(go, at, axis=1), np.take_along_axis(ids, at, axis=1), -1)
        new = np.where((node >= 0)[:, :, None], graph[node], -1).reshape(m, -1)


def robust_prune(x: np.ndarray, p: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(m, degree) out-edges of the nodes p from candidates (m, c; -1: none): the nearest, and no one that a chosen
    one is alpha times nearer to than p is."""
    m, c = ids.shape
    dist = np.where((ids < 0) | (ids == p[:, None]), np.inf, square_distances(x[p], x[ids]))
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
    v = x[ids]
    norm = np.einsum("mcd,mcd->mc", v, v)
    between = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * v @ v.transpose(0, 2, 1), 0)
    alive = np.isfinite(dist)
    alive[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    out = np.full((m, degree), -1, np.int64)
    row = np.arange(m)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, k] = ids[row, first][some]
        alive &= (alpha * alpha) * between[row, first] > dist
        alive[row, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(n, degree) out-edges (-1: none) over the vectors x, and the nodes that searches start from.

    From a random graph, each node in turn is searched for in the graph as it is; what the search meets, pruned, are
    its new edges, and each of these gets an edge back, pruned where there are too many. Twice: with no relaxation,
    and with alpha. The same vectors in the same order give the same graph. Squares of the numbers have to be in range.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    entries = np.unique(np.concatenate([[int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())], rng.integers(0, n, 15)]))
    graph = rng.integers(0, n, (n, degree))
    graph[graph == np.arange(n)[:, None]] = -1
    if n <= 2:
        return np.array([[j if j != i else -1 for j in range(n)] + [-1] * (degree - n) for i in range(n)], np.int64).reshape(n, -1), entries
    for relaxed in (1.0, alpha):
        for p in np.array_split(rng.permutation(n), -(-n // 256)):
            met, _ = beam_search(x, graph, entries, x[p], beam)
            graph[p] = robust_prune(x, p, np.concatenate([met, graph[p]], axis=1), degree, relaxed)
            source, target = np.repeat(p, degree), graph[p].reshape(-1)
            source, target = source[target >= 0], target[target >= 0]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            nodes, at, n_new = np.unique(target, return_index=True, return_counts=True)
            # the edges back, a row a node; of very many the nearest are weighed
            width = 2 * degree
            place = np.arange(len(target)) - np.repeat(at, n_new)
            back = np.full((len(nodes), max(int(n_new.max()), 1)), -1, np.int64)
            back[np.repeat(np.arange(len(nodes)), n_new), place] = source
            if back.shape[1] > width:
                far = np.where(back < 0, np.inf, square_distances(x[nodes], x[back]))
                back = np.take_along_axis(back, np.argsort(far, axis=1, kind="stable")[:, :width], axis=1)
            both = np.concatenate([graph[nodes], back], axis=1)
            graph[nodes] = robust_prune(x, nodes, both, degree, relaxed)
    return graph, entries


def build_index(rows: DataFrame, copies: int, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """One row a shard: its vectors, graph, entries, and the ids of each vector.

    Equal vectors are one node with its `copies` smallest ids: no more of them can be among copies - 1 results, as ties
    go to smaller ids. Every usable row with an id is indexed; vectors of each length have shards of their own.
    """
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + 0.0)
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull()).distinct()
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("k") <= copies)
    nodes = written(rows.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v")), "vectors")
    counts = nodes.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("long").alias("shards"))
    nodes = nodes.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ids", key=lambda s: s.map(lambda x: x[0]), ignore_index=True)
        x = np.stack(part["v"].to_numpy())
        graph, entries = build_graph(np.ldexp(x, -exponent(x)))
        return pd.DataFrame({"dim": [part["dim"][0]], "shard": [part["shard"][0]], "vectors": [x.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "entries": [entries.astype(np.int32).tobytes()], "owners": [list(part["ids"])]})

    # a task a shard: shards are few and take seconds each
    shards = max(1, int(counts.agg(F.sum("shards")).first()[0] or 0))
    nodes = nodes.repartition(max(shards, shuffle_partitions(rows.sparkSession)), "dim", "shard")
    return written(nodes.select("dim", "shard", "v", "ids").groupBy("dim", "shard").applyInPandas(build, _INDEX), "index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "vec_id", vector: str = "embedding", beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: of every usable query the k nearest that the beam searches of all shards find.

    A query never finds rows of its own id. Ties go to the smaller id; score is the Euclidean distance in doubles.
    A shard moves once, and all queries are read past it; what a shard finds for a query is k rows at most. Queries that are null, zero
    or hold a null or a number that isn't finite are left out; a query of a length that no shard has finds nothing;
    repeated queries count once.
    """
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + 0.0)
    q = queries.select(F.col(query_id).cast("long").alias("id"), v.alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull()).distinct()
    q = q.select("id", "v", F.xxhash64("v").alias("vh"), F.size("v").alias("dim"))
    shards = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    to = q.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    # each shard once, and behind it the queries, which go past it in batches
    both = index.withColumn("query", F.lit(False)).unionByName(to.select("dim", "shard", "id", "v", "vh", F.lit(True).alias("query")), allowMissingColumns=True)
    parts = max(shuffle_partitions(q.sparkSession), index.count())
    both = both.repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "query").select("query", "dim", "shard", "vectors", "graph", "entries", "owners", "id", "vh", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = graph = entries = owners = scaled = None
        power = 0
        for batch in batches:
            kind = batch["query"].to_numpy(zero_copy_only=False)
            place = batch["dim"].to_numpy(zero_copy_only=False).astype(np.int64) << 32 | batch["shard"].to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((kind[1:] != kind[:-1]) | (place[1:] != place[:-1])) + 1
            for i, j in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
                if i == j:
                    continue
                if not kind[i]:
                    x = np.frombuffer(batch["vectors"][i].as_py()).reshape(-1, batch["dim"][i].as_py())
                    graph = np.frombuffer(batch["graph"][i].as_py(), np.int32).reshape(len(x), -1).astype(np.int64)
                    entries, owners = np.frombuffer(batch["entries"][i].as_py(), np.int32).astype(np.int64), batch["owners"][i].as_py()
                    power = exponent(x)
                    scaled = np.ldexp(x, -power)
                    continue
                for at in range(i, j, 256):
                    part = batch.slice(at, min(256, j - at))
                    ids, vs = part["id"].to_pylist(), part["v"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    if (larger := exponent(vs)) > power:
                        power, scaled = larger, np.ldexp(x, -larger)
                    near, _ = beam_search(scaled, graph, entries, np.ldexp(vs, -power), max(beam, 2 * k))
                    out: tuple[list, list, list, list] = ([], [], [], [])
                    for own, vh, q_, found in zip(ids, part["vh"].to_pylist(), vs, near, strict=True):
                        found = found[found >= 0]
                        score = distances(x[found], q_)
                        rows = sorted((s, o) for s, f in zip(score.tolist(), found.tolist(), strict=True) for o in owners[f] if o != own)[:k]
                        out[0].extend([own] * len(rows)), out[1].extend([vh] * len(rows)), out[2].extend(o for _, o in rows), out[3].extend(s for s, _ in rows)
                    yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], names=["query_id", "vh", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vh long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "vh").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """search() of the rows whose vec_id can be divided by `every`, against every other row of the same table."""
    return search(build_index(rows, k + 1), rows.where(F.col("vec_id") % every == 0), k)
