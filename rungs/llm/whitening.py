"""Whitening of embeddings by exact principal components: integer scatter, its characteristic polynomial, roots and null spaces."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal, localcontext
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

SCALE, SHIFT = 1024, 100_000
#: Largest whole number that an entry can become, either way.
_MOST = 2**62
#: Bits of a limb and rows of a product of limbs: sums of products stay under 2^53, where doubles are exact.
_LIMB, _ROWS = 18, 1 << 16
#: Bits to which a root is known, of its size; decimal digits of the search for its null space beyond those of the scatter.
_ROOT_BITS, _DIGITS = 192, 90
_SUMS = "dim int, i int, j int, shift int, value long"


def usable(vector) -> F.Column:
    """False for vectors that are null, empty, or hold a null, a NaN or an infinity."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 of every entry, as long; entries beyond 2^62 stay there."""
    return np.clip(np.floor(vectors * float(SCALE)), -float(_MOST), float(_MOST)).astype(np.int64) + SHIFT


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as numbers of 18 bits, the last with a sign, from the lowest on."""
    out = []
    while len(x) and max(int(x.max()), -int(x.min())) > 1 << _LIMB:
        out.append(x & ((1 << _LIMB) - 1))
        x = x >> _LIMB
    return [*out, x]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, places in the batch and vectors, a length at a time."""
    column = batch["v"]
    size = np.diff(column.offsets.to_numpy())
    flat, start = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield n, at, flat[start[at][:, None] + np.arange(n)]


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each length: the number of rows (i = j = -1), sums of entries (j = -1) and of products (j <= i), in limbs."""
    held: dict[tuple[int, int], np.ndarray] = {}
    rows = 0

    def out() -> pa.RecordBatch:
        parts = []
        for (n, shift), sums in held.items():
            i, j = np.tril_indices(n + 1)
            some = sums[i, j] != 0
            parts.append(pd.DataFrame({"dim": n, "i": i[some] - 1, "j": j[some] - 1, "shift": shift, "value": sums[i, j][some]}))
        held.clear()
        frame = pd.concat(parts)
        return pa.record_batch([pa.array(frame[c].to_numpy(), t) for c, t in (("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("shift", pa.int32()), ("value", pa.int64()))], names=["dim", "i", "j", "shift", "value"])

    for batch in batches:
        for n, _, vectors in _by_length(batch):
            for at in range(0, len(vectors), _ROWS):
                parts = limbs(whole(vectors[at : at + _ROWS]))
                one = np.ones((len(parts[0]), 1))
                parts = [np.concatenate([one * (t == 0), p], axis=1) for t, p in enumerate(parts)]  # a column of ones gives the sums
                for s, a in enumerate(parts):
                    for t, b in enumerate(parts):
                        product = (a.T @ b).astype(np.int64)
                        key = (n, _LIMB * (s + t))
                        held[key] = held[key] + product if key in held else product
        rows += batch.num_rows
        if rows >= 1 << 25:  # long before sums of 2^37 a product leave a long
            yield out()
            rows = 0
    if held:
        yield out()


def scatters(rows: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """For each length of vectors in rows (v): their number n, S (sums), and n * sum(x x') - S S', all exact.

    Each task sums its rows; what reaches the driver is one number for each pair of dimensions.
    """
    sums = rows.mapInArrow(_partial_sums, _SUMS).groupBy("dim", "i", "j", "shift").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found: dict[int, dict[tuple[int, int], int]] = {}
    for r in sums.collect():
        at = found.setdefault(r.dim, {})
        at[r.i, r.j] = at.get((r.i, r.j), 0) + (int(r.value) << r.shift)
    out = {}
    for dim, at in found.items():
        n = at[-1, -1]
        s = [at.get((i, -1), 0) for i in range(dim)]
        m = [[n * at.get((max(i, j), min(i, j)), 0) - s[i] * s[j] for j in range(dim)] for i in range(dim)]
        out[dim] = n, s, m
    return out


def primes(more_than: int) -> list[int]:
    """Primes below 2^31, the largest first, whose product exceeds a number."""
    out, product, p = [], 1, 2**31 - 1
    while product <= more_than:
        if all(pow(a, p - 1, p) == 1 and _witnessed(a, p) for a in (2, 3, 5, 7)):  # enough below 3.2e9
            out.append(p)
            product *= p
        p -= 2
    return out


def _witnessed(a: int, p: int) -> bool:
    d, twos = p - 1, 0
    while d % 2 == 0:
        d, twos = d // 2, twos + 1
    x = pow(a, d, p)
    return x in (1, p - 1) or any((x := x * x % p) == p - 1 for _ in range(twos - 1))


def polynomial_modulo(a: np.ndarray, p: int) -> list[int]:
    """Coefficients (of 1, x, x^2, ...) of det(x - a) modulo p: a is brought to Hessenberg form, whose minors follow one another."""
    a, n = a.copy() % p, len(a)
    for k in range(1, n - 1):
        below = np.flatnonzero(a[k:, k - 1])
        if not len(below):
            continue
        i = k + int(below[0])
        a[[k, i]] = a[[i, k]]
        a[:, [k, i]] = a[:, [i, k]]
        u = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - u[:, None] * a[k] % p) % p
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * u % p).sum(axis=1)) % p
    minors = np.zeros((n + 1, n + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, n + 1):
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - a[k - 1, k - 1] * minors[k - 1] % p) % p
        path = 1
        for i in range(k - 1, 0, -1):
            path = path * int(a[i, i - 1]) % p
            if not path:
                break
            minors[k] = (minors[k] - int(a[i - 1, k - 1]) * path % p * minors[i - 1] % p) % p
    return minors[n].tolist()


def characteristic_polynomial(spark, m: list[list[int]]) -> list[int]:
    """Coefficients of det(x - m), exact, of a symmetric matrix of integers without negative eigenvalues.

    A Spark job takes the polynomial modulo enough primes, a prime a row; Chinese remainders make it whole. The
    coefficients' sizes are elementary symmetric sums of the eigenvalues, at most those of d times their mean.
    """
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    mean = -(-trace // d)
    moduli = primes(2 * max(comb(d, k) * mean**k for k in range(d + 1)))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [polynomial_modulo(np.array([[x % p for x in row] for row in m], np.int64), p) for p in batch["p"].tolist()]
            yield pd.DataFrame({"p": batch["p"], "coefficients": found})

    rows = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(min(len(moduli), shuffle_partitions(spark)))
    of = {r.p: r.coefficients for r in rows.mapInPandas(each, "p long, coefficients array<long>").collect()}
    whole_, product = [0] * (d + 1), 1
    for p in moduli:
        inverse = pow(product, -1, p)
        whole_ = [c + product * ((r - c) * inverse % p) for c, r in zip(whole_, of[p], strict=True)]
        product *= p
    return [c - product if c > product // 2 else c for c in whole_]


def roots_above(c: list[int], a: int, bits: int) -> int:
    """How many roots of the polynomial c, all of them real, are greater than a / 2^bits: the sign changes of c(x + a)."""
    d = len(c) - 1
    b = [x << bits * (d - k) for k, x in enumerate(c)]  # of 2^bits x
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            b[k] += a * b[k + 1]
    signs = [x > 0 for x in b if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _positive(c: list[int], a: int, bits: int) -> int:
    """The sign of c at a / 2^bits."""
    value = 0
    for k, x in enumerate(reversed(c)):
        value = value * a + (x << bits * k)
    return (value > 0) - (value < 0)


def largest_roots(c: list[int], most: int) -> list[tuple[int, int]]:
    """The largest positive roots of a polynomial of real roots, at most `most`, falling, each as often as it occurs: a and bits, for a / 2^bits.

    An interval is halved until it holds one root, by counts of sign changes (exact where all roots are real), and
    then by the sign of c alone, until its width is 2^-192 of the root. Roots that are no further apart stay together.
    """
    degree = len(c) - 1
    most = min(most, roots_above(c, 0, 0))
    if not most:
        return []
    top = 1
    while roots_above(c, top, 0):
        top *= 2
    out: list[tuple[int, int]] = []
    # low, high, bits; number of roots above low, and above high
    todo = [(0, top, 0, roots_above(c, 0, 0), 0)]
    while todo:
        low, high, bits, many, before = todo.pop()
        if before >= most or many == before:
            continue
        if low and (high - low) << _ROOT_BITS <= low:
            out += [(low + high, bits + 1)] * (many - before)
            continue
        if many - before == 1 and low and (at_high := _positive(c, high, bits)):
            while (high - low) << _ROOT_BITS > low:
                middle, bits = low + high, bits + 1
                low, high = (middle, 2 * high) if _positive(c, middle, bits) != at_high else (2 * low, middle)
            out.append((low + high, bits + 1))
            continue
        middle, bits = low + high, bits + 1
        half = roots_above(c, middle, bits)
        todo += [(2 * low, middle, bits, many, half), (middle, 2 * high, bits, half, before)]
    return out[:most]


def null_vectors(m: list[list[int]], roots: list[tuple[int, int]]) -> list[list[Decimal]]:
    """Unit vectors v with m v = root v, at right angles: inverse iteration in decimals of many digits.

    Each starts from whole numbers that a fixed rule gives, is set at right angles to those before it, and is solved
    for twice; equal roots get different vectors of their null space.
    """
    d = len(m)
    out: list[list[Decimal]] = []
    digits = len(str(max(abs(x) for row in m for x in row))) + _DIGITS
    with localcontext(Context(prec=digits, Emax=10**9, Emin=-(10**9))):
        for number, (a, bits) in enumerate(roots):
            root = Decimal(a) / Decimal(1 << bits)
            rows = np.array([[Decimal(m[i][j]) - (root if i == j else 0) for j in range(d)] for i in range(d)], object)
            steps = _factors(rows, root)
            v = np.array([Decimal((7919 * (i + 1) * (i + 2 + number) + 104729 * number) % 65537 - 32768) for i in range(d)], object)
            for _ in range(3):
                v = _unit(_square(v, out))
                v = _solved(rows, steps, v)
            out.append(list(_unit(_square(_unit(v), out))))
    return out


def _square(v: np.ndarray, others: list[list[Decimal]]) -> np.ndarray:
    for w in others:
        w = np.array(w, object)
        v = v - w * (v * w).sum()
    return v


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / max(abs(x) for x in v)
    return v / (v * v).sum().sqrt()


def _factors(a: np.ndarray, root: Decimal) -> list[int]:
    """Turns a into the factors L and U in place; the row that each step has swapped with. A pivot of zero becomes tiny."""
    swaps, tiny = [], root.scaleb(-_DIGITS)
    for k in range(len(a)):
        i = k + max(range(len(a) - k), key=lambda r: abs(a[k + r, k]))
        swaps.append(i)
        a[[k, i]] = a[[i, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - a[k + 1 :, k, None] * a[k, k + 1 :]
    return swaps


def _solved(a: np.ndarray, swaps: list[int], v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for k, i in enumerate(swaps):
        v[[k, i]] = v[[i, k]]
        v[k + 1 :] = v[k + 1 :] - a[k + 1 :, k] * v[k]
    for k in range(len(a) - 1, -1, -1):
        v[k] = (v[k] - (a[k, k + 1 :] * v[k + 1 :]).sum()) / a[k, k]
    return v


def components(spark, n: int, m: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the scatter m of n vectors: (d, k) whitening directions, so that (n x - S) @ directions is whitened; and k shares of the variance.

    k is at most `most` and the number of eigenvalues above zero. Directions are unit eigenvectors over n times the
    root of their eigenvalue; eigenvalues of the covariance are those of m over n^2.
    """
    roots = largest_roots(characteristic_polynomial(spark, m), most)
    if not roots:
        return np.zeros((len(m), 0)), np.zeros(0)
    vectors = null_vectors(m, roots)
    trace = sum(m[i][i] for i in range(len(m)))
    with localcontext(Context(prec=60, Emax=10**9, Emin=-(10**9))):
        # n * sqrt(root / n^2) is the square root of the scatter's own root
        spread = [(Decimal(a) / Decimal(1 << bits)).sqrt() for a, bits in roots]
        directions = np.array([[float(x / s) for x in v] for v, s in zip(vectors, spread, strict=True)])
        return directions.T, np.array([float(Fraction(a, (1 << bits) * trace)) for a, bits in roots])


def _deviations(x: np.ndarray, n: int, s: list[int]) -> tuple[np.ndarray, list[int]]:
    """n x - S as doubles, and the exact sums of its squares."""
    if n * max(int(np.abs(x).max()), 1) + max(map(abs, s)) < isqrt((2**63 - 1) // x.shape[1]):
        y = n * x - np.array(s, np.int64)
        return y.astype(np.float64), (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - np.array(s, object)
    return y.astype(np.float64), (y * y).sum(axis=1).tolist()


def whiten(rows: DataFrame, most: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each usable row and component.

    Vectors that are null or empty, or hold a null or a number that isn't finite, are left out. The others, as whole
    numbers x, are the fit list; vectors of each length have a list, components and an identity_error of their own.
    Components are at most `most` and only those of an eigenvalue above zero: a list of one vector, or of equal ones,
    has none, and gives no rows. Null and repeated ids and repeated rows stay, each counted. Entries beyond 2^62 /
    1024 count as 2^62. Tied eigenvalues get some orthonormal basis of their space, the same for all rows.

    Rows are read twice, without a shuffle: for the scatter, and to be whitened. The polynomial's job takes a prime a
    row. The driver gets a number for each pair of dimensions, and d + 1 a prime; nothing that grows with the rows.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")))
    kind = rows.schema["vec_id"].dataType.simpleString()
    models = {}
    for dim, (n, s, m) in scatters(rows.select("v")).items():
        directions, explained = components(spark, n, m, most)
        if len(explained):
            models[dim] = n, s, directions, explained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, vectors in _by_length(batch):
                if dim not in models:
                    continue
                n, s, directions, _ = models[dim]
                y, deviation = _deviations(whole(vectors), n, s)
                w = y @ directions
                ids = batch["vec_id"].take(pa.array(at))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.reshape(-1)))
                yield pa.record_batch([ids, pa.array(np.full(len(at), dim, np.int32)), pa.array([str(x) for x in deviation]), lists], names=["vec_id", "dim", "deviation", "w"])

    done = written(rows.mapInArrow(run, f"vec_id {kind}, dim int, deviation string, w array<double>"), "whitened")
    facts = spark.createDataFrame([(dim, n, [float(x) for x in explained]) for dim, (n, _, _, explained) in models.items()], "dim int, n long, explained array<double>")
    error = identity_error(done, most)
    out = done.join(F.broadcast(facts.join(error, "dim", "left")), "dim")  # a row a length
    out = out.select("vec_id", "n", "deviation", "w", "explained", "identity_error", F.posexplode("w").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), "n", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened", F.get("explained", F.col("k")).alias("explained"), "identity_error")


def identity_error(done: DataFrame, most: int) -> DataFrame:
    """dim, identity_error: of each length, the largest entry of the covariance of w, less the identity, without its sign."""
    means = done.groupBy("dim").agg(*[F.avg(F.get("w", F.lit(k))).alias(f"m{k}") for k in range(most)])
    centred = done.join(F.broadcast(means), "dim").select("dim", *[(F.get("w", F.lit(k)) - F.col(f"m{k}")).alias(f"c{k}") for k in range(most)])
    pairs = [(i, j) for i in range(most) for j in range(i + 1)]
    found = centred.groupBy("dim").agg(*[F.avg(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"v{i}_{j}") for i, j in pairs])
    return found.select("dim", F.greatest(F.lit(0.0), *[F.abs(F.col(f"v{i}_{j}") - F.lit(float(i == j))) for i, j in pairs]).alias("identity_error"))
