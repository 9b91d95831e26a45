from fractions import Fraction

import numpy as np
import pytest

from rungs.llm import queries, whitening


def brute(vectors, most=8):
    """n, deviations, whitened (up to signs) and shares of the variance by numpy."""
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    centred = x - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return n, deviation, centred @ u / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def whitened(spark, rows, **k):
    return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **k)


def test_query_is_what_numpy_gives(spark, data):
    given = spark.read.parquet(f"{data}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviation, want, explained = brute(np.stack(given["embedding"]))
    got = queries.op13_whitening(spark, data).toPandas().sort_values(["vec_id", "component"])
    assert got["component"].tolist() == list(range(1, 9)) * len(given)
    assert got["vec_id"].tolist() == np.repeat(given["vec_id"], 8).tolist() and set(got["n"]) == {n}
    assert got["deviation"].tolist() == np.repeat(deviation, 8).tolist()
    w = got["whitened"].to_numpy().reshape(-1, 8)
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy()[:8], explained, rtol=1e-12)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9


@pytest.mark.parametrize("p", [7, 101, 2**31 - 1])
def test_polynomial_modulo_a_prime(p):
    rng = np.random.default_rng(p)
    for d in (1, 2, 3, 6):
        a = rng.integers(-3, 4, (d, d))
        if d > 2:
            a[:, 0] = 0  # no pivot in a column
        want = [1]  # det(x - a) by the traces of powers
        power = np.eye(d, dtype=object)
        for k in range(1, d + 1):
            power = power @ a.astype(object)
            ahead = power + (np.eye(d, dtype=object) * 0)
            want.append(-Fraction(int(np.trace(ahead)), k))
            power = ahead + np.eye(d, dtype=object) * want[-1]
        assert whitening.polynomial_modulo(a.astype(np.int64), p) == [int(c) % p for c in reversed(want)]


def test_roots_with_multiplicities():
    c = [1]
    for r in (0, 3, 3, 3, 8, 10**9, 10**9, 10**9 + 1):
        c = [a - r * b for a, b in zip([0, *c], [*c, 0], strict=True)]
    roots = whitening.largest_roots(c, 6)
    assert [float(Fraction(a, 1 << b)) for a, b in roots] == [10**9 + 1, 10**9, 10**9, 8, 3, 3]
    assert len(whitening.largest_roots(c, 99)) == 7 and whitening.largest_roots([0, 0, 1], 3) == []


def test_equal_eigenvalues_and_missing_rank(spark):
    rows = [(2 * i + k, [(10.0 if k else -10.0) * (j == i) for j in range(5)] + [7.0, 7.0]) for i in range(5) for k in (0, 1)]
    got = whitened(spark, rows).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 50 and got["component"].max() == 5 and got["identity_error"].max() < 1e-12
    assert np.allclose(got["explained"], 0.2)
    w = got["whitened"].to_numpy().reshape(-1, 5)
    assert np.allclose(w.T @ w / 10, np.eye(5))


def test_close_eigenvalues_are_told_apart(spark):
    # two directions whose variances differ by a part in 10^9
    rows = [(0, [3e4, 1.0]), (1, [-3e4, 1.0]), (2, [0.0, 3e4 + 1.0]), (3, [0.0, -3e4 + 1.0]), (4, [0.0, 1 + 2**-10]), (5, [0.0, 1 - 2**-10])]
    got = whitened(spark, rows).toPandas()
    assert got["identity_error"].max() < 1e-9
    first = got[got["component"] == 1].set_index("vec_id")["whitened"]
    assert abs(first[2]) > 1.7 and abs(first[0]) < 1e-6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 5.0]), (None, [0.0, 0.5]), (2, [2.0, 5.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [4.0]), (10, [1.0, 1.0, 1.0])]
    got = whitened(spark, rows).toPandas()
    assert sorted(got["vec_id"].fillna(-1)) == [-1, -1, 1, 1, 2, 2, 2, 2, 8, 9]
    assert got.groupby(got["vec_id"].isin([8, 9]))["n"].first().tolist() == [4, 2] and got["identity_error"].max() < 1e-9
    assert whitened(spark, []).count() == 0 and whitened(spark, [(1, [3.0])]).count() == 0 and whitened(spark, [(1, [3.0, 1.0])] * 4).count() == 0


def test_entries_of_any_size(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 1e12]), (4, [5.0, -1e12])]
    got = whitened(spark, rows).toPandas()
    assert len(got) == 8 and got["identity_error"].max() < 1e-6 and np.isfinite(got["whitened"]).all()
    x = [[max(-(2**62), min(2**62, int(np.floor(v * 1024)) if abs(v) < 1e299 else int(np.sign(v)) * 2**62)) + 100000 for v in r] for _, r in rows]
    n, s, m = whitening.scatters(spark.createDataFrame([(r,) for _, r in rows], "v array<double>"))[2]
    assert n == 4 and s == [sum(r[i] for r in x) for i in (0, 1)]
    assert m == [[4 * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in (0, 1)] for i in (0, 1)]
    assert got.set_index("vec_id")["deviation"].isna().to_dict() == {1: True, 2: True, 3: False, 4: False}  # where a decimal doesn't hold it


def test_other_columns(spark):
    df = spark.createDataFrame([(i, [float(i), i * i / 2.0], "a", 1, 2.0) for i in range(6)], "vec_id long, embedding array<double>, v string, dim int, w double")
    assert whitening.whiten(df).count() == 12
