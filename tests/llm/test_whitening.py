"""Whitening against the eigenvectors of the covariance, formed directly."""

import numpy as np
import pytest

from veltrial.llm.whitening import jacobi, whiten


def plain(vectors, k):
    """n, x, deviations, whitened and explained by an eigendecomposition of the covariance."""
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    y = fit - total / n
    w, v = np.linalg.eigh(y.T @ y / n)
    w, v = w[::-1][:k], v[:, ::-1][:, :k]
    return n, ((n * x - total) ** 2).sum(1), (x - total / n) @ v / np.sqrt(w), w / np.trace(y.T @ y / n)


@pytest.mark.parametrize("rows,d", [(300, 5), (700, 24), (40, 64)])
def test_whitened_rows_equal_the_eigenvectors(spark, rows, d):
    rng = np.random.default_rng(rows)
    v = rng.normal(size=(rows, d)) * np.linspace(3, 0.5, d)
    v[: rows // 3] = v[0]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, x.tolist(), "c") for i, x in enumerate(v)], "vec_id long, embedding array<double>, n string").repartition(7)
    k = min(d, 16)
    got = whiten(df).toPandas().sort_values(["vec_id", "component"])
    n, deviation, whitened, explained = plain(v, k)
    assert len(got) == rows * k and set(got["n"]) == {n}
    assert (got["deviation"].to_numpy().reshape(rows, k) == deviation[:, None]).all()
    mine = got["whitened"].to_numpy().reshape(rows, k)
    sign = np.sign((mine * whitened).sum(0))
    assert np.allclose(mine * sign, whitened, rtol=1e-8, atol=1e-8)
    assert np.allclose(got["explained"].to_numpy()[:k], explained, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_jacobi_keeps_small_singular_values():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    want = 10.0 ** -np.arange(9)
    v, sigma = jacobi(np.linalg.qr(q * 1.0)[0] * want)  # columns of lengths 1 to 1e-8
    assert np.allclose(sigma, want, rtol=1e-12) and np.allclose(v.T @ v, np.eye(9), atol=1e-14)


def test_defined_cases(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.5, 2.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (None, [3.0]), (7, [1e300, 5.0, 6.0]), (8, [1.0, 5.0, 7.0]), (9, []), (10, [float("inf")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whiten(df).collect()}
    assert {i for i, _ in got} == {1, 2, 3, None, 7, 8}
    assert got[1, 1].n == 2 and got[1, 1].deviation == 1024 and abs(got[1, 1].whitened) == pytest.approx(1)
    assert got[1, 2].whitened is None and got[1, 2].explained == 0
    assert got[None, 1].deviation == 0 and got[None, 1].whitened is None
    assert got[7, 1].deviation == (1 << 63) - 1
    assert whiten(df.limit(0)).collect() == []
    assert whiten(df.where("vec_id = 5")).collect() == []
    named = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "vec_id string, embedding array<float>")
    assert {(r.vec_id, round(abs(r.whitened), 9)) for r in whiten(named).collect()} == {("a", 1.0), ("b", 1.0)}


def test_many_triangles_are_combined_in_levels(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 3))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = whiten(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert np.allclose(got.drop_duplicates("component").sort_values("component")["explained"], plain(v, 3)[3], rtol=1e-9)
