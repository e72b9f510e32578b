"""Whitening against exact sums, numpy's eigenpairs and a plain version."""

import math

import numpy as np
import pytest

from seepage.llm import queries as Q
from seepage.llm import whitening as W

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, x int, d int, whitened string"


@pytest.mark.parametrize("values", [
    [1.0], [2.0, 2.0, 2.0], [0.0, 0.0, 5.0], [-1.0, 0.0, 1.0], list(np.linspace(0, 1, 40)), [10.0**-k for k in range(12)],
    [3.0, 3.0, 1.0, 1.0, 1.0], list(np.random.default_rng(1).random(64)), [0.0, 0.0],
])
@pytest.mark.parametrize("turned", [True, False])
def test_eigenpairs(values, turned):
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))[0] if turned else np.eye(n)
    a = (q * np.array(values)) @ q.T
    a = (a + a.T) / 2
    got, vectors = W.eigenpairs(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.allclose(got, np.sort(values)[::-1], atol=1e-14 * n * size, rtol=0)
    assert np.abs(a @ vectors - vectors * got).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13


def test_polar_factor_is_the_matrix_sign():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    values = rng.standard_normal(30)
    a = (q * values) @ q.T
    assert np.abs(W.polar_factor((a + a.T) / 2) - (q * np.sign(values)) @ q.T).max() < 1e-12


def plain(rows, components):
    """What the contract asks for, with numpy's own eigenpairs and Python's integers."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in fine]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    apart = [[n * c - s for c, s in zip(v, sums)] for v in x]
    centred = np.array([[a / n for a in v] for v in apart])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = centred @ vectors[:, :components] / np.sqrt(values[:components])
    return {(i, k + 1): (n, sum(a * a for a in v), abs(w[k]), values[k] / np.trace(cov))
            for (i, _), v, w in zip(fine, apart, white) for k in range(components)}


def test_query_against_plain_version(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in table.collect()], 32)
    got = Q.QUERIES["op11_whitening"](spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        n, deviation, size, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(size, abs=1e-7) and r.explained == pytest.approx(share, rel=1e-9)
        assert r.identity_error < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i * i % 11), float(i % 3)], 1, 2, "a") for i in range(40)]
    odd = [(100, None, 1, 2, "a"), (101, [], 1, 2, "a"), (102, [1.0, None, 2.0], 1, 2, "a"), (103, [nan, 1.0, 1.0], 1, 2, "a"),
           (104, [1.0, inf, 1.0], 1, 2, "a"), (105, [1.0, 2.0], 1, 2, "a"), (106, [1e30, 0.0, 0.0], 1, 2, "a")]
    table = spark.createDataFrame(good + good[:3] + [(None, [0.5, -0.5, 9.0], 1, 2, "a")] + odd, SCHEMA)
    got = W.whiten(table, 2).collect()
    assert len(got) == 2 * 44 and {r.vec_id for r in got} == {None, *range(40)}
    assert got[0].n == 44 and got[0].identity_error < 1e-10


def test_no_components(spark):
    for rows in ([], [(1, None, 1, 1, "")], [(1, [1.0, 2.0], 1, 1, "")], [(i, [0.25, 0.5], 1, 1, "") for i in range(9)]):
        out = W.whiten(spark.createDataFrame(rows, SCHEMA), 32)
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.count() == 0


def test_equal_directions_leave_lower_rank(spark):
    rows = [(i, [float(i), float(i), -float(i)], 0, 0, "") for i in range(1, 30)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA), 32).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)


def test_large_entries_are_exact(spark):
    """Entries whose squares no double holds."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(-2**48, 2**48, 2)], 0, 0, "") for i in range(20)]
    schema = SCHEMA.replace("array<float>", "array<double>")
    got = {r.vec_id: r for r in W.whiten(spark.createDataFrame(rows, schema), 2).where("component = 1").collect()}
    assert all(r.deviation is None for r in got.values()) and got[0].identity_error < 1e-10
    few = [(i, [float(v) for v in rng.integers(-2**20, 2**20, 2)], 0, 0, "") for i in range(20)]
    want = plain([(i, v) for i, v, *_ in few], 1)
    got = {r.vec_id: r for r in W.whiten(spark.createDataFrame(few, schema), 1).collect()}
    assert all(got[i].deviation == want[i, 1][1] for i, *_ in few)
