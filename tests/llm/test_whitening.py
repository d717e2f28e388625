from __future__ import annotations

import math
import random

import numpy as np
import pytest

from fieldloom.llm import whitening as W


def brute(rows):
    """Plain integers and the library's own eigenvectors."""
    kept = [(k, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n = len(kept)
    sums = [sum(x[d] for _, x in kept) for d in range(len(kept[0][1]))]
    y = np.array([[(n * x - s) / n for x, s in zip(row, sums, strict=True)] for _, row in kept])
    v = y.T @ y / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    return n, {k: sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for k, row in kept}, [k for k, _ in kept], y @ axes / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


def test_as_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1 + d) * (1 if d < 9 else 0.01) for d in range(12)]) for k in range(400)]
    rows += [(400, None), (401, [float("nan")] * 12), (402, [None] + [0.0] * 11), (403, [float("inf")] + [0.0] * 11), (404, [0.0] * 12), (405, rows[0][1])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)).collect()
    n, deviations, ids, white, share = brute(rows)
    assert n == 402 and len(got) == 8 * n and {r["n"] for r in got} == {n}
    assert all(r["deviation"] == deviations[r["vec_id"]] for r in got)
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    own = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(8):
        mine = np.array([own[i, k + 1]["whitened"] for i in ids])
        sign = np.sign(mine @ white[:, k])
        assert mine == pytest.approx(sign * white[:, k], abs=1e-8)
        assert own[0, k + 1]["explained"] == pytest.approx(share[k], rel=1e-9)


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1, 1, 1, 1], [3, 3, 1, 1, 0, 0, 0], [1e12, 1, 1e-3], [2], [0, 0], [1e-9, 1e-12, 0], list(range(64)), [7] * 20 + [1] * 44])
def test_divide_and_conquer(values):
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(len(values), len(values))))[0]
    a = q @ np.diag(np.array(values, dtype=float)) @ q.T
    a = (a + a.T) / 2
    for want in (len(values), min(8, len(values))):
        e, v = W.leading(a, want)
        top = np.sort(values)[::-1][:want]
        assert e == pytest.approx(top, abs=1e-13 * max(values, default=0) * len(values) + 1e-300)
        assert v.T @ v == pytest.approx(np.eye(want), abs=1e-12)
        assert np.linalg.norm(a @ v - v * e) <= 1e-12 * max(1e-300, np.linalg.norm(a)) * len(values)


def test_polar_factor_is_the_sign():
    q = np.linalg.qr(np.random.default_rng(4).normal(size=(29, 29)))[0]
    d = np.array([1e-9, -1e-9, 1e-3, *np.linspace(-3, 3, 26)])
    assert W.polar_factor(q @ np.diag(d) @ q.T) == pytest.approx(q @ np.diag(np.sign(d)) @ q.T, abs=1e-5)


def test_large_numbers_stay_exact(spark):
    own = W.Sums(10**10, [10**15, -(10**15)])
    x = np.array([[100_500, -99_000], [100_000, -100_000]])
    assert own.squares(x) == [sum((10**10 * v - s) ** 2 for v, s in zip(row, own.sums, strict=True)) for row in x.tolist()]
    huge = W.Sums(3, [3 << 61, 0])
    assert huge.squares(np.array([[1 << 61, 7]])) == [21 * 21]
    got = W.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got if r["vec_id"] != 3)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], schema)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    for rows in ([(1, [1.0, 2.0, 3.0])], [(1, [1.0, 2.0, 3.0])] * 3, [(None, [0.0] * 3), (2, [0.0, 0.0])]):
        got = W.whiten(spark.createDataFrame(rows, schema)).collect()
        assert len(got) == 3 * len(rows)
        assert all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in got)
    rows = [(1, [1.0, 2.0], "a"), (1, [0.0, 2.0], "b"), (None, [4.0], "c")]  # one id twice, none, a short vector, two dimensions that vary
    got = W.whiten(spark.createDataFrame(rows, schema + ", n string")).collect()
    assert len(got) == 6 and {r["component"] for r in got} == {1, 2} and all(r["identity_error"] < 1e-9 for r in got)
