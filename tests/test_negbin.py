"""Distributed fits and dispersions against plain ones in memory, and against simulated truth."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import negbin as B
from fieldloom.plans import differential as D


def log_likelihood(y, mu, d):
    r = 1 / d
    return float((B.log_gamma(y + r) - B.log_gamma(np.full_like(mu, r)) - B.log_gamma(y + 1) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))).sum())


def plain_fit(y, x, offset, d, rounds=100):
    """All cells in memory: coefficients and log-likelihood by scored steps, halved while it falls."""
    beta = np.zeros(x.shape[1])
    beta[0] = math.log((y.sum() + 0.5) / np.exp(offset).sum())
    best = log_likelihood(y, np.exp(x @ beta + offset), d)
    for _ in range(rounds):
        mu = np.exp(x @ beta + offset)
        v = 1 + d * mu
        step = np.linalg.solve((x * (mu / v)[:, None]).T @ x + 1e-10 * np.eye(x.shape[1]), x.T @ ((y - mu) / v))
        size = 1.0
        while (to := log_likelihood(y, np.exp(x @ (beta + size * step) + offset), d)) < best and size > 1e-6:
            size /= 2
        if to <= best:
            break
        beta, best = beta + size * step, to
    return beta, best


def plain_curve(y, x, offset, grid):
    out = []
    for d in grid:
        beta, best = plain_fit(y, x, offset, d)
        mu = np.exp(x @ beta + offset)
        out.append(best - 0.5 * np.linalg.slogdet((x * (mu / (1 + d * mu))[:, None]).T @ x)[1])
    return np.array(out)


def tables(spark, y, x, offset, line="L"):
    """(counts, design, genes) of dense counts, genes by cells."""
    entries = [(c, f"g{g:03d}", int(y[g, c])) for g, c in zip(*np.nonzero(y), strict=True)]
    entries = [(int(c), g, n) for c, g, n in entries]
    counts = spark.createDataFrame(entries, "cell long, gene string, n int")
    design = spark.createDataFrame([(line, c, float(offset[c]), [float(v) for v in x[c]]) for c in range(len(x))], "cell_line string, cell long, offset double, x array<double>")
    return counts, design, spark.createDataFrame([(line, f"g{g:03d}") for g in range(len(y))], "cell_line string, gene string")


def simulated(n, means, dispersion, seed, effect=0.0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.ones(n), np.arange(n) % 2])
    offset = np.log(rng.uniform(0.5, 2, n))
    mu = np.asarray(means)[:, None] * np.exp(offset + effect * x[:, 1])[None, :]
    r = 1 / np.broadcast_to(np.asarray(dispersion), (len(mu),))[:, None]
    return rng.negative_binomial(np.broadcast_to(r, mu.shape), r / (r + mu)), x, offset


def test_special_functions():
    x = np.array([0.01, 0.5, 1.0, 3.3, 12.0, 400.0])
    h = 3e-4
    assert B.digamma(x) == pytest.approx((B.log_gamma(x * (1 + h)) - B.log_gamma(x * (1 - h))) / (2 * h * x), rel=1e-5, abs=1e-6)
    assert B.trigamma(x) == pytest.approx((B.digamma(x * (1 + h)) - B.digamma(x * (1 - h))) / (2 * h * x), rel=1e-5, abs=1e-6)
    assert B.trigamma(np.array(1.0)) == pytest.approx(math.pi**2 / 6, rel=1e-9)
    for v in (1e-6, 0.1, 1.0, 50.0, 1e6):
        assert float(B.trigamma(np.array(B.trigamma_inverse(v)))) == pytest.approx(v, rel=1e-6)


def test_peaks():
    grid = B.dispersion_grid(11, -6, 6)
    curves = np.array([-((np.log2(grid / 0.1) - at) ** 2) for at in (-6, -3.3, 0.2, 7)])
    assert np.log2(B.peaks(grid, curves) / 0.1) == pytest.approx([-6, -3.3, 0.2, 6])


@pytest.mark.parametrize(("chunk", "block"), [(7, 3), (4096, 64)])
def test_fit_as_in_memory(spark, chunk, block):
    """However cells and genes are cut, coefficients and log-likelihoods are those of all cells at once; a coefficient that
    isn't free stays."""
    y, x, offset = simulated(60, [0.4, 2, 8, 30, 5], 0.3, 2, effect=0.7)
    units, numbered = B.units_of(*tables(spark, y, x, offset), 2, chunk, block)
    assert units.count() == -(-60 // chunk) * -(-5 // block)
    problems = numbered.selectExpr("cell_line", "g", "explode(array(named_struct('k', 0, 'd', 0.3D, 'free', 3), named_struct('k', 1, 'd', 2.0D, 'free', 3), named_struct('k', 2, 'd', 0.3D, 'free', 1))) as q", "array(element_at(array(%s), cast(g as int) + 1), 0D) as beta" % ", ".join(f"{math.log(v.mean())}D" for v in y)).select("cell_line", "g", "q.*", "beta")
    found = {(r["g"], r["k"]): r for r in B.fit(units, problems, 2, block).collect()}
    assert len(found) == 15
    for (g, k), r in found.items():
        d, own = (2.0 if k == 1 else 0.3), (x[:, :1] if k == 2 else x)
        beta, best = plain_fit(y[g].astype(float), own, offset, d)
        assert r["beta"][: own.shape[1]] == pytest.approx(beta, abs=1e-6)
        assert r["beta"][1] == 0.0 if k == 2 else True
        fixed = B.fixed_part(y[g].astype(float), np.array(d)).sum()
        assert r["best"] + fixed == pytest.approx(best, abs=1e-7)


def test_one_curve_as_in_memory(spark):
    """Without a trend, each gene's curve moves towards the line's mean curve by the given weight, however cells and genes
    are cut."""
    y, x, offset = simulated(50, [2, 3, 9, 12, 4, 6], 0.5, 8)
    grid = B.dispersion_grid(11, -6, 6)
    curves = np.array([plain_curve(v.astype(float), x, offset, grid) for v in y])
    common = curves.mean(axis=0)
    want = B.peaks(grid, curves + 20 / (50 - 2) * common)
    how = B.Dispersions(length=11, low=-6, high=6, trended=False, prior_df=20.0)
    got = B.fit_genes(*tables(spark, y, x, offset), ["intercept", "group"], tested=["group"], dispersions=how, chunk=16, block=4).orderBy("gene").collect()
    assert [r["dispersion"] for r in got] == pytest.approx(want, rel=1e-5)
    assert [r["common_dispersion"] for r in got] == pytest.approx([B.peaks(grid, common[None])[0]] * 6, rel=1e-5)
    for r, v in zip(got, y, strict=True):
        beta, full = plain_fit(v.astype(float), x, offset, r["dispersion"])
        less = plain_fit(v.astype(float), x[:, :1], offset, r["dispersion"])[1]
        assert [r["beta_intercept"], r["beta_group"]] == pytest.approx(beta, abs=1e-6)
        assert r["p_group"] == pytest.approx(math.erfc(math.sqrt(max(0, full - less))), rel=1e-4)


def test_trend_is_recovered(spark):
    """Dispersion that falls with the mean, far beyond a factor of 64 from 0.1 on both sides."""
    means = np.exp(np.linspace(np.log(2), np.log(400), 120))
    truth = 0.002 + 4 / means
    y, x, offset = simulated(120, means, truth, 3)
    got = {r["gene"]: r for r in B.fit_genes(*tables(spark, y, x, offset), ["intercept", "group"], tested=["group"]).collect()}
    trend = np.array([got[f"g{g:03d}"]["common_dispersion"] for g in range(120)])
    own = np.array([got[f"g{g:03d}"]["dispersion"] for g in range(120)])
    assert np.abs(np.log2(trend[10:-10] / truth[10:-10])).mean() < 0.4
    assert np.abs(np.log2(own / truth)).mean() < 0.55  # a local mean lags behind at both ends
    assert trend[0] > 8 * trend[-1]
    p = np.array([r["p_group"] for r in got.values()])
    assert 0.35 < p.mean() < 0.65 and (p < 0.01).mean() < 0.06


def test_prior_weight_follows_the_spread(spark):
    """Genes that share a dispersion get a far heavier prior than genes whose dispersions differ."""
    rng = np.random.default_rng(6)
    means = rng.uniform(5, 50, 80)
    lines = []
    for k, (name, truth) in enumerate((("same", np.full(80, 0.3)), ("spread", 0.3 * np.exp(rng.normal(0, 1.0, 80))))):
        counts, design, genes = tables(spark, *simulated(40, means, truth, 9), line=name)
        lines.append((counts.withColumn("cell", F.col("cell") + 1000 * k), design.withColumn("cell", F.col("cell") + 1000 * k), genes))
    both = [a.unionByName(b) for a, b in zip(*lines, strict=True)]
    how = B.Dispersions(length=11, low=-6, high=6, trended=False)
    rows = B.fit_genes(*both, ["intercept", "group"], tested=["group"], dispersions=how).collect()
    df = {name: {r["prior_df"] for r in rows if r["cell_line"] == name} for name in ("same", "spread")}
    assert all(len(v) == 1 for v in df.values()) and len(rows) == 160
    assert min(df["same"]) > 40 > 12 > max(df["spread"]) > 1


def test_prior_weight_of_known_spread(spark):
    """Mean deviances drawn as the model has them give back the degrees of freedom that they were drawn with."""
    rng = np.random.default_rng(1)
    n, df, prior = 20_000, 10, 6.0
    s2 = rng.chisquare(df, n) / df * prior / rng.chisquare(prior, n) * np.exp(0.3 * np.linspace(-1, 1, n) ** 2)
    rows = [("L", float(a), float(v * df), float(df)) for a, v in zip(np.linspace(2, 9, n), s2, strict=True)]
    rows += [("few", 1.0, 3.0, 2.0), ("none", 1.0, 0.0, 0.0)]
    got = {r["cell_line"]: r["prior_df"] for r in B.prior_weights(spark.createDataFrame(rows, "cell_line string, abundance double, deviance double, df double")).collect()}
    assert got["L"] == pytest.approx(prior, rel=0.1) and got["few"] == math.inf and "none" not in got


def test_trend_curves_as_in_memory(spark):
    """Ranges with overlapping edges give the means over all genes of a line; ties in abundance too."""
    rng = np.random.default_rng(2)
    n = 130
    abundance = np.round(rng.uniform(0, 5, n), 1)
    curve = rng.normal(size=(n, 3))
    df = spark.createDataFrame([("L", g, float(abundance[g]), [float(v) for v in curve[g]]) for g in range(n)] + [("one", 0, 1.0, [1.0, 2.0, 3.0])], "cell_line string, g long, abundance double, curve array<double>")
    got = {(r["cell_line"], r["g"]): r["common"] for r in B.trend_curves(df, 3, genes=16).collect()}
    assert len(got) == n + 1 and got["one", 0] == [1.0, 2.0, 3.0]
    span = math.ceil(n * (0.25 + 0.75 * math.sqrt(50 / n)))
    for g in range(n):
        distance = np.abs(abundance - abundance[g])
        reach = np.sort(distance)[span - 1]
        w = np.clip(1 - (distance / (reach * (1 + 1e-9))) ** 3, 0, None) ** 3
        assert got["L", g] == pytest.approx(w @ curve / w.sum(), rel=1e-6, abs=1e-9)


def test_slides_of_a_line(spark):
    """A line's own first slide is its reference; a slide that it lacks changes nothing."""
    rows = [(c, line, 1.0 + c % 3 / 10, slide) for c, (line, slide) in enumerate([("a", "s1"), ("a", "s2"), ("b", "s2"), ("b", "s3")] * 30)]
    cells = spark.createDataFrame(rows, "cell long, cell_line string, size_factor double, slide string")
    design, names = B.design_table(cells, [], slide="slide")
    assert names == ["intercept", "slide_s2", "slide_s3"]
    assert {(r["cell_line"], tuple(r["x"])) for r in design.collect()} == {("a", (1, 0, 0)), ("a", (1, 1, 0)), ("b", (1, 0, 0)), ("b", (1, 0, 1))}
    counts = spark.createDataFrame([(c, "g", 3 + c % 5 + 4 * (c % 4 == 3)) for c in range(120)], "cell long, gene string, n int")
    got = {r["cell_line"]: r for r in B.fit_genes(counts, design, spark.createDataFrame([("a", "g"), ("b", "g")], "cell_line string, gene string"), names, tested=["slide_s3"]).collect()}
    assert got["a"]["beta_slide_s3"] == 0 and got["a"]["p_slide_s3"] == 1 and got["b"]["p_slide_s3"] < 1e-6 and got["b"]["beta_slide_s2"] == 0


def test_stand_in_slice(spark):
    """The registered tests' own steps on two cell lines and a few genes."""
    from fieldloom.plans import standins as V
    from fieldloom.plans.cohorts import MIN_SEEN

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    cells = V.cells(spark, d).where("cell_line in ('BUILDING', 'MACHINERY')")
    counts = V.counts(spark, d).where("gene like 'G10%'")
    result, skipped = D.two_groups(cells, counts, min_cells=MIN_SEEN)
    rows = result.collect()
    assert {r["cell_line"] for r in rows} == {"BUILDING", "MACHINERY"} and not skipped.collect()
    assert all(0 <= r["pvals"] <= r["pvals_adj"] <= 1 and math.isfinite(r["beta1"]) for r in rows)
    assert all(abs(r["beta1"] / math.log(2) - r["log2fc"]) < 1.5 for r in rows)  # alike, as offsets aren't weights


def test_empty(spark):
    counts, design, genes = (t.limit(0) for t in tables(spark, np.array([[1, 2]]), np.ones((2, 1)), np.zeros(2)))
    assert B.fit_genes(counts, design, genes, ["intercept"], tested=[]).collect() == []


def test_conditions_differ_by_test():
    assert (D.NUCLEI.length, D.NUCLEI.low, D.NUCLEI.high, D.NUCLEI.trended, D.NUCLEI.prior_df) == (11, -6.0, 6.0, False, None)
    assert (D.TUBES.length, D.TUBES.low, D.TUBES.high, D.TUBES.trended, D.TUBES.prior_df) == (21, -10.0, 10.0, True, None)


def test_residual_freedom_by_rank(spark):
    # twelve cells on three slides; gene 0 is seen on all, gene 1 not on the third, gene 2 on the first only, gene 3 nowhere
    slide = np.arange(12) // 4
    x = np.column_stack([np.ones(12), slide == 1, slide == 2]).astype(float)
    y = np.zeros((12, 4))
    y[:, 0], y[:8, 1], y[:4, 2] = 3, 2, 5
    beta = np.array([[1.0, 0.0, 0.0], [0.7, 0.0, -25.0], [1.6, -25.0, -25.0], [-25.0, 0.0, 0.0]])
    found = B.Unit(y, x, np.zeros(12)).spread(np.arange(4), beta, np.full(4, 0.1))
    assert np.allclose(found[:, 0], B.saturated(y, np.full(4, 0.1)))
    names = [f"x{b}" for b in range(6)]
    rows = [("L", g, 0, *(float(v) for v in found[g])) for g in range(4)]
    full = spark.createDataFrame(rows, "cell_line string, g long, k int, best_possible double, " + ", ".join(f"{n} double" for n in names))
    got = {r["g"]: r["df"] for r in B.residual_freedom(full, names, 3).collect()}
    assert got == {0: 12 - 3, 1: 8 - 2, 2: 4 - 1, 3: 0}
