"""Places, running sums and quantiles in keys of which one holds most rows."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import kernels as K
from fieldloom.operators import cohort as C
from fieldloom.operators import effects as E
from fieldloom.operators import order as R


def skewed(n: int = 3000):
    rng = random.Random(3)
    return [(k, ("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])), rng.randint(0, 5000), rng.randint(0, 9)) for k in range(n)]


def test_places_within_a_hot_key(spark):
    """Gapless places and running sums in each key, nulls included; the hot key is cut into ranges of like size."""
    rows = skewed()
    df = spark.createDataFrame(rows, "id long, key string, v long, w long")
    for before in (None, "w"):
        got = {r["id"]: r["place"] for r in R.placed_within(df, ["key"], F.col("v"), F.col("id"), start=0, before=F.col(before) if before else None).collect()}
        for key in ("hot", "a", "b", None):
            at = 0
            for k, _, _, w in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
                assert got[k] == at
                at += w if before else 1
    held: list[int] = []
    plain = R.cut

    def counting(table, name):
        held.extend(r["n"] for r in table.groupBy("_range").agg(F.count("*").alias("n")).collect())
        return plain(table, name)

    R.cut = counting
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        R.placed_within(df.repartition(8), ["key"], F.col("v"), F.col("id"))
    finally:
        R.cut = plain
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) >= 4 and max(held) < 0.5 * len(rows)


def test_places_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, key string")
    assert R.placed_within(empty, ["key"], F.col("id")).collect() == []
    assert R.quantiles(empty, ["key"], F.col("id"), {"m": 0.5}).collect() == []


def test_quantiles_as_percentile(spark):
    rows = [*skewed(), (-1, "one", 7, 0), (-2, "none", None, 0)]
    df = spark.createDataFrame(rows, "id long, key string, v long, w long")
    shares = {"q25": 0.25, "median": 0.5, "q75": 0.75, "least": 0.0, "most": 1.0}
    got = {tuple(r) for r in R.quantiles(df, ["key"], F.col("v"), shares).collect()}
    want = {tuple(r) for r in df.where("key is not null and v is not null").groupBy("key").agg(*(F.percentile("v", F.lit(q)).alias(n) for n, q in shares.items())).collect()}
    assert got == want and len(got) == 4
    assert R.quantiles(df, [], F.col("v"), {"m": 0.5}).first()["m"] == statistics.median(r[2] for r in rows if r[2] is not None)
    whole = C.five_numbers(df, "v").first()
    assert whole["n"] == len(rows) - 1 and whole["median"] == statistics.median(r[2] for r in rows if r[2] is not None)
    assert {r["key"]: r["median"] for r in C.five_numbers(df.where("key is not null"), "v", ["key"]).collect()}["none"] is None


@pytest.mark.parametrize("width", [E.P_VALUES_A_BIN, 7])
def test_adjustment_where_values_crowd(spark, width):
    """Many different p-values near 0, ties, nulls: as one sort of each group gives it, in bins of ranks."""
    rng = np.random.default_rng(5)
    rows = [("L", float(v)) for v in np.concatenate([rng.uniform(0, 1e-9, 300), rng.uniform(0, 1, 100), [0.0, 0.0, 1.0, 1.0], [0.01] * 50])]
    rows += [("M", 0.5), ("M", None), ("N", None)]
    got = E.adjusted(spark.createDataFrame(rows, "cell_line string, p double"), ["cell_line"], width=width).collect()
    assert len(got) == len(rows)
    p = np.sort([v for k, v in rows if k == "L"])
    q = np.minimum(1, np.minimum.accumulate((p * len(p) / np.searchsorted(p, p, side="right"))[::-1])[::-1])
    want = dict(zip(p, q, strict=True))
    for r in got:
        assert r["p_adj"] == (None if r["p"] is None else pytest.approx(0.5 if r["cell_line"] == "M" else want[r["p"]], rel=1e-12))


def test_diameter_as_all_pairs():
    rng = np.random.default_rng(7)
    shapes = [rng.normal(size=(n, 2)) for n in (1, 2, 3, 4, 50, 400)] + [rng.integers(0, 4, (30, 2)).astype(float) for _ in range(20)]
    angle = np.linspace(0, 2 * np.pi, 721)[:-1]
    shapes += [np.c_[np.cos(angle), np.sin(angle)], np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]]), np.array([[2.0, 2]] * 5), np.c_[np.arange(9.0), np.arange(9.0)]]
    for p in shapes:
        far = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)).max()
        assert K.diameter(p) == pytest.approx(far, rel=1e-12)
    assert K.diameter(np.zeros((0, 2))) == 0.0


def test_major_axis_of_long_outlines(spark):
    from fieldloom.functions import geometry as G

    rng = np.random.default_rng(8)
    shapes = [rng.normal(size=(n, 2)).round(3).tolist() for n in (31, 32, 33, 200)] + [[], [[1.0, 2.0]]]
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in p]) for k, p in enumerate(shapes)] + [(9, None)], "k int, p array<struct<x: double, y: double>>")
    got = {r["k"]: (r["a"], r["b"]) for r in df.select("k", G.major_axis(F.col("p")).alias("a"), G.largest_distance(F.col("p")).alias("b")).collect()}
    assert all(a == pytest.approx(b) for a, b in got.values()) and got[4][0] == got[5][0] == 0.0
