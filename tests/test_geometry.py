from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import kernels as K
from fieldloom.model import POLYGON

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
TRIANGLE = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
ELL = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)]
YOU = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]


def polygons(spark, *polys):
    return spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in p]) for k, p in enumerate(polys)], f"k int, polygon {POLYGON.simpleString()}")


def test_measures(spark):
    p = F.col("polygon")
    rows = polygons(spark, SQUARE, TRIANGLE, SQUARE[:2], []).select("k", G.area(p).alias("a"), G.perimeter(p).alias("p"), G.major_axis(p).alias("m"), G.circularity(G.area(p), G.perimeter(p)).alias("c")).orderBy("k").collect()
    assert [r["a"] for r in rows] == [1.0, 0.5, 0.0, 0.0]
    assert [r["p"] for r in rows] == pytest.approx([4, 2 + math.sqrt(2), 2, 0])
    assert [r["m"] for r in rows] == pytest.approx([math.sqrt(2), math.sqrt(2), 1, 0])
    assert rows[0]["c"] == pytest.approx(math.pi / 4) and rows[3]["c"] == 0 and all(0 <= r["c"] <= 1 for r in rows)


def test_contains_concave(spark):
    inside = G.contains(F.col("polygon"), F.lit(1.5), F.lit(1.5))
    assert [r[0] for r in polygons(spark, ELL, YOU, SQUARE).orderBy("k").select(inside).collect()] == [False, False, False]
    assert [r[0] for r in polygons(spark, ELL, YOU).orderBy("k").select(G.contains(F.col("polygon"), F.lit(0.5), F.lit(1.5))).collect()] == [True, True]


@pytest.mark.parametrize(("threshold", "edge"), [(0.0, False), (5.0, True), (4.0, False)])
def test_edge_flag_is_inclusive(spark, threshold, edge):
    box = [(5.0, 100.0), (50.0, 100.0), (50.0, 150.0)]
    assert polygons(spark, box).select(G.on_edge(F.col("polygon"), threshold)).first()[0] is edge


def test_rounding_is_half_even(spark):
    r = polygons(spark, [(0.5, 1.5), (2.5, 3.4), (1030.0, -2.0)]).select(G.rounded(F.col("polygon"), 1024).alias("p")).first()["p"]
    assert [(q["x"], q["y"]) for q in r] == [(0, 2), (2, 3), (1023, 0)]


def test_patches_and_offsets(spark):
    df = spark.createDataFrame([(1500.0, 2100.0), (-5.0, 9999.0)], "x double, y double")
    assert [r[0] for r in df.select(G.patch_of_point(F.col("x"), F.col("y"))).collect()] == [9, 12]


def test_intersection_areas():
    a = np.array
    assert K.intersection_area(a(SQUARE), a(SQUARE)) == pytest.approx(1)
    assert K.intersection_area(a(ELL), a(SQUARE) + 0.5) == pytest.approx(0.75)
    assert K.intersection_area(a(YOU), a(SQUARE) * 3) == pytest.approx(7)
    assert K.intersection_area(a(YOU), a(SQUARE) + a([1, 1.5])) == pytest.approx(0)
    assert K.intersection_area(a(TRIANGLE), a(SQUARE)[::-1] * 0.5) == pytest.approx(0.25)
    assert K.intersection_area(a(SQUARE[:2]), a(SQUARE)) == 0


def test_intersection_against_grid():
    rng = np.random.default_rng(5)
    for _ in range(5):
        polys = []
        for _ in range(2):
            angle = np.sort(rng.uniform(0, 2 * math.pi, 9))
            radius = rng.uniform(0.4, 1, 9)
            polys.append(np.c_[radius * np.cos(angle), radius * np.sin(angle)] + rng.uniform(-0.2, 0.2, 2))
        n = 400
        g = (np.arange(n) + 0.5) / n * 3 - 1.5
        hits = 0
        for y in g:
            inside = np.ones(n, dtype=bool)
            for p in polys:
                inside &= np.searchsorted(K.crossings(p, y), g) % 2 == 1
            hits += inside.sum()
        assert K.intersection_area(*polys) == pytest.approx(hits * (3 / n) ** 2, abs=0.02)


def test_width_of_box():
    box = np.array([(0, 0), (10, 0), (10, 2), (0, 2)], dtype=float)
    turn = np.array([[math.cos(0.3), math.sin(0.3)], [-math.sin(0.3), math.cos(0.3)]])
    chords = K.width_chords(np.vstack([box, box[::-1]])[:4])
    assert len(chords) == K.CHORDS - 2 and np.hypot(chords[:, 2] - chords[:, 0], chords[:, 3] - chords[:, 1]).mean() == pytest.approx(2, rel=0.15)
    assert np.allclose(np.hypot(*(K.width_chords(box @ turn)[:, 2:] - K.width_chords(box @ turn)[:, :2]).T), np.hypot(*(chords[:, 2:] - chords[:, :2]).T))
    assert len(K.width_chords(box[:2])) == 0


def test_widths_of_a_concave_outline():
    """Lines over the whole extent; where they meet both arms of a U, its width spans them and each has a segment."""
    u = np.array([(0, 0), (30, 0), (30, 4), (2, 4), (2, 6), (30, 6), (30, 10), (0, 10)], dtype=float)
    chords, widths = K.width_chords(u), K.width_samples(u)
    assert len(widths) == 19 or len(widths) == 18
    assert len(chords) > 30 and max(widths) == pytest.approx(10, rel=0.05) and min(widths) > 9
    lengths = np.hypot(chords[:, 2] - chords[:, 0], chords[:, 3] - chords[:, 1])
    assert sorted({round(x) for x in lengths} - {10}) == [4]
    assert K.width_samples(u[:2]) == [0.0] == K.width_samples(np.zeros((4, 2)))


def test_areas_of_stacks():
    """Pairs computed together give what they give alone."""
    rng = np.random.default_rng(4)
    a, b = rng.random((40, 6, 2)), rng.random((40, 4, 2))
    assert np.allclose(K.intersection_areas(a, b), [K.intersection_area(x, y) for x, y in zip(a, b, strict=True)])


def crossed(*corners):
    return np.array(corners, dtype=np.float64)


def test_largest_part_of_crossed_outlines():
    """Bow-tie, pinched, touching and doubled outlines against parts found by hand."""
    same = crossed((0, 0), (10, 0), (10, 10), (5, 5), (0, 10))
    assert K.largest_part(same) is same or (K.largest_part(same) == same).all()
    for outline, part in (
        (crossed((0, 0), (8, 8), (8, 0), (0, 2)), [(8, 0), (8, 8), (1.6, 1.6)]),  # lobes of unequal size
        (crossed((0, 0), (2, 2), (8, 2), (8, -2), (2, -2), (0, 0), (-1, 1), (-1, -1)), [(0, 0), (2, -2), (8, -2), (8, 2), (2, 2)]),  # meets itself in a vertex
        (crossed((0, 0), (4, 0), (4, 4), (1, 0), (0, 4)), [(4, 0), (4, 4), (1, 0)]),  # a vertex on an edge
        (crossed((0, 0), (4, 0), (8, 0), (4, 0), (4, 4), (0, 4)), [(0, 0), (4, 0), (4, 4), (0, 4)]),  # a spike there and back
        (crossed((0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4)), [(0, 0), (4, 0), (4, 4), (0, 4)]),
    ):
        found = K.largest_part(outline)
        assert found[np.lexsort(found.T)] == pytest.approx(np.array(part)[np.lexsort(np.array(part, dtype=float).T)])
    assert len(K.largest_part(crossed((0, 0), (4, 0), (8, 0)))) in (0, 3)  # no area
    assert len(K.largest_part(crossed((0, 0), (4, 0), (0, 0), (4, 0)))) == 0


def test_parts_of_random_outlines():
    """However an outline crosses itself, its parts have the area that scan lines find inside, even-odd."""
    rng = np.random.default_rng(0)
    for n in (5, 12, 40):
        for _ in range(5):
            outline = rng.uniform(0, 10, (n, 2))
            lengths = [sum(hit[1::2] - hit[::2]) for y in np.linspace(0, 10, 4001)[1:-1] + 1e-7 if len(hit := K.crossings(outline, y))]
            assert sum(a for a, _ in K.enclosed_areas(outline)) == pytest.approx(sum(lengths) * 10 / 4000, rel=0.01, abs=0.02)


def test_long_outline_stays():
    rng = np.random.default_rng(1)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 5000))
    outline = np.c_[np.cos(angle), np.sin(angle)] * rng.uniform(50, 51, (5000, 1))
    assert K.largest_part(outline) is not None and len(K.largest_part(outline)) == 5000


def test_widths_of_crossed_outlines():
    """Widths are those of the larger lobe alone."""
    lobe = crossed((8, 8), (1.6, 1.6), (8, 0))
    whole = crossed((0, 0), (8, 8), (8, 0), (0, 2))
    part = K.largest_part(whole)
    assert K.width_samples(whole) == pytest.approx(K.width_samples(part))
    assert K.width_samples(part) == pytest.approx(K.width_samples(np.roll(lobe, -[tuple(np.round(p, 9)) for p in lobe].index(tuple(np.round(part[0], 9))), axis=0)))
    assert K.width_samples(crossed((0, 0), (4, 0), (0, 0), (4, 0))) == [0.0]
    box = crossed((0, 0), (8, 0), (8, 2), (0, 2))
    pinched = crossed((0, 0), (8, 0), (8, 2), (0, 2), (0, 0), (-1, -1), (-1, 0))  # a small lobe hangs at a corner
    assert K.width_samples(pinched) == pytest.approx(K.width_samples(box))


def test_widths_in_stacks(monkeypatch):
    """Plain outlines are cut together, to the widths and chords that each has alone; crossed and degenerate ones alone."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    angle = np.sort(rng.uniform(0, 2 * math.pi, (30, 9)), axis=1)
    plain = [*np.stack([np.cos(angle), np.sin(angle)], axis=2) * rng.uniform(20, 60, (30, 9, 1)), *(np.array(p) * 37.0 for p in (SQUARE, TRIANGLE, ELL, YOU))]
    odd = [crossed((0, 0), (8, 8), (8, 0), (0, 2)), crossed((0, 0), (0, 0), (4, 0), (4, 4)), crossed((1, 1), (2, 2)), np.zeros((5, 2)), np.zeros((0, 2)), rng.uniform(0, 99, (70, 2))]

    def column(outlines):
        return pa.array([None, *([{"x": x, "y": y} for x, y in o.tolist()] for o in outlines)], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def check(outlines):
        widths, chords = K.mean_chord.func(column(outlines)).to_pylist(), K.width_segments.func(column(outlines)).to_pylist()
        assert widths[0] == 0 and chords[0] == []
        return widths[1:], [[tuple(c.values()) for c in own] for own in chords[1:]]

    want = [np.mean(K.width_samples(o)) for o in plain + odd], [[tuple(map(int, c)) for c in np.rint(K.width_chords(o))] for o in plain + odd]
    widths, chords = check(plain + odd)
    assert widths == pytest.approx(want[0], rel=1e-12) and chords == want[1]
    assert len(chords[33]) > 18  # both arms of a U
    own = K.width_cuts
    monkeypatch.setattr(K, "width_cuts", lambda poly, *rest: own(poly, *rest) if len(poly) < 3 else pytest.fail("a plain outline was cut alone"))
    assert check(plain)[0] == widths[: len(plain)]
