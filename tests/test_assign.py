from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldloom.model import POLYGON
from fieldloom.operators import assign as A
from fieldloom.operators import outlines as O


def box(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


@pytest.fixture
def scene(spark):
    objects = spark.createDataFrame([("S", 0, 0, 1, box(0, 0, 100, 100)), ("S", 0, 0, 2, box(50, 0, 150, 100))], f"slide string, fov int, patch_idx int, object_idx long, polygon {POLYGON.simpleString()}")
    at = [(10.5, 10.5), (120.5, 10.5), (400.5, 10.5)] + [(60.5 + k, 50.5) for k in range(7)]
    points = spark.createDataFrame([("S", 0, 0, k, "g", x, y) for k, (x, y) in enumerate(at)], "slide string, fov int, patch_idx int, point_id long, target string, x double, y double")
    return points, objects


def totals(df):
    return {r["object_idx"]: r["n"] for r in df.groupBy("object_idx").agg(F.count("*").alias("n")).collect()}


def test_rules(scene):
    points, objects = scene
    assert totals(A.assign_points(points, objects, "greedy")) == {1: 8, 2: 1}
    assert totals(A.assign_points(points, objects, "shared")) == {1: 8, 2: 8}
    assert totals(A.assign_points(points, objects, "null")) == {1: 1, 2: 1}
    assert totals(A.assign_points(points, objects, "last")) == {1: 1, 2: 8}
    dealt = totals(A.assign_points(points, objects, "random", seed=3))
    assert sum(dealt.values()) == 9 and sorted(dealt.values()) == [4, 5]
    assert totals(A.assign_painted(points, objects)) == {1: 1, 2: 8}
    with pytest.raises(ValueError, match="rule"):
        A.assign_points(points, objects, "best")


def test_random_is_repeatable(scene):
    points, objects = scene
    one, two = ({(r["point_id"], r["object_idx"]) for r in A.assign_points(points, objects, "random", seed=5).collect()} for _ in range(2))
    assert one == two


def test_no_second_shuffle(scene, spark):
    """The reduction per point keeps the partitioning of the bin join."""
    points, objects = scene
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = A.assign_points(points, objects, "greedy")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 2


def test_links(spark):
    schema = f"slide string, fov int, patch_idx int, object_idx long, polygon {POLYGON.simpleString()}"
    nuclei = spark.createDataFrame([("S", 0, 0, 1, box(0, 0, 10, 10)), ("S", 0, 0, 2, box(0, 50, 10, 60)), ("S", 0, 0, 3, box(300, 300, 310, 310)), ("S", 0, 0, 4, [])], schema)
    tubes = spark.createDataFrame([("S", 0, 3, 5, box(2, 0, 100, 10)), ("S", 0, 3, 9, box(-1, 40, 100, 70)), ("S", 0, 3, 8, box(-2, 40, 100, 70))], schema)
    links = A.link_objects(nuclei, tubes)  # nucleus 1 lies in a tube by exactly 0.8: no link
    assert [(r["nuc_idx"], r["myo_idx"], r["overlap_frac"]) for r in links.collect()] == [(2, 8, 1.0)]
    out = {r["object_idx"]: (r["myotube_id"], r["myotube_patch_idx"], r["myotube_key"]) for r in A.export_links(nuclei, links, tubes).collect()}
    assert out[2] == (8, 3, "0_patch_3_myotube_8") and out[1] == (-1, -1, None)


@pytest.mark.parametrize(("inner", "other", "gone"), [(1, True, {1}), (2, True, {1, 2}), (3, True, {0}), (3, False, {1, 2, 3})])
def test_containment_rules(spark, inner, other, gone):
    """One or two inside go; of three or more the outer goes, unless it is its file's largest."""
    rows = [("a", 0, box(0, 0, 100, 100))] + [("a", k, box(10 * k, 10, 10 * k + 5, 15)) for k in range(1, inner + 1)]
    rows += [("a", 99, box(1000, 1000, 2000, 2000))] if other else []
    objects = spark.createDataFrame(rows, f"image_name string, object_idx long, polygon {POLYGON.simpleString()}")
    assert {r["object_idx"] for r in O.removals(objects).collect()} == gone


def test_drop_list(spark):
    table = spark.createDataFrame([("d/a.tif", "0", "3.5"), ("d/a.tif", "1", "x"), ("d/b.tif", "0.0", "15")], "image_name string, assignment_idx string, average_intensity string")
    assert [tuple(r) for r in O.intensity_drop_list(table).collect()] == [("a", 0)]
    with pytest.raises(ValueError, match="average_intensity"):
        O.intensity_drop_list(table.drop("average_intensity"))
    with pytest.raises(ValueError, match="contour_idx"):
        O.intensity_drop_list(table.drop("assignment_idx"))


def test_raster_clips_to_the_patch(spark):
    """Outlines are clipped to the patch before they are filled; points outside of it count nowhere."""
    poly = [(1020.0, 1020.0), (1040.0, 1020.0), (1040.0, 1040.0), (1020.0, 1040.0)]
    objects = spark.createDataFrame([("s", 1, p, 7 + p, [{"x": x + 1024 * p, "y": y} for x, y in poly]) for p in (0, 1)], "slide string, fov int, patch_idx int, object_idx long, polygon array<struct<x: double, y: double>>")
    places = [(1021.5, 1022.5), (1023.9, 1023.9), (1030.0, 1030.0), (1019.0, 1022.0)]
    points = spark.createDataFrame([("s", 1, p, k + 10 * p, "g", x + 1024 * p, y) for p in (0, 1) for k, (x, y) in enumerate(places)], "slide string, fov int, patch_idx int, point_id long, target string, x double, y double")
    assert sorted(r["point_id"] for r in A.assign_points(points, objects, "last", pixel=True).collect()) == [0, 1, 10, 11]
    assert sorted(r["point_id"] for r in A.assign_points(points, objects, "greedy").collect()) == [0, 1, 2, 10, 11, 12]


def test_tiles_as_the_whole_outline(spark):
    """Crossed, concave and long outlines: the edges of a point's bin and the carried parity say what all edges say, for
    points on the grid's lines, on vertices and anywhere."""
    import math
    import random

    from fieldloom.functions import geometry as G

    rng = random.Random(4)
    long = [(round(400 + (300 + 40 * math.sin(40 * t)) * math.cos(t), 2), round(400 + (300 + 40 * math.sin(40 * t)) * math.sin(t), 2)) for t in (2 * math.pi * k / 2000 for k in range(2000))]
    outlines = [long, [(0, 0), (640, 0), (640, 640), (0, 640)], [(64, 64), (128, 64), (128, 128), (64, 128)], [(5, 5)], [(5, 5), (50, 50)]]
    outlines += [[(rng.randint(-100, 700), rng.randint(-100, 700)) for _ in range(n)] for n in (3, 5, 8, 20)]
    schema = f"slide string, fov int, object_idx long, polygon {POLYGON.simpleString()}"
    objects = spark.createDataFrame([("S", 0, k, [{"x": float(x), "y": float(y)} for x, y in p]) for k, p in enumerate(outlines)], schema)
    at = [(rng.uniform(-150, 800), rng.uniform(-150, 800)) for _ in range(600)] + [(rng.randrange(-128, 800, 64), rng.randrange(-128, 800, 64)) for _ in range(100)]
    at += [(rng.randint(-110, 710), rng.randint(-110, 710)) for _ in range(200)] + [p for o in outlines[1:] for p in o]
    points = spark.createDataFrame([("S", 0, k, float(x), float(y)) for k, (x, y) in enumerate(at)], "slide string, fov int, point_id long, x double, y double")
    want = {(r[0], r[1]) for r in points.join(objects, ["slide", "fov"]).where(G.contains(F.col("polygon"), F.col("x"), F.col("y"))).select("point_id", "object_idx").collect()}
    for size in (64, 50):
        got = {(r[0], r[1]) for r in A.candidates(points, objects, ("slide", "fov"), size=size).select("point_id", "object_idx").collect()}
        assert got == want
    assert len(want) > 500
    tiles = A.edge_tiles(objects.where("object_idx = 0"), 64, "polygon")
    most = tiles.agg(F.max(F.size("_near") + F.size("_far")).alias("n")).first()["n"]
    assert most < 130  # of 2,000 edges


def test_pixels_on_borders(spark):
    """The pixel rule counts points on an outline's border, also on a bin's line."""
    objects = spark.createDataFrame([("S", 0, 0, 1, box(10, 64, 128, 200))], f"slide string, fov int, patch_idx int, object_idx long, polygon {POLYGON.simpleString()}")
    at = [(10, 64), (128, 200), (128, 100), (64, 64), (64, 200), (129, 100), (9, 100), (70, 201)]
    points = spark.createDataFrame([("S", 0, 0, k, float(x), float(y)) for k, (x, y) in enumerate(at)], "slide string, fov int, patch_idx int, point_id long, x double, y double")
    assert sorted(r[0] for r in A.candidates(points, objects, pixel=True).select("point_id").collect()) == [0, 1, 2, 3, 4]


def test_large_and_small_boxes_meet_once(spark):
    """Boxes of all sizes: each overlapping pair once, and a wide one isn't copied to all fine bins."""
    import random

    rng = random.Random(8)
    boxes = [(x := rng.uniform(0, 4000), y := rng.uniform(0, 4000), x + rng.choice([5, 60, 400, 900, 4000]), y + rng.choice([5, 60, 400, 900, 4000])) for _ in range(120)]
    boxes += [(128, 128, 256, 256), (0, 0, 128, 128), (256, 0, 1024, 128), (0, 0, 4256, 4256)]
    objects = spark.createDataFrame([("S", 0, k, box(*b)) for k, b in enumerate(boxes)], f"slide string, fov int, object_idx long, polygon {POLYGON.simpleString()}")
    pairs = A.overlapping_pairs(objects, objects)
    got = [(r["a_idx"], r["b_idx"]) for r in pairs.collect()]
    want = {(i, j) for i, p in enumerate(boxes) for j, q in enumerate(boxes) if min(p[2], q[2]) > max(p[0], q[0]) and min(p[3], q[3]) > max(p[1], q[1])}
    assert len(got) == len(set(got)) and set(got) == want
    areas = A.with_shared_area(pairs, objects, objects).select("shared", "box_area").collect()
    assert len(areas) == len(want) and all(r["shared"] == r["box_area"] for r in areas)


def test_shared_area_fetches_curved_outlines(spark):
    """A triangle with a box and with another triangle, both ways."""
    schema = f"slide string, fov int, object_idx long, polygon {POLYGON.simpleString()}"
    rows = [("S", 0, 1, [{"x": 0.0, "y": 0.0}, {"x": 8.0, "y": 0.0}, {"x": 0.0, "y": 8.0}]), ("S", 0, 2, box(0, 0, 4, 4)), ("S", 0, 3, [{"x": 0.0, "y": 0.0}, {"x": 8.0, "y": 0.0}, {"x": 8.0, "y": 8.0}])]
    objects = spark.createDataFrame(rows, schema)
    got = {(r["a_idx"], r["b_idx"]): r["shared"] for r in A.with_shared_area(A.overlapping_pairs(objects, objects), objects, objects).collect()}
    assert got == pytest.approx({(1, 1): 32, (1, 2): 16, (2, 1): 16, (1, 3): 16, (3, 1): 16, (2, 2): 16, (2, 3): 8, (3, 2): 8, (3, 3): 32})


def test_tubes_drawn_alike_meet_once(spark, monkeypatch):
    """A nucleus meets an outline once, however many tubes have it, and boxes pass no join for their outlines."""
    schema = f"slide string, fov int, patch_idx int, object_idx long, polygon {POLYGON.simpleString()}"
    nuclei = spark.createDataFrame([("S", 0, 0, k, box(10 * k, 0, 10 * k + 10, 10)) for k in range(3)] + [("S", 0, 0, 3, [{"x": float(x), "y": float(y)} for x, y in ((31, 1), (39, 1), (35, 9))])], schema)
    tubes = spark.createDataFrame([("S", 0, 3, 100 - k, box(0, 0, 100, 10)) for k in range(50)] + [("S", 1, 3, 7, box(0, 0, 100, 10))], schema)
    met, fetched, own, joined = [], [], A.overlapping_pairs, A.with_shared_area

    def counted(*args, **kw):
        pairs = own(*args, **kw)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(A, "overlapping_pairs", counted)
    monkeypatch.setattr(A, "with_shared_area", lambda pairs, *rest: (fetched.append(pairs.count()), joined(pairs, *rest))[1])
    links = {r["nuc_idx"]: (r["myo_idx"], r["overlap_frac"]) for r in A.link_objects(nuclei, tubes).collect()}
    assert links == {k: (51, pytest.approx(1.0)) for k in range(4)}
    assert sum(met) == 4 and sum(fetched) == 1


def test_rules_over_many_layers(spark, monkeypatch):
    """Each rule under 70 layers of outlines, some drawn twice, against all pairs; none but ``shared`` makes a row a pair."""
    import random

    rng = random.Random(2)
    outlines = [[(rng.randint(-20, 220), rng.randint(-20, 220)) for _ in range(rng.choice((3, 4, 6, 9)))] for _ in range(60)]
    outlines += [outlines[k] for k in range(0, 20, 2)] + [[], [(3, 3)]]
    schema = f"slide string, fov int, patch_idx int, object_idx long, polygon {POLYGON.simpleString()}"
    objects = spark.createDataFrame([("S", 0, k % 2, 7 * k % 73, [{"x": float(x) + 1024 * (k % 2), "y": float(y)} for x, y in p]) for k, p in enumerate(outlines)] + [("S", None, 0, 99, box(0, 0, 9, 9))], schema)
    at = [(rng.choice((rng.uniform(-30, 230), rng.randint(-30, 230))), rng.choice((rng.uniform(-30, 230), rng.randint(-30, 230)))) for _ in range(400)]
    points = spark.createDataFrame([("S", 0, k % 2, (k, str(k)), "g", float(x) + 1024 * (k % 2), float(y)) for k, (x, y) in enumerate(at)] + [("S", None, 0, (900, None), "g", 1.0, 1.0)], "slide string, fov int, patch_idx int, point_id struct<a: long, b: string>, target string, x double, y double")

    def held(pixel):
        out = {}
        for r in A.candidates(points, objects, pixel=pixel).collect():
            out.setdefault(r["point_id"]["a"], []).append(r["object_idx"])
        return out

    exact, pixels = held(False), held(True)
    assert max(map(len, exact.values())) > 15
    monkeypatch.setattr(A, "candidates", lambda *a, **k: pytest.fail("a row for each pair"))
    rows = points.unionByName(points.where("point_id.a < 5"))  # some are there twice

    def got(rule, **kw):
        found = A.assign_points(rows, objects, rule, **kw).collect()
        assert len({r["point_id"]["a"] for r in found}) == len(found) and all(r["target"] == "g" for r in found)
        return {r["point_id"]["a"]: r["objects"] if rule == "random" else r["object_idx"] for r in found}

    assert got("greedy") == {k: min(v) for k, v in exact.items()}
    assert got("last", pixel=True) == {k: max(v) for k, v in pixels.items()}
    assert got("null") == {k: v[0] for k, v in exact.items() if len(v) == 1}
    assert got("random") == {k: sorted(v) for k, v in exact.items()}
    painted = {r["point_id"]["a"]: r["object_idx"] for r in A.assign_painted(rows, objects).collect()}
    assert painted == {k: min(v) for k, v in exact.items()} | {k: max(v) for k, v in pixels.items()}


@pytest.mark.parametrize("rule", ["first", "only", "all", "try"])
def test_search_goes_on_across_batches(monkeypatch, rule):
    """A bin's tiles and points may come in any number of batches; a point that has its object is tested no further."""
    import pyarrow as pa

    from fieldloom.functions import search as S

    def tile(b, k, x0, x1):
        edges = [{"ix": x1, "iy": 8.0, "jx": x1, "jy": 0.0}, {"ix": x0, "iy": 0.0, "jx": x0, "jy": 8.0}]
        return {"b": b, "object_idx": k, "_box": {"x0": x0, "y0": 0.0, "x1": x1, "y1": 8.0}, "_near": edges, "_far": [], "_odd": False, "_px": None, "_py": None, "p": None}

    def point(b, p, x):
        return {"b": b, "object_idx": None, "_box": None, "_near": None, "_far": None, "_odd": None, "_px": x, "_py": 4.0, "p": p}

    rows = [tile("u", k, float(k % 3), 90.0) for k in range(40)] + [point("u", k, k / 2) for k in range(30)]
    rows += [point("v", 0, 1.0)] + [tile("w", 7, 0.0, 5.0)] + [point("w", k // 2, 4.0 + k // 2) for k in range(6)]
    f, i = pa.float64(), pa.int64()
    near = pa.list_(pa.struct([(c, f) for c in ("ix", "iy", "jx", "jy")]))
    schema = pa.schema([("b", pa.string()), ("object_idx", i), ("_box", pa.struct([(c, f) for c in ("x0", "y0", "x1", "y1")])), ("_near", near), ("_far", pa.list_(f)), ("_odd", pa.bool_()), ("_px", f), ("_py", f), ("p", i)])
    tested, hold = [], S.Tiles.hold
    monkeypatch.setattr(S.Tiles, "hold", lambda self, x, y, t, border: (tested.append(len(t)), hold(self, x, y, t, border))[1])
    found = []
    for size, pairs in ((1000, 10**6), (3, 5), (1, 1)):
        monkeypatch.setattr(S, "ROWS", size)
        monkeypatch.setattr(S, "PAIRS", pairs)
        tested.clear()
        batches = [pa.RecordBatch.from_pylist(rows[k : k + size], schema=schema) for k in range(0, len(rows), size)]
        found.append([tuple(r.values()) for b in S.Search(rule, ["b"], "p", ["b", "p"], False)(iter(batches)) for r in b.to_pylist()])
        assert rule in ("all", "only") or sum(tested) < 300  # of 1,200 pairs
    assert found[0] == found[1] == found[2]
    layers = [[k for k in range(40) if x / 2 >= k % 3] for x in range(30)]
    want = {"first": lambda v: v[0], "try": lambda v: v[0], "only": lambda v: None, "all": lambda v: v}[rule]
    assert [r[2] for r in found[0] if r[0] == "u"] == [want(v) for v in layers if rule != "only"]
    assert [r[:2] for r in found[0] if r[0] == "v"] == ([("v", 0)] if rule == "try" else [])
    assert [r[1] for r in found[0] if r[0] == "w"] == ([0, 1, 2] if rule == "try" else [0])


def test_containment_of_outlines_drawn_alike(spark, monkeypatch):
    """Copies count as often as they are there, meet nothing twice, and of the largest ones only the first is kept."""
    rows = [("a", k, box(0, 0, 100, 100)) for k in (5, 3, 9)] + [("a", 20 + k, box(10, 10, 20, 20)) for k in range(30)]
    rows += [("a", 60 + k, box(40, 40, 80, 80)) for k in range(2)] + [("a", 70 + k, box(50, 50, 60, 60)) for k in range(2)]  # two inside: they go
    rows += [("a", 80 + k, box(40, 84, 60, 96)) for k in range(2)] + [("a", 90 + k, box(45, 86, 50, 90)) for k in range(3)]  # three inside: it goes
    rows += [("b", 1, box(0, 0, 9, 9)), ("b", 2, box(1, 1, 3, 3)), ("b", 3, box(1, 1, 3, 3)), ("b", 4, [])]
    objects = spark.createDataFrame(rows, f"image_name string, object_idx long, polygon {POLYGON.simpleString()}")

    def within(p, q):
        return p and q and p != q and all(q[0]["x"] <= c["x"] <= q[2]["x"] and q[0]["y"] <= c["y"] <= q[2]["y"] for c in p)

    want = {(f, j, i) for f, i, p in rows for g, j, q in rows if f == g and within(p, q)}
    met, own = [], A.overlapping_pairs

    def counted(*args, **kw):
        pairs = own(*args, **kw)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(A, "overlapping_pairs", counted)
    found = [tuple(r) for r in O.contained_pairs(objects).select("image_name", "large_idx", "small_idx").collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert sum(met) <= 40  # pairs of outlines with area in common; of objects more than 1,000
    by = {}
    for f, j, i in want:
        by.setdefault((f, j), set()).add((f, i))
    gone = set()
    for large, inside in by.items():
        gone |= {large} if len(inside) >= 3 and large != ("a", 3) else inside
    assert {(r["image_name"], r["object_idx"]) for r in O.removals(objects).collect()} == gone


def test_intensity_of_tubes_drawn_alike(spark, monkeypatch):
    """A pixel meets an outline once, however many tubes have it; values with repeats, one, none and null."""
    import statistics

    from fieldloom.operators import measure as M

    tubes = spark.createDataFrame([("S", 0, k, box(0, 0, 100, 100)) for k in range(20)] + [("S", 0, 30, box(200, 0, 300, 100)), ("S", 0, 31, box(500, 0, 600, 100)), ("S", 0, 32, box(700, 0, 800, 100)), ("S", 1, 0, box(200, 0, 300, 100))], f"slide string, fov int, object_idx long, polygon {POLYGON.simpleString()}")
    values = [3.0, 3.0, 7.5, 1.0, 3.0, 9.0, None]
    points = spark.createDataFrame([("S", 0, k, 5.5 + k, 5.5, v) for k, v in enumerate(values)] + [("S", 0, 50, 250.5, 5.5, 4.0), ("S", 0, 51, 750.5, 5.5, None)], "slide string, fov int, point_id long, x double, y double, value double")
    met, own = [], A.assign_points

    def counted(*args, **kw):
        found = own(*args, **kw)
        met.append(found.count())
        return found

    monkeypatch.setattr(A, "assign_points", counted)
    got = {(r["fov"], r["object_idx"]): (r["average_intensity"], r["median_intensity"], r["stddev_intensity"]) for r in M.intensity_in_tubes(points, tubes).collect()}
    known = [v for v in values if v is not None]
    want = {(0, k): pytest.approx((statistics.mean(known), statistics.median(known), statistics.stdev(known))) for k in range(20)}
    assert got == want | {(0, 30): (4.0, 4.0, None), (0, 32): (None, None, None)}
    assert met == [len(values) + 2]


def test_shared_counts_without_pairs(spark, monkeypatch):
    """Counts of the shared rule by rows of pixels and by pairs, over concave and crossed outlines, against all pairs."""
    import random

    rng = random.Random(6)
    outlines = [[(rng.choice((rng.randint(-20, 220), rng.uniform(-20, 220))), rng.choice((rng.randint(-20, 220), rng.uniform(-20, 220)))) for _ in range(rng.choice((3, 4, 6, 9)))] for _ in range(50)] + [[], [(3, 3)]]
    objects = spark.createDataFrame([("S", 0, k % 2, k, [{"x": float(x) + 1024 * (k % 2), "y": float(y)} for x, y in p]) for k, p in enumerate(outlines)], f"slide string, fov int, patch_idx int, object_idx long, polygon {POLYGON.simpleString()}")
    at = [(rng.randrange(0, 128, 4), rng.randrange(0, 128, 8)) for _ in range(900)] + [(rng.uniform(-30, 230), rng.uniform(-30, 230)) for _ in range(100)]
    points = spark.createDataFrame([("S", 0, k % 2, k, rng.choice(("g", "h", None)), float(x) + 1024 * (k % 2), float(y)) for k, (x, y) in enumerate(at)], "slide string, fov int, patch_idx int, point_id long, target string, x double, y double")
    want = sorted(map(repr, A.count_matrix(A.assign_points(points, objects, "shared")).collect()))
    monkeypatch.setattr(A, "candidates", lambda *a, **k: pytest.fail("a row for each pair"))
    assert sorted(map(repr, A.shared_counts(points, objects).collect())) == want and len(want) > 50
