"""Geometry of outlines, as expressions on columns of array<struct<x, y>>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PATCH = 1024
GRID_COLUMNS = 4
#: Keeps the slope of a level edge finite in the crossing test; a fixed value of the rule.
LEVEL = 1e-12


def polygon(*points: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points))


def shifted(poly: Column) -> Column:
    """The outline from its second point, the first one last."""
    return F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1))


def edges(poly: Column) -> Column:
    """Each point with the next one: array<struct<ax, ay, bx, by>>."""
    return F.zip_with(poly, shifted(poly), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def moved(poly: Column, dx: Column, dy: Column, scale: Column | float = 1.0) -> Column:
    scale = F.lit(scale) if isinstance(scale, float) else scale
    return F.transform(poly, lambda p: F.struct((p["x"] * scale + dx).alias("x"), (p["y"] * scale + dy).alias("y")))


def patch_offset(patch: Column, columns: int = GRID_COLUMNS, size: int = PATCH) -> tuple[Column, Column]:
    return (patch % columns) * size, F.floor(patch / columns) * size


def bounding_box(poly: Column) -> Column:
    """struct<x0, y0, x1, y1>."""
    xs, ys = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def box_area(poly: Column) -> Column:
    """Area of an outline's bounding box."""
    box = bounding_box(poly)
    return (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])


def on_edge(local: Column, threshold: float = 5.0, size: int = PATCH) -> Column:
    """Whether an outline in patch coordinates comes within the threshold of the patch's border, the threshold included."""
    box = bounding_box(local)
    return (box["x0"] <= threshold) | (box["y0"] <= threshold) | (box["x1"] >= size - threshold) | (box["y1"] >= size - threshold)


def area(poly: Column) -> Column:
    """Absolute area; 0 under three points."""
    twice = F.aggregate(edges(poly), F.lit(0.0), lambda acc, e: acc + e["ax"] * e["by"] - e["bx"] * e["ay"])
    return F.when(F.size(poly) >= 3, F.abs(twice) / 2).otherwise(F.lit(0.0))


def perimeter(poly: Column) -> Column:
    """Closed length; 0 under two points."""
    total = F.aggregate(edges(poly), F.lit(0.0), lambda acc, e: acc + F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))
    return F.when(F.size(poly) >= 2, total).otherwise(F.lit(0.0))


#: Outlines of so many points at most have all their pairs compared; longer ones go by their hull.
FEW_POINTS = 32


def major_axis(poly: Column) -> Column:
    """Largest distance between two points; 0 under two. Of a long outline only its convex hull is walked round."""
    from fieldloom.functions.kernels import hull_diameter

    long = F.size(poly) > FEW_POINTS
    return F.when(long, hull_diameter(F.when(long, poly))).otherwise(largest_distance(F.when(~long, poly)))


def largest_distance(poly: Column) -> Column:
    """Over all pairs of points; 0 under two."""
    far = F.transform(poly, lambda p: F.array_max(F.transform(poly, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))))
    return F.coalesce(F.array_max(far), F.lit(0.0))


def circularity(area_px: Column, perimeter_px: Column) -> Column:
    """4 pi A / P^2 within [0, 1]; 0 if degenerate."""
    return F.when(perimeter_px > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(4 * math.pi) * area_px / (perimeter_px * perimeter_px)))).otherwise(F.lit(0.0))


def centroid(poly: Column) -> Column:
    """Centroid of the area, struct<x, y>; the mean of the points if the area is 0."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, e: Column) -> Column:
        c = e["ax"] * e["by"] - e["bx"] * e["ay"]
        return F.struct((acc["a"] + c).alias("a"), (acc["x"] + (e["ax"] + e["bx"]) * c).alias("x"), (acc["y"] + (e["ay"] + e["by"]) * c).alias("y"))

    s = F.aggregate(edges(poly), zero, add)
    n = F.greatest(F.size(poly), F.lit(1))
    mean = [F.aggregate(poly, F.lit(0.0), lambda acc, p: acc + p["x"]) / n, F.aggregate(poly, F.lit(0.0), lambda acc, p: acc + p["y"]) / n]
    flat = F.abs(s["a"]) < 1e-12
    return F.struct(F.when(flat, mean[0]).otherwise(s["x"] / (3 * F.when(flat, F.lit(1.0)).otherwise(s["a"]))).alias("x"), F.when(flat, mean[1]).otherwise(s["y"] / (3 * F.when(flat, F.lit(1.0)).otherwise(s["a"]))).alias("y"))


def principal_angle(poly: Column) -> Column:
    """Angle of the main axis of the points' covariance, the closing point counted twice; in (-pi/2, pi/2]."""
    closed = F.concat(poly, F.slice(poly, 1, 1))
    n = F.size(closed).cast("double")
    mx = F.aggregate(closed, F.lit(0.0), lambda acc, p: acc + p["x"]) / n
    my = F.aggregate(closed, F.lit(0.0), lambda acc, p: acc + p["y"]) / n
    zero = F.struct(F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"), F.lit(0.0).alias("xy"))
    s = F.aggregate(
        closed, zero, lambda acc, p: F.struct((acc["xx"] + (p["x"] - mx) * (p["x"] - mx)).alias("xx"), (acc["yy"] + (p["y"] - my) * (p["y"] - my)).alias("yy"), (acc["xy"] + (p["x"] - mx) * (p["y"] - my)).alias("xy"))
    )
    return F.atan2(2 * s["xy"], s["xx"] - s["yy"]) / 2


def back_edges(poly: Column) -> Column:
    """Each point (j) with the next one (i): array<struct<ix, iy, jx, jy>>, as the crossing test takes them."""
    return F.zip_with(shifted(poly), poly, lambda i, j: F.struct(i["x"].alias("ix"), i["y"].alias("iy"), j["x"].alias("jx"), j["y"].alias("jy")))


def crossed(e: Column, x: Column, y: Column) -> Column:
    """Whether the ray from the point to the right crosses an edge of :func:`back_edges`; half-open along edges."""
    return ((e["iy"] > y) != (e["jy"] > y)) & (x < (e["jx"] - e["ix"]) * (y - e["iy"]) / (e["jy"] - e["iy"] + LEVEL) + e["ix"])


def contains(poly: Column, x: Column, y: Column) -> Column:
    """Even-odd test by edges crossed to the right of the point; half-open along edges."""
    return F.size(F.filter(back_edges(poly), lambda e: crossed(e, x, y))) % 2 == 1


def on_edge_of(e: Column, x: Column, y: Column) -> Column:
    """Whether the point lies on an edge of :func:`back_edges` itself."""
    cross = (e["ix"] - e["jx"]) * (y - e["jy"]) - (e["iy"] - e["jy"]) * (x - e["jx"])
    return (cross == 0) & (x >= F.least(e["ix"], e["jx"])) & (x <= F.greatest(e["ix"], e["jx"])) & (y >= F.least(e["iy"], e["jy"])) & (y <= F.greatest(e["iy"], e["jy"]))


def touches(poly: Column, x: Column, y: Column) -> Column:
    """Whether the point lies on the outline itself."""
    return F.exists(back_edges(poly), lambda e: on_edge_of(e, x, y))


def rounded(poly: Column, size: int | None = None) -> Column:
    """Points rounded half to even, as pixels; clipped to the patch if its size is given."""

    def at(v: Column) -> Column:
        r = F.rint(v)
        return r if size is None else F.least(F.lit(size - 1.0), F.greatest(F.lit(0.0), r))

    return F.transform(poly, lambda p: F.struct(at(p["x"]).alias("x"), at(p["y"]).alias("y")))


def patch_of_point(x: Column, y: Column, columns: int = GRID_COLUMNS, rows: int = GRID_COLUMNS, size: int = PATCH) -> Column:
    """Patch of a point in field coordinates, clamped to the grid."""
    px = F.least(F.lit(columns - 1), F.greatest(F.lit(0), F.floor(x / size).cast("int")))
    py = F.least(F.lit(rows - 1), F.greatest(F.lit(0), F.floor(y / size).cast("int")))
    return (py * columns + px).cast("int")


def min_max(value: Column, low: Column, high: Column) -> Column:
    """A value within its group's range as a share of it; the range counts as 1e-9 at least."""
    return (value - low) / F.greatest(high - low, F.lit(1e-9))
