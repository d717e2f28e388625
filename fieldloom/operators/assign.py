"""Points to objects, objects to objects: spatial joins by equal bins, then exact tests.

A point lies in one bin, an outline in the bins it meets or covers. The equi-join on field, patch and bin is what
shuffles; the box and the crossing test are residual conditions of the same join. No bin gets a whole outline: for points
it gets the edges near it and what all the others come to, for outlines their boxes, on a coarser grid for large ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import geometry as G
from fieldloom.functions.kernels import overlap_area
from fieldloom.functions.search import TILE, Search
from fieldloom.operators.order import placed, placed_within
from fieldloom.sessions import spread

BIN = 64
RULES = ("greedy", "shared", "null", "random", "last")
FIELD = ("slide", "fov")
PATCH = (*FIELD, "patch_idx")


def bins(low: Column, high: Column, size: int) -> Column:
    return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))


def edge_tiles(objects: DataFrame, size: int = BIN, polygon: str = "polygon") -> DataFrame:
    """Objects, without the outline, once for each bin (_bx, _by) that may hold a point of theirs.

    The crossing test counts the edges that a point's ray to the right meets. For points of one bin, edges above, below
    and left of it never count. Of those wholly to the right only the heights between which they run matter: the parity
    of all that do is that of the ends above the point, and an end that two such edges share cancels out. So a bin has
    ``_near``, the edges within its reach, ``_far``, the heights within its band of the ends that don't cancel, and
    ``_odd``, the parity of the ends above its band. A bin with none of the three lies outside and has no row.
    """
    rows = objects.where(F.size(polygon) > 0).withColumns({"_box": G.bounding_box(F.col(polygon)), "_edges": G.back_edges(F.col(polygon))}).drop(polygon)
    rows = rows.withColumn("_by", F.explode(bins(F.col("_box.y0"), F.col("_box.y1"), size)))
    low, high = F.col("_by") * F.lit(float(size)), (F.col("_by") + 1) * F.lit(float(size))
    band = F.filter("_edges", lambda e: (F.greatest(e["iy"], e["jy"]) >= low) & (F.least(e["iy"], e["jy"]) <= high))
    rows = rows.withColumn("_edges", band).withColumn("_bx", F.explode(bins(F.col("_box.x0"), F.col("_box.x1"), size)))
    left, right = F.col("_bx") * F.lit(float(size)), (F.col("_bx") + 1) * F.lit(float(size))

    def beyond(e: Column) -> Column:
        """To the right of all the bin's points, with room for rounding; level edges are left to the test itself."""
        return (F.least(e["ix"], e["jx"]) > right + 1e-3 + 1e-5 * F.abs(e["ix"] - e["jx"])) & (F.abs(e["iy"] - e["jy"]) >= 1e-6)

    def before(e: Column) -> Column:
        return (F.greatest(e["ix"], e["jx"]) < left - 1e-3 - 1e-5 * F.abs(e["ix"] - e["jx"])) & (F.abs(e["iy"] - e["jy"]) >= 1e-6)

    edges = F.col("_edges")  # an end inside the band has both its edges in it, one after the other
    ends = F.zip_with(edges, G.shifted(edges), lambda e, after: F.when((e["iy"] > low) & (e["iy"] < high) & (beyond(e) != beyond(after)), e["iy"]))
    above = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(beyond(e), (e["iy"] >= high).cast("int") + (e["jy"] >= high).cast("int")).otherwise(0))
    tiled = rows.withColumns({"_near": F.filter(edges, lambda e: ~beyond(e) & ~before(e)), "_far": F.filter(ends, lambda v: v.isNotNull()), "_odd": above % 2 == 1}).drop("_edges")
    return tiled.where((F.size("_near") > 0) | (F.size("_far") > 0) | F.col("_odd"))


def in_tile(x: Column, y: Column) -> Column:
    """Whether a point of the bin lies in the object of :func:`edge_tiles`."""
    met = F.size(F.filter("_near", lambda e: G.crossed(e, x, y))) + F.size(F.filter("_far", lambda v: v > y)) + F.col("_odd").cast("int")
    return met % 2 == 1


def framed(points: DataFrame, objects: DataFrame, keys: Sequence[str], *, pixel: bool, size: int = BIN, patch_size: int = G.PATCH) -> tuple[DataFrame, DataFrame]:
    """Points with their place and bin (_px, _py, _bx, _by), and objects (keys, object_idx, _poly), in the frame of the rule."""
    dx, dy = G.patch_offset(F.col("patch_idx"), size=patch_size) if "patch_idx" in keys else (F.lit(0), F.lit(0))
    x, y = (F.col("x") - dx).cast("long").cast("double") if pixel else F.col("x"), (F.col("y") - dy).cast("long").cast("double") if pixel else F.col("y")
    placed = points.withColumns({"_px": x, "_py": y})
    placed = placed.withColumns({"_bx": F.floor(F.col("_px") / size).cast("int"), "_by": F.floor(F.col("_py") / size).cast("int")})
    return placed, objects.select(*keys, "object_idx", (G.rounded(G.moved(F.col("polygon"), -dx, -dy), patch_size) if pixel else F.col("polygon")).alias("_poly"))


def in_patch(patch_size: int = G.PATCH) -> Column:
    return (F.col("_px") >= 0) & (F.col("_py") >= 0) & (F.col("_px") < patch_size) & (F.col("_py") < patch_size)


def candidates(points: DataFrame, objects: DataFrame, keys: Sequence[str] = PATCH, *, pixel: bool = False, size: int = BIN, patch_size: int = G.PATCH) -> DataFrame:
    """Each point (its columns) with each object (object_idx) of the same ``keys`` that holds it.

    With ``pixel``, both are taken in their patch's own frame: the point is its whole pixel, the outline is rounded half
    to even and clipped to the patch, its border included, and points outside of their patch are left out.
    """
    placed, slim = framed(points, objects, keys, pixel=pixel, size=size, patch_size=patch_size)
    if pixel:
        placed = placed.where(in_patch(patch_size))
    tiles = edge_tiles(slim, size, "_poly")
    near = placed.join(tiles, [*keys, "_bx", "_by"]).where((F.col("_px") >= F.col("_box.x0")) & (F.col("_px") <= F.col("_box.x1")) & (F.col("_py") >= F.col("_box.y0")) & (F.col("_py") <= F.col("_box.y1")))
    inside = in_tile(F.col("_px"), F.col("_py"))
    if pixel:
        inside = inside | F.exists("_near", lambda e: G.on_edge_of(e, F.col("_px"), F.col("_py")))
    return near.where(inside).select(*points.columns, "object_idx", "_bx", "_by")


def searched(points: DataFrame, objects: DataFrame, keys: Sequence[str], rule: str, *, point: str = "point_id", pixel: bool = False, last: bool = False) -> DataFrame:
    """Points with their object_idx, or all ``_objects``, by a rule of :class:`search.Search`, from the first object by
    index on or from the ``last`` one.

    Tiles and points of a bin come in one stream, so that a point that has its object meets no other: its work doesn't
    grow with the number of outlines over it, and no row is made for each pair. Outlines drawn alike are one.
    """
    placed, slim = framed(points, objects, keys, pixel=pixel)
    if pixel and rule != "try":  # beyond its patch no tile lies
        placed = placed.where(in_patch())
    if rule != "all":
        ends = [F.min("object_idx"), F.max("object_idx")]
        slim = slim.groupBy(*keys, "_poly").agg(F.struct(F.count("*").alias("n"), *(e.alias(n) for e, n in zip(ends, "ab", strict=True))).alias("_i"))
        index = F.explode(F.when(F.col("_i.n") > 1, F.array("_i.a", "_i.b")).otherwise(F.array("_i.a"))) if rule == "only" else F.col("_i.b" if last else "_i.a")
        slim = slim.select(*keys, index.alias("object_idx"), "_poly")
    by = [*keys, "_bx", "_by"]
    rest = [c for c in points.columns if c not in keys]
    tiles = edge_tiles(slim, polygon="_poly").select(*by, *TILE)
    known = " and ".join(f"`{c}` is not null" for c in by)
    rows = tiles.where(known).unionByName(placed.where(known).select(*by, "_px", "_py", *(F.col(c).alias(f"_own_{c}") for c in rest)), allowMissingColumns=True)
    first = F.col("object_idx").desc_nulls_last() if last else F.col("object_idx").asc_nulls_last()
    dealt = rows.repartition(*by).sortWithinPartitions(*by, first, f"_own_{point}")
    own = points.schema
    columns = [*keys, *(f"_own_{c}" for c in rest)]
    index = objects.schema["object_idx"].dataType
    out = T.StructType([*(T.StructField(c, own[c.removeprefix("_own_")].dataType) for c in columns), T.StructField("_objects", T.ArrayType(index)) if rule == "all" else T.StructField("object_idx", index)])
    found = dealt.mapInArrow(Search(rule, by, f"_own_{point}", columns, pixel), out)
    return found.select(*(F.col(c if c in keys else f"_own_{c}").alias(c) for c in points.columns), out[-1].name)


def assign_points(points: DataFrame, objects: DataFrame, rule: str = "greedy", *, keys: Sequence[str] = PATCH, point: str = "point_id", pixel: bool = False, seed: int = 0) -> DataFrame:
    """Points with the object_idx that they count for. ``point`` identifies a point within ``keys``.

    ``greedy``: the first object by index that holds the point; ``last``: the last one, as if painted over;
    ``shared``: every one; ``null``: only points with just one; ``random``: points in just one directly, and those in
    the same several dealt to them in turn by a seeded hash, so that shares differ by one at most and reruns agree.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    if rule == "shared":
        return candidates(points, objects, keys, pixel=pixel).drop("_bx", "_by")
    if rule in ("greedy", "last"):
        return searched(points, objects, keys, "first", point=point, pixel=pixel, last=rule == "last")
    if rule == "null":
        return searched(points, objects, keys, "only", point=point, pixel=pixel)
    sets = searched(points, objects, keys, "all", point=point, pixel=pixel)
    single = sets.where(F.size("_objects") == 1).withColumn("object_idx", F.col("_objects")[0])
    # sets by 128 bits of digest: the lists themselves aren't compared
    digests = {f"_set{k}": F.xxhash64(F.lit(k), F.col("_objects")) for k in (0, 1)}
    several = placed_within(sets.where(F.size("_objects") > 1).withColumns(digests), [*keys, *digests], F.xxhash64(F.lit(seed), F.col(point)), F.col(point), name="_turn", start=0)
    dealt = several.withColumn("object_idx", F.element_at("_objects", (F.col("_turn") % F.size("_objects") + 1).cast("int"))).drop("_turn", *digests)
    return single.unionByName(dealt).select(*points.columns, "object_idx", F.col("_objects").alias("objects"))


def assign_painted(points: DataFrame, objects: DataFrame, *, keys: Sequence[str] = PATCH, point: str = "point_id") -> DataFrame:
    """Points by whole pixels to the object painted last; the rest by the greedy rule on exact outlines."""
    tried = searched(points, objects, keys, "try", point=point, pixel=True, last=True)
    missed = tried.where(F.col("object_idx").isNull()).drop("object_idx")
    return tried.where(F.col("object_idx").isNotNull()).unionByName(assign_points(missed, objects, "greedy", keys=keys, point=point))


def count_matrix(assigned: DataFrame, keys: Sequence[str] = PATCH) -> DataFrame:
    """Non-zero counts: keys, object_idx, gene, n."""
    return assigned.groupBy(*keys, "object_idx", F.col("target").alias("gene")).agg(F.count("*").alias("n"))


def shared_counts(points: DataFrame, objects: DataFrame, keys: Sequence[str] = PATCH) -> DataFrame:
    """:func:`count_matrix` of the shared rule, without a row for each point and object: the points of a bin are counted
    by rows (:func:`search.by_rows`)."""
    placed, slim = framed(points, objects, keys, pixel=False)
    by = [*keys, "_bx", "_by"]
    known = " and ".join(f"`{c}` is not null" for c in by)
    tiles = edge_tiles(spread(slim), polygon="_poly").select(*by, *TILE)
    rows = tiles.where(known).unionByName(placed.where(known).select(*by, "_px", "_py", F.col("target").alias("_gene")), allowMissingColumns=True)
    dealt = rows.repartition(*by).sortWithinPartitions(*by, F.col("object_idx").asc_nulls_last())
    out = T.StructType([*(T.StructField(k, points.schema[k].dataType) for k in keys), T.StructField("object_idx", objects.schema["object_idx"].dataType), T.StructField("gene", points.schema["target"].dataType), T.StructField("n", T.LongType())])
    found = dealt.mapInArrow(Search("count", by, "_gene", list(keys), False), out)
    return found.groupBy(*keys, "object_idx", "gene").agg(F.sum("n").alias("n"))


def gene_index(panel: DataFrame, points: DataFrame, objects: DataFrame, keys: Sequence[str] = PATCH) -> DataFrame:
    """gene and gene_idx: the panel (gene, pos) in its order, then unseen targets of patches with objects, by name."""
    seen = points.join(objects.select(*keys).distinct(), list(keys), "left_semi").select(F.col("target").alias("gene")).distinct()
    extra = seen.join(panel, "gene", "left_anti").select("gene", F.lit(None).cast("long").alias("pos"))
    every = panel.groupBy("gene").agg(F.min("pos").cast("long").alias("pos")).unionByName(extra)
    return placed(every, F.col("pos").isNull(), F.col("pos"), F.col("gene"), name="gene_idx", start=0).select("gene", "gene_idx")


def measured(objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, object_idx, polygon, area, box, is_box) of outlines with points, or ``objects`` if they have these already.

    Outlines are dealt out before they are measured. Each is measured once: no filter on a measure passes the generator.
    """
    if "is_box" in objects.columns:
        return objects
    own = spread(objects.where(F.size("polygon") > 0).select(*keys, "object_idx", "polygon"))
    rows = own.select(*keys, "object_idx", "polygon", F.inline(F.array(F.struct(G.area(F.col("polygon")).alias("area"), G.bounding_box(F.col("polygon")).alias("box")))))
    extent = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0"))
    return rows.withColumn("is_box", F.abs(F.col("area") - extent) <= 1e-12 * F.col("area"))


def overlapping_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str] = FIELD, size: int = 2 * BIN) -> DataFrame:
    """(keys, and of both sides idx, area, is_box and _box; box_area) of objects whose boxes overlap, each pair once.

    ``box_area`` is the boxes' intersection: no less than the outlines', and cheap enough to decide most pairs by. An
    outline as large as its box ``is_box``. Small boxes meet on a grid of ``size``, large ones meet each other and small
    ones on one eight times as coarse, so that no box is copied to thousands of bins. A pair shares several bins; it
    counts in the one that holds the lower left corner of the boxes' intersection.
    """
    coarse = 8 * size

    def side(objects: DataFrame, name: str, other: str) -> DataFrame:
        box = F.col(f"_{name}box")
        own = measured(objects, keys).select(*keys, F.col("object_idx").alias(f"{name}_idx"), F.col("area").alias(f"{name}_area"), F.col("is_box").alias(f"{name}_is_box"), F.col("box").alias(f"_{name}box"))
        large = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"]) > 4 * size
        # 0: small with small; the side's own name: large of this side with all of the other
        meets = F.when(large, F.array(F.lit(name), *([F.lit(other)] if name == "b" else []))).otherwise(F.array(F.lit("0"), F.lit(other)))
        own = own.withColumn("_meet", F.explode(meets))
        grid = F.when(F.col("_meet") == "0", size).otherwise(coarse)
        return own.withColumn("_bx", F.explode(F.sequence(F.floor(box["x0"] / grid), F.floor(box["x1"] / grid)))).withColumn("_by", F.explode(F.sequence(F.floor(box["y0"] / grid), F.floor(box["y1"] / grid))))

    met = side(a, "a", "b").join(side(b, "b", "a"), [*keys, "_meet", "_bx", "_by"])
    x0, y0 = F.greatest("_abox.x0", "_bbox.x0"), F.greatest("_abox.y0", "_bbox.y0")
    across, down = F.least("_abox.x1", "_bbox.x1") - x0, F.least("_abox.y1", "_bbox.y1") - y0
    boxes = (across > 0) & (down > 0)
    grid = F.when(F.col("_meet") == "0", size).otherwise(coarse)
    here = (F.floor(x0 / grid) == F.col("_bx")) & (F.floor(y0 / grid) == F.col("_by"))
    both = [c for name in "ab" for c in (f"{name}_idx", f"{name}_area", f"{name}_is_box", f"_{name}box")]
    return met.where(boxes & here).select(*keys, *both, (across * down).alias("box_area"))


def with_shared_area(pairs: DataFrame, a: DataFrame, b: DataFrame, keys: Sequence[str] = FIELD) -> DataFrame:
    """``pairs`` of :func:`overlapping_pairs` with ``shared``, the area inside both outlines.

    Boxes share that of their boxes' intersection. Only outlines that aren't boxes are fetched, once for each pair that
    is left, and given to the kernel.
    """

    def fetched(rows: DataFrame, objects: DataFrame, name: str) -> DataFrame:
        curved = measured(objects, keys).where("not is_box")
        return rows.join(curved.select(*keys, F.col("object_idx").alias(f"{name}_idx"), F.col("polygon").alias(f"_{name}poly")), [*keys, f"{name}_idx"], "left")

    def outline(name: str) -> Column:
        box = F.col(f"_{name}box")
        return F.coalesce(F.col(f"_{name}poly"), G.polygon((box["x0"], box["y0"]), (box["x1"], box["y0"]), (box["x1"], box["y1"]), (box["x0"], box["y1"])))

    whole = fetched(fetched(pairs, a, "a"), b, "b")
    boxes = F.col("a_is_box") & F.col("b_is_box")
    area = F.when(boxes, F.col("box_area")).otherwise(overlap_area(F.when(~boxes, outline("a")), F.when(~boxes, outline("b"))))
    return whole.withColumn("shared", area).drop("_apoly", "_bpoly")


def shared_pairs(a: DataFrame, b: DataFrame, likely: Column, keys: Sequence[str] = FIELD) -> DataFrame:
    """The ``likely`` of :func:`overlapping_pairs` with ``shared``. Pairs of two boxes, which are all they need, pass no
    further join; the others are few or none where most outlines are boxes."""
    a, b = measured(a, keys), measured(b, keys)
    plain = overlapping_pairs(a.where("is_box"), b.where("is_box"), keys).where(likely).withColumn("shared", F.col("box_area"))
    rest = overlapping_pairs(a.where("not is_box"), b, keys).unionByName(overlapping_pairs(a.where("is_box"), b.where("not is_box"), keys)).where(likely)
    return plain.unionByName(with_shared_area(rest, a, b, keys))


def drawn_once(objects: DataFrame, keys: Sequence[str] = FIELD) -> DataFrame:
    """(keys, polygon, object_idx): outlines of the same points within ``keys`` once, with the lowest index."""
    return objects.groupBy(*keys, "polygon").agg(F.min("object_idx").alias("object_idx"))


def link_objects(nuclei: DataFrame, myotubes: DataFrame, threshold: float = 0.8, keys: Sequence[str] = FIELD) -> DataFrame:
    """(keys, nuc_idx, myo_idx, overlap_frac): each nucleus with the myotube that covers most of it.

    The share of the nucleus' area must exceed the threshold; ties go to the lowest index. Nuclei without area have no
    link. Outlines are filled even-odd, so that crossed ones have a defined area. Of tubes drawn alike only the lowest
    index can win, so each outline is compared once, however many tubes have it.
    """
    likely = (F.col("a_area") > 0) & (F.col("box_area") > (threshold - 1e-9) * F.col("a_area"))
    shares = shared_pairs(nuclei, drawn_once(myotubes, keys), likely, keys).withColumn("overlap_frac", F.col("shared") / F.col("a_area")).where(F.col("overlap_frac") > threshold)
    best = shares.groupBy(*keys, F.col("a_idx").alias("nuc_idx")).agg(F.max(F.struct("overlap_frac", (-F.col("b_idx")).alias("m"))).alias("_best"))
    return best.select(*keys, "nuc_idx", (-F.col("_best.m")).alias("myo_idx"), F.col("_best.overlap_frac").alias("overlap_frac"))


def export_links(nuclei: DataFrame, links: DataFrame, myotubes: DataFrame, keys: Sequence[str] = FIELD) -> DataFrame:
    """Nuclei with myotube_id and myotube_patch_idx, -1 where they have none, and the tube's readable key, null there."""
    tubes = myotubes.select(*keys, F.col("object_idx").alias("myo_idx"), F.col("patch_idx").alias("_tube_patch"))
    found = links.join(tubes, [*keys, "myo_idx"]).select(*keys, F.col("nuc_idx").alias("object_idx"), "myo_idx", "_tube_patch")
    joined = nuclei.join(found, [*keys, "object_idx"], "left")
    key = F.concat_ws("_", F.col("fov").cast("string"), F.lit("patch"), F.col("_tube_patch").cast("string"), F.lit("myotube"), F.col("myo_idx").cast("string"))
    return joined.select(*nuclei.columns, F.coalesce("myo_idx", F.lit(-1)).cast("long").alias("myotube_id"), F.coalesce("_tube_patch", F.lit(-1)).cast("int").alias("myotube_patch_idx"), F.when(F.col("myo_idx").isNotNull(), key).alias("myotube_key"))
