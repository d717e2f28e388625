"""Queries on points and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.operators import assign as A
from fieldloom.operators import measure as M
from fieldloom.operators import outlines as O
from fieldloom.plans import standins as V

KEYS = ["fov", "patch_idx", "object_idx"]
QUERIES = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = V.sql(text)
        return f

    return add


def _widths(vertices: str, n: int) -> str:
    """SQL of w (object_idx, width): mean width across the main axis of convex outlines of ``n`` corners (object_idx, k, x, y).

    The axis is that of the corners, the first counted twice; of 20 even lines across it the outer two count where an edge
    lies on them.
    """
    return f"""v AS ({vertices}), c AS (SELECT object_idx, x, y FROM v UNION ALL SELECT object_idx, x, y FROM v WHERE k = 0),
m AS (SELECT object_idx, avg(x) AS mx, avg(y) AS my FROM c GROUP BY object_idx),
th AS (SELECT c.object_idx, atan2(2 * sum((x - mx) * (y - my)), sum((x - mx) ** 2) - sum((y - my) ** 2)) / 2 AS t FROM c JOIN m ON c.object_idx = m.object_idx GROUP BY c.object_idx),
r AS (SELECT v.object_idx, k, x * cos(t) + y * sin(t) AS a, y * cos(t) - x * sin(t) AS b FROM v JOIN th ON v.object_idx = th.object_idx),
s AS (SELECT i.object_idx, i.a AS ia, i.b AS ib, j.a AS ja, j.b AS jb FROM r i JOIN r j ON i.object_idx = j.object_idx AND j.k = (i.k + 1) % {n}),
x AS (SELECT object_idx, min(a) AS low, max(a) AS high FROM r GROUP BY object_idx),
l AS (SELECT object_idx, g, low + g * (high - low) / 19 AS a, 1e-9 * (high - low) AS e FROM x CROSS JOIN (SELECT unnest(range(20)) AS g)),
h AS (SELECT l.object_idx, l.g, ib + (jb - ib) * (l.a - ia) / (ja - ia) AS b FROM l JOIN s ON l.object_idx = s.object_idx AND (ia > l.a) <> (ja > l.a) WHERE l.g BETWEEN 1 AND 18
  UNION ALL SELECT l.object_idx, l.g, unnest([ib, jb]) FROM l JOIN s ON l.object_idx = s.object_idx AND abs(ia - l.a) <= e AND abs(ja - l.a) <= e WHERE l.g IN (0, 19)),
w AS (SELECT object_idx, avg(width) AS width FROM (SELECT object_idx, g, max(b) - min(b) AS width FROM h GROUP BY object_idx, g) GROUP BY object_idx)"""


def _counted(spark: SparkSession, d: str, rule: str, **kw: object) -> DataFrame:
    return A.count_matrix(A.assign_points(V.points(spark, d), V.nuclei(spark, d), rule, **kw)).drop("slide")


@query("""SELECT fov, patch_idx, object_idx, target AS gene, count(*) AS n FROM (SELECT * REPLACE (min(object_idx) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, fov, patch_idx) AS object_idx), object_idx AS own FROM v_inside) WHERE own = object_idx GROUP BY ALL""")
def pip_greedy(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "greedy")


@query("SELECT fov, patch_idx, object_idx, target AS gene, count(*) AS n FROM v_inside GROUP BY ALL")
def pip_shared(spark: SparkSession, d: str) -> DataFrame:
    return A.shared_counts(V.points(spark, d), V.nuclei(spark, d)).drop("slide")


@query("""SELECT fov, patch_idx, object_idx, target AS gene, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, fov, patch_idx) AS k FROM v_inside) WHERE k = 1 GROUP BY ALL""")
def pip_null(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "null")


@query("""WITH s AS (SELECT fov, patch_idx, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, list(object_idx ORDER BY object_idx) AS objects FROM v_inside GROUP BY ALL),
k AS (SELECT fov, patch_idx, objects, count(*) AS m FROM s GROUP BY ALL), u AS (SELECT *, unnest(objects) AS object_idx, unnest(range(len(objects))) AS i FROM k)
SELECT fov, patch_idx, array_to_string(objects, ',') AS objects, object_idx, m // len(objects) + CASE WHEN i < m % len(objects) THEN 1 ELSE 0 END AS n FROM u WHERE m // len(objects) + CASE WHEN i < m % len(objects) THEN 1 ELSE 0 END > 0""")
def pip_random_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the balanced rule by overlap; which point goes where is seeded, how many is not."""
    dealt = A.assign_points(V.points(spark, d), V.nuclei(spark, d), "random", seed=7)
    return dealt.groupBy("fov", "patch_idx", F.array_join(F.col("objects").cast("array<string>"), ",").alias("objects"), "object_idx").agg(F.count("*").alias("n"))


@query("""SELECT fov, object_idx, target AS gene, count(*) AS n FROM (SELECT t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, t.l_quantity, t.l_shipdate, t.target, t.fov, min(h.object_idx) AS object_idx FROM v_tx t JOIN (
  SELECT t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, t.l_quantity, t.l_shipdate, t.fov, e.object_idx FROM v_tx t JOIN v_edge e ON t.fov = e.fov AND (e.iy > t.y) <> (e.jy > t.y) AND t.x < (e.jx - e.ix) * (t.y - e.iy) / (e.jy - e.iy + 1e-12) + e.ix GROUP BY ALL HAVING count(*) % 2 = 1) h
  USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, fov) GROUP BY ALL) GROUP BY ALL""")
def pip_without_patches(spark: SparkSession, d: str) -> DataFrame:
    found = A.assign_points(V.points(spark, d).drop("patch_idx"), V.nuclei(spark, d).drop("patch_idx"), "greedy", keys=A.FIELD)
    return A.count_matrix(found, A.FIELD).drop("slide")


BOX_HITS = """SELECT t.fov, t.patch_idx, t.target, t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, t.l_quantity, t.l_shipdate, h.object_idx FROM v_tx t JOIN v_hex h ON t.fov = h.fov AND t.patch_idx = h.patch_idx
  AND floor(t.x) BETWEEN h.cx - h.w AND h.cx + h.w AND floor(t.y) BETWEEN h.cy - h.h AND h.cy + h.h"""


@query(f"SELECT fov, patch_idx, object_idx, target AS gene, count(*) AS n FROM (SELECT fov, patch_idx, target, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, max(object_idx) AS object_idx FROM ({BOX_HITS}) GROUP BY ALL) GROUP BY ALL")
def pip_raster(spark: SparkSession, d: str) -> DataFrame:
    return A.count_matrix(A.assign_points(V.points(spark, d), V.nuclei_boxes(spark, d), "last", pixel=True)).drop("slide")


@query("""WITH c AS (SELECT object_idx, fov, patch_idx, k, least(1023, greatest(0, round_even(x - (patch_idx % 4) * 1024 - 60.25, 0))) AS x, least(1023, greatest(0, round_even(y - (patch_idx // 4) * 1024 - 50.5, 0))) AS y FROM v_vertex),
e AS (SELECT i.object_idx, i.fov, i.patch_idx, i.x AS ix, i.y AS iy, j.x AS jx, j.y AS jy FROM c i JOIN c j ON i.object_idx = j.object_idx AND j.k = (i.k + 5) % 6),
t AS (SELECT *, floor(x) - (patch_idx % 4) * 1024 AS px, floor(y) - (patch_idx // 4) * 1024 AS py FROM v_tx),
h AS (SELECT t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, t.l_quantity, t.l_shipdate, t.target, t.fov, t.patch_idx, e.object_idx FROM t JOIN e ON t.fov = e.fov AND t.patch_idx = e.patch_idx GROUP BY ALL
  HAVING count(*) FILTER (WHERE (iy > py) <> (jy > py) AND px < (jx - ix) * (py - iy) / (jy - iy + 1e-12) + ix) % 2 = 1
  OR bool_or((ix - jx) * (py - jy) = (iy - jy) * (px - jx) AND px BETWEEN least(ix, jx) AND greatest(ix, jx) AND py BETWEEN least(iy, jy) AND greatest(iy, jy)))
SELECT fov, patch_idx, object_idx, target AS gene, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, target, fov, patch_idx, max(object_idx) AS object_idx FROM h GROUP BY ALL) GROUP BY ALL""")
def pip_raster_clipped(spark: SparkSession, d: str) -> DataFrame:
    """The raster rule on hexagons of which many cross their patch's border, with corners between pixels."""
    shifted = V.nuclei(spark, d).withColumn("polygon", G.moved(F.col("polygon"), F.lit(-60.25), F.lit(-50.5)))
    return A.count_matrix(A.assign_points(V.points(spark, d), shifted, "last", pixel=True)).drop("slide")


@query(f"SELECT fov, patch_idx, object_idx, target AS gene, count(*) AS n FROM (SELECT fov, patch_idx, target, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, max(object_idx) AS object_idx FROM ({BOX_HITS}) GROUP BY ALL) GROUP BY ALL")
def pip_painted_then_greedy(spark: SparkSession, d: str) -> DataFrame:
    """On boxes with whole corners every point that is inside is painted, so the fallback adds none."""
    return A.count_matrix(A.assign_painted(V.points(spark, d), V.nuclei_boxes(spark, d))).drop("slide")


@query("""SELECT gene, row_number() OVER (ORDER BY pos NULLS LAST, gene) - 1 AS gene_idx FROM (SELECT gene, min(pos) AS pos FROM (
  SELECT 'Brand#' || k AS gene, k AS pos FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS k FROM part WHERE p_partkey <= 20) UNION ALL
  SELECT target, NULL FROM v_tx t WHERE EXISTS (SELECT 1 FROM v_hex h WHERE h.fov = t.fov AND h.patch_idx = t.patch_idx)) GROUP BY gene)""")
def gene_universe(spark: SparkSession, d: str) -> DataFrame:
    panel = V.table(spark, d, "part").where("p_partkey <= 20").select(F.col("p_brand").alias("gene"), F.substring("p_brand", 7, 9).cast("long").alias("pos"))
    return A.gene_index(panel, V.points(spark, d), V.nuclei(spark, d))


@query("""WITH e AS (SELECT object_idx, abs(sum(jx * iy - ix * jy)) / 2 AS a, sum(sqrt((ix - jx) ** 2 + (iy - jy) ** 2)) AS p FROM v_edge GROUP BY object_idx),
m AS (SELECT a.object_idx, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS m FROM v_vertex a JOIN v_vertex b ON a.object_idx = b.object_idx GROUP BY a.object_idx)
SELECT object_idx, round(a, 4) AS area_px2, round(p, 4) AS perimeter_px, round(least(1, 4 * pi() * a / (p * p)), 6) AS circularity, round(m, 4) AS major_axis_length_px FROM e JOIN m USING (object_idx)""")
def morphology(spark: SparkSession, d: str) -> DataFrame:
    m = O.morphology(V.nuclei(spark, d))
    return m.select("object_idx", *(F.round(c, 6 if c == "circularity" else 4).alias(c) for c in ("area_px2", "perimeter_px", "circularity", "major_axis_length_px")))


@query("SELECT object_idx, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v_vertex GROUP BY object_idx")
def bounding_boxes(spark: SparkSession, d: str) -> DataFrame:
    return V.nuclei(spark, d).select("object_idx", G.bounding_box(F.col("polygon")).alias("b")).select("object_idx", "b.*")


@query("SELECT object_idx, lcx - w <= 60 OR lcy - h <= 60 OR lcx + w >= 964 OR lcy + h >= 964 AS is_edge FROM v_hex")
def edge_flag(spark: SparkSession, d: str) -> DataFrame:
    return V.nuclei(spark, d).select("object_idx", G.on_edge(F.col("local_polygon"), 60.0).alias("is_edge"))


@query("SELECT fov, count(*) AS n FROM v_hex WHERE NOT (lcx - w <= 60 OR lcy - h <= 60 OR lcx + w >= 964 OR lcy + h >= 964) GROUP BY fov")
def inner_objects(spark: SparkSession, d: str) -> DataFrame:
    flagged = V.nuclei(spark, d).withColumn("is_edge", G.on_edge(F.col("local_polygon"), 60.0))
    return O.drop_edge_objects(flagged).groupBy("fov").agg(F.count("*").alias("n"))


@query("SELECT object_idx FROM v_hex WHERE 3 * w * h >= 3000")
def size_filter(spark: SparkSession, d: str) -> DataFrame:
    return O.size_filter(V.nuclei(spark, d), 3000.0).select("object_idx")


@query("SELECT object_idx, round(cx, 6) AS x, round(cy, 6) AS y FROM v_hex")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    c = G.centroid(F.col("local_polygon"))  # in patch coordinates, where the sums lose least
    dx, dy = G.patch_offset(F.col("patch_idx"))
    return V.nuclei(spark, d).select("object_idx", F.round(c["x"] + dx, 6).alias("x"), F.round(c["y"] + dy, 6).alias("y"))


@query("""WITH c AS (SELECT object_idx, x, y FROM v_vertex UNION ALL SELECT object_idx, x, y FROM v_vertex WHERE k = 0), m AS (SELECT object_idx, avg(x) AS mx, avg(y) AS my FROM c GROUP BY object_idx)
SELECT object_idx, round(abs(atan2(2 * sum((x - mx) * (y - my)), sum((x - mx) ** 2) - sum((y - my) ** 2)) / 2), 4) AS angle FROM c JOIN m USING (object_idx) GROUP BY object_idx""")
def principal_axes(spark: SparkSession, d: str) -> DataFrame:
    return V.nuclei(spark, d).select("object_idx", F.round(F.abs(G.principal_angle(F.col("polygon"))), 4).alias("angle"))


@query("SELECT object_idx, row_number() OVER (PARTITION BY fov, patch_idx ORDER BY object_idx) - 1 AS local_id, row_number() OVER (PARTITION BY fov ORDER BY patch_idx, object_idx) - 1 AS field_idx FROM v_hex")
def local_ids(spark: SparkSession, d: str) -> DataFrame:
    n = O.numbered(V.nuclei(spark, d), ["fov", "patch_idx"], ["object_idx"], "local_id")
    return O.numbered(n, ["fov"], ["patch_idx", "object_idx"], "field_idx").select("object_idx", "local_id", "field_idx")


@query("""WITH i AS (SELECT s_suppkey AS image_name, CAST(900 + (s_suppkey * 37) % 4000 AS INT) AS width, CAST(900 + (s_suppkey * 91) % 4000 AS INT) AS height FROM supplier)
SELECT image_name, CAST(r * (width // 1024) + c AS INT) AS patch_idx, CAST(c * 1024 AS INT) AS x0, CAST(r * 1024 AS INT) AS y0 FROM i, range(0, 5) a(r), range(0, 5) b(c) WHERE (r + 1) * 1024 <= height AND (c + 1) * 1024 <= width""")
def patch_grid(spark: SparkSession, d: str) -> DataFrame:
    images = V.table(spark, d, "supplier").selectExpr("s_suppkey as image_name", "cast(900 + (s_suppkey * 37) % 4000 as int) as width", "cast(900 + (s_suppkey * 91) % 4000 as int) as height")
    return O.patch_grid(spark, images)


@query("SELECT fov, target, x - 1024 AS local_x, y - 1024 AS local_y FROM v_tx WHERE x >= 1024 AND x < 2048 AND y >= 1024 AND y < 2048")
def patch_subset(spark: SparkSession, d: str) -> DataFrame:
    return O.points_in_patch(V.points(spark, d), 5).select("fov", "target", "local_x", "local_y")


@query("SELECT patch_idx, CAST(least(3, greatest(0, floor(y / 1024))) * 4 + least(3, greatest(0, floor(x / 1024))) AS INT) AS found, count(*) AS n FROM v_tx GROUP BY ALL")
def point_patches(spark: SparkSession, d: str) -> DataFrame:
    return V.points(spark, d).groupBy("patch_idx", G.patch_of_point(F.col("x"), F.col("y")).alias("found")).agg(F.count("*").alias("n"))


@query("SELECT fov, patch_idx, CAST(floor(x) AS INT) % 1024 AS px, CAST(floor(y) AS INT) % 1024 AS py, count(*) AS n FROM v_tx GROUP BY ALL")
def pixel_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.local_pixels(V.points(spark, d)).groupBy("fov", "patch_idx", "px", "py").agg(F.count("*").alias("n"))


@query("SELECT fov, object_idx, k AS pos, x, y, CAST(6 AS BIGINT) AS n_points, CAST((dense_rank() OVER (PARTITION BY fov ORDER BY object_idx) - 1) * 6 AS BIGINT) AS points_before FROM v_vertex")
def packed_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Outlines taken apart, put together again, and taken apart with their place in a packed list."""
    whole = O.packed(O.unpacked(V.nuclei(spark, d), ["fov", "object_idx"]), ["fov", "object_idx"])
    placed = O.offsets(whole, ["fov"], "object_idx")
    return placed.select("fov", "object_idx", F.posexplode("polygon").alias("pos", "p"), "n_points", "points_before").select("fov", "object_idx", F.col("pos").cast("long").alias("pos"), "p.x", "p.y", "n_points", "points_before")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return A.link_objects(V.nuclei_boxes(spark, d), V.myotubes(spark, d))


@query("SELECT fov, nuc_idx, myo_idx, round(frac, 9) AS overlap_frac FROM v_link")
def overlap_link(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("fov", "nuc_idx", "myo_idx", F.round("overlap_frac", 9).alias("overlap_frac"))


@query("""SELECT h.object_idx, coalesce(l.myo_idx, -1) AS myotube_id, coalesce(m.patch_idx, -1) AS myotube_patch_idx, CASE WHEN l.myo_idx IS NOT NULL THEN h.fov || '_patch_' || m.patch_idx || '_myotube_' || l.myo_idx END AS myotube_key
FROM v_hex h LEFT JOIN v_link l ON h.fov = l.fov AND h.object_idx = l.nuc_idx LEFT JOIN v_myo m ON m.fov = l.fov AND m.object_idx = l.myo_idx""")
def link_export(spark: SparkSession, d: str) -> DataFrame:
    return A.export_links(V.nuclei_boxes(spark, d), _links(spark, d), V.myotubes(spark, d)).select("object_idx", "myotube_id", "myotube_patch_idx", "myotube_key")


def _tubes(spark: SparkSession, d: str) -> DataFrame:
    return M.nuclei_per_tube(V.myotubes(spark, d), _links(spark, d))


@query("SELECT fov, object_idx, n_nuclei FROM v_tube")
def nuclei_per_tube(spark: SparkSession, d: str) -> DataFrame:
    return _tubes(spark, d).select("fov", "object_idx", "n_nuclei")


@query("""SELECT coalesce(n.fov, m.fov) AS fov, coalesce(n.n, 0) AS n_nuclei, coalesce(m.n, 0) AS n_myotubes, coalesce(l.n, 0) AS n_in_myotubes, CASE WHEN n.n > 0 THEN coalesce(l.n, 0) / n.n ELSE 0 END AS differentiation_index
FROM (SELECT fov, count(*) AS n FROM v_hex GROUP BY fov) n FULL JOIN (SELECT fov, count(*) AS n FROM v_myo GROUP BY fov) m ON n.fov = m.fov LEFT JOIN (SELECT fov, count(*) AS n FROM v_link GROUP BY fov) l ON l.fov = coalesce(n.fov, m.fov)""")
def field_indices(spark: SparkSession, d: str) -> DataFrame:
    return M.field_indices(V.nuclei_boxes(spark, d), V.myotubes(spark, d), _links(spark, d)).drop("slide")


@query("""SELECT f.fov, k.k, coalesce(n.n, 0) AS n_tubes FROM (SELECT DISTINCT fov FROM v_tube) f CROSS JOIN (SELECT unnest(range(0, (SELECT max(n_nuclei) + 1 FROM v_tube))) AS k) k
LEFT JOIN (SELECT fov, n_nuclei, count(*) AS n FROM v_tube GROUP BY ALL) n ON n.fov = f.fov AND n.n_nuclei = k.k""")
def nuclei_histogram(spark: SparkSession, d: str) -> DataFrame:
    return M.nuclei_histogram(_tubes(spark, d)).drop("slide")


@query("SELECT fov, object_idx, n_nuclei, CAST(142800 AS DOUBLE) AS area_px2, CAST(1520 AS DOUBLE) AS perimeter_px FROM v_tube")
def tube_measurements(spark: SparkSession, d: str) -> DataFrame:
    return O.morphology(_tubes(spark, d)).select("fov", "object_idx", "n_nuclei", F.round("area_px2", 6).alias("area_px2"), F.round("perimeter_px", 6).alias("perimeter_px"))


@query(f"""WITH {_widths("SELECT object_idx, k, x0 + CASE WHEN k IN (1, 2) THEN 420 ELSE 0 END AS x, y0 + CASE WHEN k >= 2 THEN 340 ELSE 0 END AS y FROM v_myo CROSS JOIN (SELECT unnest(range(4)) AS k)", 4)}
SELECT fov, object_idx AS object_id, round(width, 6) AS width, CAST(142800 AS DOUBLE) AS area, n_nuclei FROM v_tube JOIN w USING (object_idx)""")
def per_object_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row a tube with its width, area and nuclei."""
    rows = M.object_rows(V.myotubes(spark, d), _links(spark, d))
    return rows.select("fov", "object_id", F.round("width", 6).alias("width"), F.round("area", 6).alias("area"), "n_nuclei")


@query("""SELECT coalesce(a.fov, b.fov) AS fov, CASE WHEN a.n > 0 THEN coalesce(b.f, 0) / a.n ELSE 0 END AS fusion_index, CASE WHEN b.i > 0 THEN b.f / b.i ELSE 0 END AS fusion_index_in_tubes, CASE WHEN b.t > 0 THEN b.ft / b.t ELSE 0 END AS fused_fraction, CASE WHEN b.t > 0 THEN b.i / b.t ELSE 0 END AS mean_nuclei_per_tube
FROM (SELECT fov, count(*) AS n FROM v_hex GROUP BY fov) a FULL JOIN (SELECT fov, sum(n_nuclei) AS i, sum(CASE WHEN n_nuclei >= 2 THEN n_nuclei ELSE 0 END) AS f, count(*) FILTER (WHERE n_nuclei >= 2) AS ft, count(*) AS t FROM v_tube GROUP BY fov) b ON a.fov = b.fov""")
def fusion(spark: SparkSession, d: str) -> DataFrame:
    return M.fusion(_tubes(spark, d), V.nuclei_boxes(spark, d)).drop("slide")


@query("""SELECT fov, object_idx, round(avg(v), 6) AS average_intensity, round(median(v), 6) AS median_intensity, round(stddev_samp(v), 6) AS stddev_intensity FROM (SELECT t.fov, m.object_idx, CAST(t.l_quantity AS DOUBLE) AS v FROM v_tx t JOIN v_myo m ON t.fov = m.fov AND t.x BETWEEN m.x0 AND m.x0 + 420 AND t.y BETWEEN m.y0 AND m.y0 + 340) GROUP BY ALL""")
def tube_intensity(spark: SparkSession, d: str) -> DataFrame:
    m = M.intensity_in_tubes(V.points(spark, d).withColumn("value", F.col("point_id.l_quantity")).drop("patch_idx"), V.myotubes(spark, d))
    return m.select("fov", "object_idx", *(F.round(c, 6).alias(c) for c in ("average_intensity", "median_intensity", "stddev_intensity")))


@query()
def width_segments(spark: SparkSession, d: str) -> DataFrame:
    return O.segments(V.nuclei(spark, d), ["fov", "object_idx"])


@query(f"""WITH {_widths("SELECT object_idx, k, x, y FROM v_vertex", 6)} SELECT object_idx, round(width, 6) AS width_px FROM w""")
def nucleus_widths(spark: SparkSession, d: str) -> DataFrame:
    return O.with_width(V.nuclei(spark, d)).select("object_idx", F.round("width_px", 6).alias("width_px"))


@query("SELECT image_name, large_idx, small_idx FROM v_inner")
def contained_pairs(spark: SparkSession, d: str) -> DataFrame:
    return O.contained_pairs(V.nested_squares(spark, d))


@query("SELECT image_name, object_idx FROM v_top")
def largest_outlines(spark: SparkSession, d: str) -> DataFrame:
    return O.largest_per_file(V.nested_squares(spark, d))


@query("SELECT image_name, object_idx FROM v_dedup d WHERE NOT EXISTS (SELECT 1 FROM v_gone g WHERE g.image_name = d.image_name AND g.object_idx = d.object_idx)")
def containment_dedup(spark: SparkSession, d: str) -> DataFrame:
    return O.deduplicated(V.nested_squares(spark, d)).select("image_name", "object_idx")


@query("""SELECT coalesce(d.image_name::VARCHAR, 'all') AS image_name, CAST(sum(b) AS BIGINT) AS "before", CAST(sum(k) AS BIGINT) AS kept, CAST(sum(b) - sum(k) AS BIGINT) AS removed FROM (SELECT image_name, 1 AS b, CASE WHEN EXISTS (SELECT 1 FROM v_gone g WHERE g.image_name = d.image_name AND g.object_idx = d.object_idx) THEN 0 ELSE 1 END AS k FROM v_dedup d) d GROUP BY ROLLUP (d.image_name)""")
def dedup_accounting(spark: SparkSession, d: str) -> DataFrame:
    squares = V.nested_squares(spark, d)
    sums = O.accounting(squares, O.deduplicated(squares))
    return sums.withColumn("image_name", F.coalesce(F.col("image_name").cast("string"), F.lit("all")))


@query("SELECT object_idx, image_name, row_number() OVER (PARTITION BY image_name ORDER BY line_no) - 1 AS local_id FROM (SELECT *, row_number() OVER (PARTITION BY image_name ORDER BY line_no) - 1 AS c FROM v_dedup) s WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey % 40 = s.image_name AND p.p_partkey // 40 = s.c AND p.p_size < 15)")
def intensity_drop(spark: SparkSession, d: str) -> DataFrame:
    drop = O.intensity_drop_list(V.intensity(spark, d)).withColumn("image", F.col("image").cast("int"))
    return O.numbered(O.drop_dim(V.nested_squares(spark, d), drop), ["image_name"], ["line_no"], "local_id").select("object_idx", "image_name", "local_id")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE p_size < 15) AS n_below, count(DISTINCT CASE WHEN p_size < 15 THEN p_partkey % 40 END) AS n_images FROM part")
def intensity_summary(spark: SparkSession, d: str) -> DataFrame:
    return O.intensity_summary(V.intensity(spark, d))
