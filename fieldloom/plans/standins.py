"""The driver's tables as points, outlines, counts and labels, in integer arithmetic; and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.sessions import spread

POINT_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey"))
    local = rows.selectExpr(
        "'S' as slide", "cast(l_suppkey % 5 as int) as fov", "cast(l_partkey % 16 as int) as patch_idx", f"struct({', '.join(POINT_KEY)}) as point_id", "p_brand as target",
        "cast((l_orderkey * 613 + l_linenumber * 37) % 1024 as double) + 0.5D as lx", "cast((l_partkey * 389 + l_suppkey * 53 + l_linenumber * 71) % 1024 as double) + 0.5D as ly",
    )
    return local.selectExpr("slide", "fov", "patch_idx", "point_id", "target", "(patch_idx % 4) * 1024 + lx as x", "(patch_idx div 4) * 1024 + ly as y")


def _hexagon(spark: SparkSession, d: str) -> DataFrame:
    c = spread(table(spark, d, "customer")).selectExpr(
        "c_custkey", "c_nationkey", "'S' as slide", "cast(c_nationkey % 5 as int) as fov", "cast(c_custkey % 16 as int) as patch_idx", "c_custkey as object_idx", "c_mktsegment as cell_line",
        "cast((c_custkey * 7919) % 880 + 72 as double) as cx", "cast((c_custkey * 104729) % 880 + 72 as double) as cy", "cast(30 + c_custkey % 41 as double) as w", "cast(24 + c_custkey % 29 as double) as h",
    )
    return c


def _global(df: DataFrame) -> DataFrame:
    dx, dy = G.patch_offset(F.col("patch_idx"))
    return df.withColumn("polygon", G.moved(F.col("local_polygon"), dx.cast("double"), dy.cast("double")))


def nuclei(spark: SparkSession, d: str) -> DataFrame:
    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    poly = G.polygon((cx - w, cy), (cx - w / 2, cy - h), (cx + w / 2, cy - h), (cx + w, cy), (cx + w / 2, cy + h), (cx - w / 2, cy + h))
    return _global(_hexagon(spark, d).withColumn("local_polygon", poly)).drop("cx", "cy", "w", "h", "c_nationkey", "c_custkey")


def nuclei_boxes(spark: SparkSession, d: str) -> DataFrame:
    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    poly = G.polygon((cx - w, cy - h), (cx + w, cy - h), (cx + w, cy + h), (cx - w, cy + h))
    return _global(_hexagon(spark, d).withColumn("local_polygon", poly)).drop("cx", "cy", "w", "h", "c_nationkey", "c_custkey")


def myotubes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").selectExpr(
        "'S' as slide", "cast(s_suppkey % 5 as int) as fov", "cast((s_suppkey div 5) % 16 as int) as patch_idx", "s_suppkey as object_idx", "cast(100 + (s_suppkey * 131) % 400 as double) as x0", "cast(80 + (s_suppkey * 173) % 500 as double) as y0"
    )
    x0, y0 = F.col("x0"), F.col("y0")
    return _global(s.withColumn("local_polygon", G.polygon((x0, y0), (x0 + 420, y0), (x0 + 420, y0 + 340), (x0, y0 + 340)))).drop("x0", "y0")


def nested_squares(spark: SparkSession, d: str) -> DataFrame:
    p = spread(table(spark, d, "part")).selectExpr(
        "p_partkey as object_idx", "cast(p_partkey % 40 as int) as image_name", "p_partkey div 40 as line_no", "p_size", "cast((p_partkey * 211) % 700 + 160 as double) as cx", "cast((p_partkey * 367) % 700 + 160 as double) as cy", "cast(4 + p_size * 3 as double) as r"
    )
    cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
    return p.withColumn("polygon", G.polygon((cx - r, cy - r), (cx + r, cy - r), (cx + r, cy + r), (cx - r, cy + r))).drop("cx", "cy", "r")


def counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    gene = F.concat(F.when(F.col("l_partkey") % 200 < 4, "Negative").otherwise("G"), (F.col("l_partkey") % 200).cast("string"))
    return rows.groupBy(F.col("o_custkey").alias("cell"), gene.alias("gene")).agg(F.sum("l_quantity").cast("int").alias("n"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.expr("c_nationkey = n_nationkey"))  # 25 nations at any size
    return rows.selectExpr("c_custkey as cell", "c_mktsegment as cell_line", "n_regionkey as slide", "cast(c_custkey % 2 as int) as group")


def classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").selectExpr("doc_id as local_id", "cast(quality as string) as predicted_class")


def image_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").selectExpr(
        "doc_id", "concat('x/field_F', lpad(cast(doc_id % 5 as string), 5, '0'), '_patch_', doc_id % 16, '_cellline_C', doc_id % 3, '_localid_', doc_id, '.png') as image_name", "cast(quality as string) as predicted_class", "cast((doc_id * 37) % 101 as double) / 101 as sigmoid_logits"
    )


def pvalues(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_returnflag as cell_line", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) as gene", "cast(round(l_extendedprice * 100) as bigint) % 10007 / 10007.0D as p")


def intensity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("concat('dir/', p_partkey % 40, '.tif') as image_name", "p_partkey div 40 as contour_idx", "cast(p_size as double) as average_intensity")


#: Views for DuckDB by name; each may use those before it.
VIEWS: dict[str, str] = {
    "v_tx": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, p_brand AS target, CAST(l_suppkey % 5 AS INT) AS fov, CAST(l_partkey % 16 AS INT) AS patch_idx,
        ((l_partkey % 16) % 4) * 1024 + CAST((l_orderkey * 613 + l_linenumber * 37) % 1024 AS DOUBLE) + 0.5::DOUBLE AS x,
        ((l_partkey % 16) // 4) * 1024 + CAST((l_partkey * 389 + l_suppkey * 53 + l_linenumber * 71) % 1024 AS DOUBLE) + 0.5::DOUBLE AS y
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_hex": """SELECT c_custkey AS object_idx, CAST(c_nationkey % 5 AS INT) AS fov, CAST(c_custkey % 16 AS INT) AS patch_idx, c_mktsegment AS cell_line,
        CAST((c_custkey * 7919) % 880 + 72 AS DOUBLE) AS lcx, CAST((c_custkey * 104729) % 880 + 72 AS DOUBLE) AS lcy,
        ((c_custkey % 16) % 4) * 1024 + CAST((c_custkey * 7919) % 880 + 72 AS DOUBLE) AS cx, ((c_custkey % 16) // 4) * 1024 + CAST((c_custkey * 104729) % 880 + 72 AS DOUBLE) AS cy,
        CAST(30 + c_custkey % 41 AS DOUBLE) AS w, CAST(24 + c_custkey % 29 AS DOUBLE) AS h FROM customer""",
    "v_vertex": """SELECT object_idx, fov, patch_idx, cell_line, k,
        cx + CASE k WHEN 0 THEN -w WHEN 1 THEN -w / 2 WHEN 2 THEN w / 2 WHEN 3 THEN w WHEN 4 THEN w / 2 ELSE -w / 2 END AS x,
        cy + CASE k WHEN 0 THEN 0 WHEN 1 THEN -h WHEN 2 THEN -h WHEN 3 THEN 0 WHEN 4 THEN h ELSE h END AS y
        FROM v_hex CROSS JOIN (SELECT unnest(range(6)) AS k)""",
    "v_edge": """SELECT i.object_idx, i.fov, i.patch_idx, i.x AS ix, i.y AS iy, j.x AS jx, j.y AS jy FROM v_vertex i JOIN v_vertex j ON i.object_idx = j.object_idx AND j.k = (i.k + 5) % 6""",
    "v_inside": """SELECT t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, t.l_quantity, t.l_shipdate, t.target, t.fov, t.patch_idx, e.object_idx
        FROM v_tx t JOIN v_edge e ON t.fov = e.fov AND t.patch_idx = e.patch_idx AND (e.iy > t.y) <> (e.jy > t.y) AND t.x < (e.jx - e.ix) * (t.y - e.iy) / (e.jy - e.iy + 1e-12) + e.ix
        GROUP BY ALL HAVING count(*) % 2 = 1""",
    "v_myo": """SELECT s_suppkey AS object_idx, CAST(s_suppkey % 5 AS INT) AS fov, CAST((s_suppkey // 5) % 16 AS INT) AS patch_idx,
        ((s_suppkey // 5) % 16 % 4) * 1024 + CAST(100 + (s_suppkey * 131) % 400 AS DOUBLE) AS x0, ((s_suppkey // 5) % 16 // 4) * 1024 + CAST(80 + (s_suppkey * 173) % 500 AS DOUBLE) AS y0 FROM supplier""",
    "v_share": """SELECT n.fov, n.object_idx AS nuc_idx, m.object_idx AS myo_idx,
        greatest(0, least(n.cx + n.w, m.x0 + 420) - greatest(n.cx - n.w, m.x0)) * greatest(0, least(n.cy + n.h, m.y0 + 340) - greatest(n.cy - n.h, m.y0)) / (4 * n.w * n.h) AS frac
        FROM v_hex n JOIN v_myo m ON n.fov = m.fov""",
    "v_link": """SELECT fov, nuc_idx, myo_idx, frac FROM (SELECT *, row_number() OVER (PARTITION BY fov, nuc_idx ORDER BY frac DESC, myo_idx) AS rn FROM v_share WHERE frac > 0.8) WHERE rn = 1""",
    "v_tube": """SELECT m.fov, m.object_idx, m.patch_idx, count(l.nuc_idx) AS n_nuclei FROM v_myo m LEFT JOIN v_link l ON m.fov = l.fov AND m.object_idx = l.myo_idx GROUP BY ALL""",
    "v_dedup": """SELECT p_partkey AS object_idx, CAST(p_partkey % 40 AS INT) AS image_name, p_partkey // 40 AS line_no, p_size, CAST((p_partkey * 211) % 700 + 160 AS DOUBLE) AS cx, CAST((p_partkey * 367) % 700 + 160 AS DOUBLE) AS cy,
        CAST(4 + p_size * 3 AS DOUBLE) AS r FROM part""",
    "v_inner": """SELECT a.image_name, b.object_idx AS large_idx, a.object_idx AS small_idx FROM v_dedup a JOIN v_dedup b ON a.image_name = b.image_name AND a.r < b.r
        WHERE greatest(0, least(a.cx + a.r, b.cx + b.r) - greatest(a.cx - a.r, b.cx - b.r)) * greatest(0, least(a.cy + a.r, b.cy + b.r) - greatest(a.cy - a.r, b.cy - b.r)) / (4 * a.r * a.r) >= 0.9""",
    "v_top": """SELECT image_name, arg_min(object_idx, (-r, object_idx)) AS object_idx FROM v_dedup GROUP BY image_name""",
    "v_gone": """WITH n AS (SELECT image_name, large_idx, count(*) AS n FROM v_inner GROUP BY ALL)
        SELECT DISTINCT n.image_name, CASE WHEN n.n >= 3 AND t.object_idx IS NULL THEN n.large_idx ELSE i.small_idx END AS object_idx
        FROM n JOIN v_inner i ON n.image_name = i.image_name AND n.large_idx = i.large_idx LEFT JOIN v_top t ON n.image_name = t.image_name AND n.large_idx = t.object_idx""",
    "v_counts": """SELECT o_custkey AS cell, CASE WHEN l_partkey % 200 < 4 THEN 'Negative' ELSE 'G' END || (l_partkey % 200)::VARCHAR AS gene, CAST(sum(l_quantity) AS INT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "v_cells": """SELECT c_custkey AS cell, c_mktsegment AS cell_line, n_regionkey AS slide, CAST(c_custkey % 2 AS INT) AS "group" FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_class": """SELECT doc_id AS local_id, quality::VARCHAR AS predicted_class FROM labels""",
    "v_qc": """SELECT c.*, coalesce(s.total, 0)::BIGINT AS total, coalesce(s.n_genes, 0)::BIGINT AS n_genes FROM v_cells c LEFT JOIN (SELECT cell, sum(n) AS total, count(*) FILTER (WHERE n > 0) AS n_genes FROM v_counts GROUP BY cell) s ON c.cell = s.cell""",
    "v_detected": """SELECT cell_line, gene FROM (SELECT c.cell_line, k.gene, greatest(count(*) FILTER (WHERE c."group" = 0), count(*) FILTER (WHERE c."group" = 1)) AS m FROM v_counts k JOIN v_cells c ON k.cell = c.cell WHERE k.n > 0 GROUP BY ALL) WHERE m >= 20""",
    "v_total": """SELECT c.cell, c.cell_line, c."group", coalesce(sum(k.n) FILTER (WHERE d.gene IS NOT NULL), 0)::BIGINT AS total FROM v_cells c LEFT JOIN v_counts k ON c.cell = k.cell LEFT JOIN v_detected d ON d.cell_line = c.cell_line AND d.gene = k.gene GROUP BY ALL""",
    "v_factor": """SELECT t.cell, t.cell_line, t."group", t.total, CASE WHEN t.total > 0 THEN t.total / l.med ELSE l.least / l.med * 1e-3 END AS size_factor
        FROM v_total t JOIN (SELECT cell_line, quantile_cont(total, 0.5) AS med, min(total) AS least FROM v_total WHERE total > 0 GROUP BY cell_line) l ON t.cell_line = l.cell_line""",
    "v_p": """SELECT l_returnflag AS cell_line, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS gene, (CAST(round(l_extendedprice * 100) AS BIGINT) % 10007) / 10007.0::DOUBLE AS p FROM lineitem""",
    "v_image": """SELECT doc_id, 'x/field_F' || lpad((doc_id % 5)::VARCHAR, 5, '0') || '_patch_' || (doc_id % 16) || '_cellline_C' || (doc_id % 3) || '_localid_' || doc_id || '.png' AS image_name, quality::VARCHAR AS predicted_class, CAST((doc_id * 37) % 101 AS DOUBLE) / 101 AS sigmoid_logits FROM labels""",
}


def sql(query: str) -> str:
    """A query with the views that it uses, and those that these use."""
    needed: set[str] = set()
    todo = [query]
    while todo:
        text = todo.pop()
        for name, body in VIEWS.items():
            if name not in needed and name in text.replace(",", " ").replace("(", " ").replace(")", " ").replace(".", " ").split():
                needed.add(name)
                todo.append(body)
    views = ", ".join(f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed)
    body = query.strip()
    if not views:
        return body
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views} {body}"
