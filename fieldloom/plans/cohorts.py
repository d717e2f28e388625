"""Queries on cohorts, labels, effects and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import identifiers as I
from fieldloom.operators.order import placed
from fieldloom.operators import cohort as C
from fieldloom.operators import effects as E
from fieldloom.operators import matching as N
from fieldloom.operators import measure as M
from fieldloom.plans import differential as D
from fieldloom.plans import standins as V
from fieldloom.sessions import cut, owning
from fieldloom.sources import files as S

#: Thresholds scaled to the stand-in tables, so that both sides of each filter hold something.
MIN_TOTAL, MIN_CELLS, MIN_SEEN = 500, 20, 20
QUERIES = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = V.sql(text)
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# quality control


@query("SELECT cell, total, n_genes FROM v_qc")
def cell_qc(spark: SparkSession, d: str) -> DataFrame:
    return C.cell_qc(V.cells(spark, d), V.counts(spark, d)).select("cell", "total", "n_genes")


@query("SELECT gene, count(*) FILTER (WHERE n > 0) AS n_cells FROM v_counts GROUP BY gene")
def gene_ncells(spark: SparkSession, d: str) -> DataFrame:
    return C.gene_cells(V.counts(spark, d))


@query(f"""WITH good AS (SELECT cell FROM v_counts GROUP BY cell HAVING sum(n) >= {MIN_TOTAL}), rest AS (SELECT * FROM v_counts WHERE cell IN (SELECT cell FROM good)),
g AS (SELECT gene FROM rest WHERE n > 0 GROUP BY gene HAVING count(*) >= {MIN_CELLS} AND NOT regexp_matches(gene, '(?i)SystemControl|Negative')) SELECT cell, gene, n FROM rest WHERE gene IN (SELECT gene FROM g)""")
def qc_cascade(spark: SparkSession, d: str) -> DataFrame:
    return C.qc_cascade(V.counts(spark, d), min_total=MIN_TOTAL, min_cells=MIN_CELLS).select("cell", "gene", "n")


@query("""WITH a AS (SELECT count(DISTINCT cell) AS cells, count(DISTINCT gene) AS genes, CAST(sum(n) AS BIGINT) AS total FROM v_counts) SELECT 'before' AS stage, * FROM a UNION ALL
SELECT 'after', count(DISTINCT cell), count(DISTINCT gene), CAST(sum(n) AS BIGINT) FROM (WITH good AS (SELECT cell FROM v_counts GROUP BY cell HAVING sum(n) >= 500), rest AS (SELECT * FROM v_counts WHERE cell IN (SELECT cell FROM good)),
g AS (SELECT gene FROM rest WHERE n > 0 GROUP BY gene HAVING count(*) >= 20 AND NOT regexp_matches(gene, '(?i)SystemControl|Negative')) SELECT * FROM rest WHERE gene IN (SELECT gene FROM g))""")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    before = V.counts(spark, d)
    after = C.qc_cascade(before, min_total=MIN_TOTAL, min_cells=MIN_CELLS)
    shape = [F.count_distinct("cell").alias("cells"), F.count_distinct("gene").alias("genes"), F.sum("n").alias("total")]
    return before.agg(*shape).select(F.lit("before").alias("stage"), "*").unionByName(after.agg(*shape).select(F.lit("after").alias("stage"), "*"))


@query("SELECT cell_line, count(total) AS n, round(avg(total), 6) AS mean, round(stddev_samp(total), 6) AS sd, CAST(min(total) AS DOUBLE) AS least, quantile_cont(total, 0.25) AS q25, quantile_cont(total, 0.5) AS median, quantile_cont(total, 0.75) AS q75, CAST(max(total) AS DOUBLE) AS most FROM v_qc GROUP BY cell_line")
def total_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.five_numbers(C.cell_qc(V.cells(spark, d), V.counts(spark, d)), "total", ["cell_line"]), "mean", "sd")


# labels


def _classified(spark: SparkSession, d: str) -> DataFrame:
    """Cells with the class of the label of their number; labels repeat nothing, the lowest text would win."""
    cells = C.cell_qc(V.cells(spark, d), V.counts(spark, d)).withColumn("local_id", F.col("cell"))
    return C.merge_classes(cells, V.classes(spark, d), ["local_id"], ["predicted_class"])


MERGED = "v_qc q LEFT JOIN v_class c ON q.cell = c.local_id"


@query(f"SELECT q.cell, q.cell_line, c.predicted_class FROM {MERGED}")
def classifier_merge(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("cell", "cell_line", "predicted_class")


@query(f"SELECT count(*) AS n, count(c.predicted_class) AS assigned, count(*) - count(c.predicted_class) AS missing FROM {MERGED}")
def match_coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.match_coverage(_classified(spark, d))


@query(f"SELECT cell_line, predicted_class, n, round(100 * n / sum(n) OVER (PARTITION BY cell_line), 6) AS pct FROM (SELECT q.cell_line, c.predicted_class, count(*) AS n FROM {MERGED} GROUP BY ALL)")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.class_distribution(_classified(spark, d)), "pct")


@query(f"SELECT c.predicted_class, count(*) AS n FROM {MERGED} GROUP BY ALL")
def class_frequency(spark: SparkSession, d: str) -> DataFrame:
    return C.frequency(_classified(spark, d), "predicted_class")


@query(f"""SELECT slide, count(*) AS n_cells, round(avg(total), 6) AS mean_total, round(avg(n_genes), 6) AS mean_n_genes, round(avg(total) FILTER (WHERE predicted_class = '0'), 6) AS mean_total_0, round(avg(n_genes) FILTER (WHERE predicted_class = '0'), 6) AS mean_n_genes_0,
round(avg(total) FILTER (WHERE predicted_class = '1'), 6) AS mean_total_1, round(avg(n_genes) FILTER (WHERE predicted_class = '1'), 6) AS mean_n_genes_1 FROM {MERGED} GROUP BY slide""")
def slide_stats(spark: SparkSession, d: str) -> DataFrame:
    s = C.slide_statistics(_classified(spark, d), ["0", "1"])
    return rounded(s, *[c for c in s.columns if c.startswith("mean_")])


@query("""SELECT doc_id, 'sl1' AS slide, 'F' || lpad((doc_id % 5)::VARCHAR, 5, '0') AS field, CAST(doc_id % 16 AS INT) AS patch_idx, 'C' || (doc_id % 3) AS cell_line, CAST(doc_id AS INT) AS local_id, predicted_class, sigmoid_logits FROM v_image""")
def classifier_table(spark: SparkSession, d: str) -> DataFrame:
    t = C.classifier_table(V.image_names(spark, d), "SL1")
    return t.select(F.col("local_id").cast("long").alias("doc_id"), "slide", "field", "patch_idx", "cell_line", "local_id", "predicted_class", "sigmoid_logits")


@query("""SELECT image_name, 'field_F' || lpad((doc_id % 5)::VARCHAR, 5, '0') || '_patch_' || (doc_id % 16) || '_cellline_C' || (doc_id % 3) || '_localid_' || doc_id AS crop_key, 'F' || lpad((doc_id % 5)::VARCHAR, 5, '0') AS fov, CAST(doc_id % 5 AS INT) AS fov_no, CAST(doc_id % 16 AS INT) AS patch_idx, TRUE AS of_fov FROM v_image""")
def name_parts(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("image_name")
    n = V.image_names(spark, d).withColumns(I.crop_fields(I.image_stem(name)))
    return n.select("image_name", I.crop_key(F.col("field"), F.col("patch_idx"), F.col("cell_line"), F.col("local_id")).alias("crop_key"), I.fov_token(name).alias("fov"), F.regexp_extract(I.fov_token(name), r"(\d+)", 1).cast("int").alias("fov_no"), I.patch_index(name).alias("patch_idx"), I.of_fov(name, I.fov_token(name)).alias("of_fov"))


RAW_CLASS = "CASE c_custkey % 7 WHEN 0 THEN ' Normal' WHEN 1 THEN 'abnormal ' WHEN 2 THEN '1' WHEN 3 THEN '0.7' WHEN 4 THEN 'x' WHEN 5 THEN NULL ELSE '2' END"


@query(f"""SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE -1 END AS binary, CASE c_custkey % 7 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Abnormal' WHEN 2 THEN 'Abnormal' END AS grp,
CASE c_custkey % 7 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 6 THEN 2 ELSE -1 END AS whole, c_custkey % 7 = 2 AS flag, upper(trim(c_mktsegment)) AS slide, c_custkey % 7 <> 5 AS tube, trim({RAW_CLASS}) AS key FROM customer""")
def repaired_labels(spark: SparkSession, d: str) -> DataFrame:
    raw = V.table(spark, d, "customer").selectExpr("c_custkey", "c_mktsegment", f"{RAW_CLASS} as raw")
    v = F.col("raw")
    return raw.select("c_custkey", F.coalesce(I.binary_class(v), F.lit(-1)).alias("binary"), I.class_group(v, ["normal"], ["abnormal", "1"]).alias("grp"), F.coalesce(I.lenient_int(v), F.lit(-1)).alias("whole"), I.as_flag(v, "string").alias("flag"), I.slide_key(F.col("c_mktsegment")).alias("slide"), I.in_tube(v).alias("tube"), I.as_key(v).alias("key"))


def _tubes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as tubes, with the classes of the customers of their nation and number modulo 40."""
    nuclei = V.table(spark, d, "customer").selectExpr("c_nationkey as nation", "c_custkey % 40 as tube", "c_custkey").join(V.classes(spark, d), F.expr("c_custkey = local_id"), "left")
    grouped = nuclei.withColumn("class_group", I.class_group(F.col("predicted_class"), ["0"], ["1"])).where("class_group is not null")
    tubes = V.table(spark, d, "supplier").selectExpr("s_suppkey as cell", "s_nationkey as nation", "s_suppkey % 40 as tube")
    return C.with_class_counts(tubes, C.tube_class_counts(grouped, ["nation", "tube"]), ["nation", "tube"])


TUBES = """(SELECT s.s_suppkey AS cell, coalesce(n.a, 0) AS n_normal_nuclei, coalesce(n.b, 0) AS n_abnormal_nuclei FROM supplier s LEFT JOIN (SELECT c_nationkey, c_custkey % 40 AS tube, count(*) FILTER (WHERE predicted_class = '0') AS a, count(*) FILTER (WHERE predicted_class = '1') AS b
FROM customer JOIN v_class ON c_custkey = local_id GROUP BY ALL) n ON n.c_nationkey = s.s_nationkey AND n.tube = s.s_suppkey % 40)"""


@query(f"SELECT * FROM {TUBES}")
def tube_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return _tubes(spark, d).select("cell", "n_normal_nuclei", "n_abnormal_nuclei")


@query(f"""SELECT cell, CASE WHEN n_normal_nuclei + n_abnormal_nuclei > 0 THEN 100 * n_abnormal_nuclei / (n_normal_nuclei + n_abnormal_nuclei) END AS pct_abnormal,
CAST(CASE WHEN n_normal_nuclei + n_abnormal_nuclei = 0 THEN -1 WHEN n_abnormal_nuclei = 0 THEN 1 WHEN n_normal_nuclei = 0 THEN 2 ELSE 3 END AS INT) AS morphology_class FROM {TUBES}""")
def morph_class(spark: SparkSession, d: str) -> DataFrame:
    return C.morphology_class(_tubes(spark, d)).select("cell", "pct_abnormal", "morphology_class")


@query(f"SELECT cell FROM {TUBES} WHERE n_normal_nuclei + n_abnormal_nuclei > 0")
def classified_tubes(spark: SparkSession, d: str) -> DataFrame:
    return C.classified_tubes(_tubes(spark, d)).select("cell")


@query("""SELECT c_custkey AS cell, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 3 = 0 THEN 'B' || n_name ELSE n_name END, '') AS cell_line FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20""")
def field_cell_lines(spark: SparkSession, d: str) -> DataFrame:
    """A positional lookup with blanks; fields beyond its end have no line."""
    lookup = V.table(spark, d, "nation").where("n_nationkey < 20").selectExpr("n_nationkey as row_idx", "case when n_nationkey % 3 = 0 or n_nationkey % 4 = 0 then ' ' else n_name end as slide_a", "case when n_nationkey % 4 = 0 then '' else concat('B', n_name) end as slide_b")
    objects = V.table(spark, d, "customer").selectExpr("c_custkey as cell", "c_nationkey as fov_no")
    return C.with_cell_line(objects, C.field_cell_lines(lookup)).select("cell", "cell_line")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return C.first_per_key(V.table(spark, d, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT p_partkey, p_brand || CASE WHEN rn > 0 THEN '.' || rn ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS rn FROM part)")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    return C.unique_names(V.table(spark, d, "part").selectExpr("p_partkey", "p_brand as name"), "name", ["p_partkey"])


@query("SELECT 'A' AS slide, 'A_' || c_custkey AS cell, c_acctbal AS balance, NULL::VARCHAR AS segment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'B', 'B_' || c_custkey, NULL, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def slide_union(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "customer")
    a = c.where("c_custkey % 2 = 0").selectExpr("c_custkey as cell", "c_acctbal as balance")
    b = c.where("c_custkey % 2 = 1").selectExpr("c_custkey as cell", "c_mktsegment as segment")
    return C.tagged_union({"A": a, "B": b}, prefix="cell")


@query("SELECT cell, gene, n, dense_rank() OVER (ORDER BY gene) - 1 AS gene_idx FROM v_counts")
def gene_alignment(spark: SparkSession, d: str) -> DataFrame:
    return C.on_gene_union(V.counts(spark, d)).select("cell", "gene", "n", "gene_idx")


@query("SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY l_partkey")
def long_to_wide(spark: SparkSession, d: str) -> DataFrame:
    w = C.wide(V.table(spark, d, "lineitem").select("l_partkey", "l_returnflag", F.lit(1).alias("one")), "l_partkey", "l_returnflag", "one", ["A", "N", "R"])
    return w.toDF("l_partkey", "a", "n", "r")


@query("SELECT fov, count(*) AS n FROM (SELECT *, count(DISTINCT CASE WHEN kind = 'nuclei' THEN patch_idx END) OVER (PARTITION BY fov) AS a, count(DISTINCT CASE WHEN kind = 'myotubes' THEN patch_idx END) OVER (PARTITION BY fov) AS b FROM (SELECT 'nuclei' AS kind, CAST(c_nationkey AS INT) AS fov, CAST(c_custkey % 16 AS INT) AS patch_idx FROM customer UNION ALL SELECT 'myotubes', CAST(s_nationkey AS INT), CAST(s_suppkey % 16 AS INT) FROM supplier)) WHERE a >= 3 AND b >= 3 GROUP BY fov")
def complete_fields(spark: SparkSession, d: str) -> DataFrame:
    a = V.table(spark, d, "customer").selectExpr("'nuclei' as kind", "cast(c_nationkey as int) as fov", "cast(c_custkey % 16 as int) as patch_idx")
    b = V.table(spark, d, "supplier").selectExpr("'myotubes' as kind", "cast(s_nationkey as int) as fov", "cast(s_suppkey % 16 as int) as patch_idx")
    return C.complete_fields(a.unionByName(b), ["fov"], 3).groupBy("fov").agg(F.count("*").alias("n"))


# effects


def _detected(spark: SparkSession, d: str) -> DataFrame:
    return E.detected_genes(V.counts(spark, d), V.cells(spark, d), MIN_SEEN)


def _factors(spark: SparkSession, d: str) -> DataFrame:
    return E.size_factors(V.cells(spark, d), V.counts(spark, d), _detected(spark, d))


@query("SELECT cell_line, gene FROM v_detected")
def gene_detection(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d)


@query("SELECT cell, cell_line, total, round(size_factor, 9) AS size_factor FROM v_factor")
def size_factors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_factors(spark, d), "size_factor", places=9).select("cell", "cell_line", "total", "size_factor")


@query("""WITH l AS (SELECT cell_line, sum(size_factor) FILTER (WHERE "group" = 0) AS s0, sum(size_factor) FILTER (WHERE "group" = 1) AS s1 FROM v_factor GROUP BY cell_line),
s AS (SELECT f.cell_line, k.gene, CAST(sum(CASE WHEN f."group" = 0 THEN k.n ELSE 0 END) AS BIGINT) AS sum_0, CAST(sum(CASE WHEN f."group" = 1 THEN k.n ELSE 0 END) AS BIGINT) AS sum_1 FROM v_counts k JOIN v_factor f ON k.cell = f.cell JOIN v_detected d ON d.cell_line = f.cell_line AND d.gene = k.gene GROUP BY ALL)
SELECT s.cell_line, gene, sum_0, sum_1, round(sum_0 / s0, 6) AS mean_0, round(sum_1 / s1, 6) AS mean_1, round(log2((sum_1 / s1 + 1e-6) / (sum_0 / s0 + 1e-6)), 6) AS log2fc FROM s JOIN l ON s.cell_line = l.cell_line""")
@owning
def de_means_lfc(spark: SparkSession, d: str) -> DataFrame:
    factors, _ = cut(_factors(spark, d), "factors")
    return rounded(E.group_means(V.counts(spark, d), factors, _detected(spark, d)), "mean_0", "mean_1", "log2fc").select("cell_line", "gene", "sum_0", "sum_1", "mean_0", "mean_1", "log2fc")


@query("SELECT cell_line, p, round(least(1, min(p * n / rank) OVER (PARTITION BY cell_line ORDER BY rank DESC)), 9) AS p_adj FROM (SELECT *, row_number() OVER (PARTITION BY cell_line ORDER BY p) AS rank, count(*) OVER (PARTITION BY cell_line) AS n FROM v_p)")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.adjusted(V.pvalues(spark, d), ["cell_line"]), "p_adj", places=9).select("cell_line", "p", "p_adj")


@query("""SELECT cell_line, count(*) FILTER (WHERE s) AS significant, count(*) FILTER (WHERE s AND l > 0) AS up, count(*) FILTER (WHERE s AND l < 0) AS down FROM (SELECT cell_line, p - 0.5 AS l, (p * p < 0.05 AND abs(p - 0.5) >= 0.25) AS s FROM v_p) GROUP BY cell_line""")
def significance_counts(spark: SparkSession, d: str) -> DataFrame:
    f = E.flagged(V.pvalues(spark, d).withColumns({"log2fc": F.col("p") - 0.5, "p_adj": F.col("p") * F.col("p")}))
    return f.groupBy("cell_line").agg(*(F.count_if(c).alias(c) for c in ("significant", "up", "down")))


@query("SELECT cell_line, gene, v, rank FROM (SELECT *, p - 0.5 AS v, CAST(row_number() OVER (PARTITION BY cell_line ORDER BY abs(p - 0.5) DESC, gene) AS INT) AS rank FROM v_p) WHERE rank <= 10")
def topk_effects(spark: SparkSession, d: str) -> DataFrame:
    return E.top_effects(V.pvalues(spark, d).withColumn("v", F.col("p") - 0.5), 10, "cell_line", "v", absolute=True).select("cell_line", "gene", "v", "rank")


@query("SELECT n_name AS cell_line, CASE WHEN count(DISTINCT CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE c_custkey % 2 END) < 2 THEN 'a class is missing' ELSE 'no gene passes' END AS reason FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 0 OR n_nationkey % 3 = 1 GROUP BY n_name")
def skipped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Nations as lines: every third has one class only, the next none of its genes, the rest all."""
    c = V.table(spark, d, "customer").join(F.broadcast(V.table(spark, d, "nation")), F.expr("c_nationkey = n_nationkey"))  # 25 nations at any size
    cells = c.selectExpr("c_custkey as cell", "n_name as cell_line", "n_nationkey", "case when n_nationkey % 3 = 0 then 0 else c_custkey % 2 end as group")
    genes = cells.where("n_nationkey % 3 <> 1").select("cell_line", F.lit("g").alias("gene")).distinct()
    return E.skipped_lines(cells, genes, cells.withColumn("total", F.lit(1)))


@query("""SELECT cell, cell_line FROM v_cells WHERE cell % 97 >= 10 AND (cell % 101 / 101 < 0.4 OR cell % 101 / 101 > 0.6)""")
def testable_objects(spark: SparkSession, d: str) -> DataFrame:
    cells = V.cells(spark, d).withColumns({"area": F.col("cell") % 97, "sigmoid": (F.col("cell") % 101) / F.lit(101.0)})
    return E.testable_objects(cells, min_area=10, band=(0.6, 0.4)).select("cell", "cell_line")


@query("SELECT cell_line, round(avg(p), 9) AS mean, round(stddev_samp(p), 9) AS sd, round(quantile_cont(p, 0.5), 9) AS median, min(p) AS least, max(p) AS most FROM v_p GROUP BY cell_line")
def covariate_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.covariate_summary(V.pvalues(spark, d), "cell_line", "p"), "mean", "sd", "median", places=9)


@query("SELECT event_id, round((value - min(value) OVER w) / greatest(max(value) OVER w - min(value) OVER w, 1e-9), 9) AS normalised FROM events WINDOW w AS (PARTITION BY event_type)")
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.range_normalised(V.table(spark, d, "events"), ["event_type"], "value"), "normalised", places=9).select("event_id", "normalised")


@query("SELECT event_id, round(CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE 0 END, 6) + 0.0 AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def zscore_group(spark: SparkSession, d: str) -> DataFrame:
    z = E.z_scored(V.table(spark, d, "events"), ["user_id"], "value", "z")
    return z.select("event_id", (F.round("z", 6) + F.lit(0.0)).alias("z"))


@query(f"SELECT cell, (n_abnormal_nuclei + 0.5) / (n_normal_nuclei + n_abnormal_nuclei + 1.0) AS prop FROM {TUBES}")
def stabilised_prop(spark: SparkSession, d: str) -> DataFrame:
    return _tubes(spark, d).select("cell", E.stabilised_share(F.col("n_abnormal_nuclei"), F.col("n_normal_nuclei") + F.col("n_abnormal_nuclei")).alias("prop"))


@query("""WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_line ORDER BY p DESC, gene) AS rk FROM v_p) WHERE rk <= 10), r AS (SELECT cell_line, quantile_cont(p, 0.5) AS total_ref_sc, min(p) AS least, max(p) AS most FROM v_p GROUP BY cell_line),
g AS (SELECT t.cell_line, t.gene, p, total_ref_sc, least + i * (most - least) / 49.0 AS prop FROM t JOIN r ON t.cell_line = r.cell_line CROSS JOIN (SELECT unnest(range(50)) AS i))
SELECT cell_line, gene, round(prop, 9) AS prop_abn, round(exp(p + p / 2 * total_ref_sc - p * prop), 6) AS mu FROM g""")
def pred_grid(spark: SparkSession, d: str) -> DataFrame:
    """Predictions over each line's own range, from stand-in coefficients; :func:`nb_trend_grid` has fitted ones."""
    top = E.top_effects(V.pvalues(spark, d), 10, "cell_line", "p")
    coefficients = top.select("cell_line", "gene", F.col("p").alias("beta0"), (F.col("p") / 2).alias("beta_total"), (-F.col("p")).alias("beta_prop"))
    reference = V.pvalues(spark, d).groupBy("cell_line").agg(F.percentile("p", F.lit(0.5)).alias("total_ref_sc"), F.min("p").alias("prop_least"), F.max("p").alias("prop_most"))
    return rounded(E.prediction_surface(coefficients, reference), "prop_abn", places=9).select("cell_line", "gene", "prop_abn", F.round("mu", 6).alias("mu"))


@query()
def nb_de(spark: SparkSession, d: str) -> DataFrame:
    """Two groups of cells by cell line: fits, tests and flags."""
    return D.two_groups(V.cells(spark, d), V.counts(spark, d), min_cells=MIN_SEEN)[0]


@query()
def nb_de_tubes(spark: SparkSession, d: str) -> DataFrame:
    """Two groups of tubes, morphology class 2 against 1; every other cell stands for a tube of one class."""
    tubes = V.cells(spark, d).withColumn("morphology_class", F.when(F.col("cell") % 3 == 0, -1).otherwise(F.col("group") + 1))
    grouped = tubes.where(F.col("morphology_class").isin(1, 2)).withColumn("group", (F.col("morphology_class") == 2).cast("int"))
    return D.two_groups(grouped, V.counts(spark, d), min_cells=MIN_SEEN, dispersions=D.TUBES)[0]


def _nuclei(spark: SparkSession, d: str) -> DataFrame:
    tubes = V.cells(spark, d).withColumns({"n_normal_nuclei": F.when(F.col("group") == 0, 1 + F.col("cell") % 5).otherwise(0), "n_abnormal_nuclei": F.when(F.col("group") == 1, 1 + F.col("cell") % 4).otherwise(0)})
    return C.morphology_class(tubes)


@query()
def nb_trend(spark: SparkSession, d: str) -> DataFrame:
    """Regression on the number of nuclei and their abnormal share, with slides."""
    return D.trend(_nuclei(spark, d), V.counts(spark, d), min_tubes=MIN_SEEN)[0]


@query()
def nb_trend_grid(spark: SparkSession, d: str) -> DataFrame:
    """Means that the fitted trend predicts for each line's 50 genes with the largest effect of the abnormal share."""
    result, _, tested = D.trend(_nuclei(spark, d), V.counts(spark, d), min_tubes=MIN_SEEN)
    return D.trend_predictions(result, tested)


# names and files


@query("SELECT p_name, row_number() OVER (ORDER BY CAST(regexp_extract(p_name, '(\\d+)', 1) AS BIGINT), p_name) AS place FROM (SELECT DISTINCT 'img' || p_partkey // 2 || '_v' || p_partkey % 7 AS p_name FROM part)".replace("CAST(regexp_extract(p_name, '(\\d+)', 1) AS BIGINT), p_name", "CAST(regexp_extract(p_name, 'img([0-9]+)', 1) AS BIGINT), CAST(regexp_extract(p_name, '_v([0-9]+)', 1) AS BIGINT)"))
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    names = V.table(spark, d, "part").selectExpr("concat('img', p_partkey div 2, '_v', p_partkey % 7) as p_name").distinct()
    return placed(names, I.natural_key(F.col("p_name")))


#: A name without a match begins with so many characters of a candidate; all its others are in no candidate, so that twice
#: these over both lengths is the best ratio that it can have.
_BEGINS = "4 + c_custkey % 7"


@query(f"""WITH c AS (SELECT *, {_BEGINS} AS k, c_custkey > (SELECT max(s_suppkey) FROM supplier) AS apart, 1 + c_custkey % (SELECT max(s_suppkey) FROM supplier) AS near FROM customer)
SELECT CASE WHEN apart THEN substr(md5(near::VARCHAR), 1, k) || substr(translate(md5(c_custkey::VARCHAR), '0123456789abcdef', 'ghijklmnopqrstuv'), 1, 20 - k) ELSE substr(md5(c_custkey::VARCHAR), 1, 20) END || '.tif' AS name, CASE WHEN s_suppkey % 2 = 1 THEN substr(md5(s_suppkey::VARCHAR), 1, 20) || '.txt' WHEN s_suppkey % 2 = 0 THEN substr(md5(s_suppkey::VARCHAR), 1, 10) || 'z' || substr(md5(s_suppkey::VARCHAR), 12, 9) || '.txt' END AS match,
CASE WHEN apart THEN 2.0::DOUBLE * k / 40 WHEN s_suppkey % 2 = 1 THEN 1.0 ELSE 0.95 END::DOUBLE AS score, CASE WHEN apart THEN 'none' WHEN s_suppkey % 2 = 1 THEN 'exact' ELSE 'fuzzy' END AS mode FROM c LEFT JOIN supplier ON c_custkey = s_suppkey""")
def name_match(spark: SparkSession, d: str) -> DataFrame:
    """Digests as names, every other one with a letter changed: exact stems, close ones, and the best ratio of the rest."""
    most = V.table(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0]
    digest = F.md5(F.col("c_custkey").cast("string"))
    k = F.expr(_BEGINS).cast("int")
    other = F.translate(digest, "0123456789abcdef", "ghijklmnopqrstuv")
    apart = F.concat(F.substr(F.md5((1 + F.col("c_custkey") % most).cast("string")), F.lit(1), k), F.substr(other, F.lit(1), 20 - k))
    left = V.table(spark, d, "customer").select(F.concat(F.when(F.col("c_custkey") > most, apart).otherwise(F.substring(digest, 1, 20)), F.lit(".tif")).alias("name"))
    stem = F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 20)
    changed = F.concat(F.substring(stem, 1, 10), F.lit("z"), F.substring(stem, 12, 9))
    right = V.table(spark, d, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 1, stem).otherwise(changed), F.lit(".txt")).alias("name"))
    return N.match_names(left, right)


@query("SELECT stem, arg_min(name, rk) AS name FROM (SELECT 'f' || s_suppkey AS stem, 'f' || s_suppkey || e.x AS name, e.rk FROM supplier, (VALUES ('.tif', 1, 0), ('.png', 2, 1), ('.jpg', 3, 2)) e(x, rk, m) WHERE s_suppkey % 4 <> m) GROUP BY stem")
def match_by_extension(spark: SparkSession, d: str) -> DataFrame:
    s = V.table(spark, d, "supplier")
    kinds = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(m).alias("m")) for x, m in ((".tif", 0), (".png", 1), (".jpg", 2)))))
    files = s.select("s_suppkey", kinds.alias("e")).where("s_suppkey % 4 <> e.m").select(F.concat(F.lit("f"), "s_suppkey", "e.x").alias("name"))
    return N.match_by_extension(s.select(F.concat(F.lit("f"), "s_suppkey").alias("stem")), files, [".tif", ".png", ".jpg"]).select("stem", "name")


@query("SELECT o_custkey AS image_name, count(*) AS n FROM orders WHERE o_custkey % 10 = 0 GROUP BY ALL")
def missing_images(spark: SparkSession, d: str) -> DataFrame:
    objects = V.table(spark, d, "orders").selectExpr("o_custkey as image_name", "o_orderkey as object_idx")
    images = V.table(spark, d, "orders").selectExpr("o_custkey as image_name").where("image_name % 10 <> 0").distinct()
    return N.missing_images(objects, images)


@query("SELECT count(*) AS n FROM orders WHERE o_custkey % 10 <> 0")
def with_images(spark: SparkSession, d: str) -> DataFrame:
    objects = V.table(spark, d, "orders").selectExpr("o_custkey as image_name", "o_orderkey as object_idx")
    images = V.table(spark, d, "orders").selectExpr("o_custkey as image_name").where("image_name % 10 <> 0").distinct()
    return N.with_images(objects, images).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS stem, 100 + p_size AS width FROM part WHERE p_size % 3 <> 0")
def paired_modalities(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part")
    a = p.selectExpr("p_partkey as stem", "100 + p_size as width", "100 as height")
    b = p.selectExpr("p_partkey as stem", "100 + p_size as width", "case when p_size % 3 = 0 then 90 else 100 end as height")
    return N.paired_modalities(a, b).select("stem", "width")


@query("SELECT 'im' || p_partkey || '_ch_z' AS stem, 'im' || p_partkey || '_ch1_z' AS first, 'im' || p_partkey || '_ch2_z' AS second FROM part WHERE p_partkey % 3 <> 0")
def channel_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part")
    files = p.selectExpr("concat('im', p_partkey, '_ch1_z') as name").unionByName(p.where("p_partkey % 3 <> 0").selectExpr("concat('im', p_partkey, '_ch2_z') as name"))
    return N.channel_pairs(files, 1, 2)


@query("SELECT c_custkey AS object_idx, CAST(c_nationkey AS INT) AS fov, c_mktsegment AS label, CAST(c_custkey % 16 AS INT) AS patch_idx FROM customer")
def aligned_outlines(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "customer")
    a = c.selectExpr("c_custkey as object_idx", "cast(c_nationkey as int) as fov", "c_mktsegment as label")
    return N.aligned(a, c.selectExpr("c_custkey as object_idx", "cast(c_nationkey as int) as fov", "cast(c_custkey % 16 as int) as patch_idx"), ["fov", "object_idx"], ["fov"])


@query("SELECT c_custkey AS line_no, 3 + c_custkey % 3 AS n_points, (c_custkey % 100) / 100 * 1024 AS first_x FROM customer WHERE c_custkey % 5 NOT IN (1, 2, 3)")
def parsed_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Text lines of outlines, some blank, odd or too short, read back as polygons."""
    xy = "concat_ws(' ', transform(sequence(1, 3 + cast(c_custkey % 3 as int)), i -> concat(c_custkey % 100 / 100.0D, ' ', i / 10.0D)))"
    line = f"case c_custkey % 5 when 1 then '  ' when 2 then concat('0 ', {xy}, ' 0.5') when 3 then '0 0.1 0.1 0.2 0.2' else concat('0 ', {xy}) end"
    rows = V.table(spark, d, "customer").selectExpr("'m' as image_name", "c_custkey as line_no", f"{line} as line")
    found = S.parse_outlines(rows, 1024.0)
    return found.select("line_no", F.size("polygon").cast("long").alias("n_points"), F.col("polygon")[0]["x"].alias("first_x"))


@query("SELECT p_brand AS gene, min(p_partkey) AS pos FROM part GROUP BY p_brand")
def gene_panel(spark: SparkSession, d: str) -> DataFrame:
    return S.panel(V.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("target")), "p_partkey")


@query("SELECT object_idx, '0 ' || printf('%.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', cx - r, cy - r, cx + r, cy - r, cx + r, cy + r, cx - r, cy + r) AS line FROM v_dedup")
def outline_lines(spark: SparkSession, d: str) -> DataFrame:
    return S.outline_lines(V.nested_squares(spark, d).withColumn("cls", F.lit(0))).select("object_idx", "line")
