from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import identifiers as I
from fieldloom.model import POLYGON
from fieldloom.operators import cohort as C
from fieldloom.operators import measure as M
from fieldloom.operators import outlines as O
from fieldloom.sources import files as S


def test_objects_by_field_and_whole(spark, tmp_path):
    objects = spark.createDataFrame([("S1", "F1", "nuclei", 1), ("S1", "F2", "nuclei", 2), ("S1", "F1", "myotubes", 3)], "slide string, fov string, kind string, object_idx long")
    S.write_objects(objects, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
    assert spark.read.parquet(str(tmp_path / "o/slide=S1/fov=F1/kind=nuclei")).count() == 1


def test_cohorts(spark, tmp_path):
    nuclei = spark.createDataFrame([(1, False, 4), (2, True, 4), (3, False, -1)], "object_idx long, is_edge boolean, myotube_id int")
    tubes = spark.createDataFrame([(4, 1, 0), (5, 0, 0)], "object_idx long, n_normal_nuclei long, n_abnormal_nuclei long")
    S.write_cohorts(nuclei, tubes, str(tmp_path / "c"))
    sizes = {n: spark.read.parquet(str(tmp_path / "c" / n)).count() for n in ("nuclei", "myotubes", "nuclei_non_edge", "myonuclei", "myotubes_classified")}
    assert sizes == {"nuclei": 3, "myotubes": 2, "nuclei_non_edge": 2, "myonuclei": 1, "myotubes_classified": 1}


def test_outlines_scaled_by_image(spark):
    lines = spark.createDataFrame([("a", 0, "0 0 0 0.5 0 0.5 1")], "image_name string, line_no int, line string")
    images = spark.createDataFrame([("a", 200, 100)], "image_name string, width int, height int")
    p = S.scaled_by_image(lines, images).first()["polygon"]
    assert [(q["x"], q["y"]) for q in p] == [(0, 0), (100, 0), (100, 100)]


def test_panel_and_lookup(spark, tmp_path):
    (tmp_path / "p.csv").write_text("gene,x\nB,1\nA,2\nB,3\n")
    assert [r["gene"] for r in S.read_panel(spark, str(tmp_path / "p.csv")).orderBy("pos").collect()] == ["B", "A"]
    (tmp_path / "l.csv").write_text("s1,s2\n,x\n a ,y\n,\n")
    lookup = S.read_field_lines(spark, str(tmp_path / "l.csv"))
    assert [tuple(r) for r in C.field_cell_lines(lookup).orderBy("fov_no").collect()] == [(0, "x"), (1, "a"), (2, "")]
    assert [tuple(r) for r in C.field_cell_lines(lookup, "s2", fov_base=1).orderBy("fov_no").collect()] == [(1, "x"), (2, "y"), (3, "")]


def test_result_without_rows_keeps_its_header(spark, tmp_path):
    S.write_result(spark.createDataFrame([], "gene string, cell_line string, p double").coalesce(1), str(tmp_path / "r"), {"eps": 1})
    assert spark.read.option("header", True).csv(str(tmp_path / "r/params")).first()["eps"] == "1"


def test_columns(spark):
    df = spark.createDataFrame([(1, 2)], "Sample int, score int")
    got = I.resolve_columns(df, {"slide": ["Slide Name", "Sample"], "area": ["area"]}, optional=["area"]).first()
    assert got["slide"] == 1 and got["area"] is None
    with pytest.raises(ValueError, match="area"):
        I.resolve_columns(df, {"area": ["area", "Area"]})
    assert I.require_columns(df, ["score"]) is df


def test_dimensions_kept_only_if_equal(spark):
    a = spark.createDataFrame([([1.0, 2.0],)], "umap array<double>")
    b = spark.createDataFrame([([1.0],)], "umap array<double>")
    assert C.common_dimensions([a, a], "umap") and not C.common_dimensions([a, b], "umap") and not C.common_dimensions([a, b.withColumnRenamed("umap", "x")], "umap")


def test_edge_filter_without_flag(spark):
    df = spark.createDataFrame([(1,)], "object_idx int")
    assert O.drop_edge_objects(df) is df


def test_indices_of_empty_fields(spark):
    schema = "slide string, fov string, object_idx long"
    nuclei = spark.createDataFrame([("s", "a", 1)], schema)
    tubes = spark.createDataFrame([("s", "b", 1)], schema)
    links = spark.createDataFrame([], "slide string, fov string, nuc_idx long, myo_idx long, overlap_frac double")
    got = {r["fov"]: (r["n_nuclei"], r["n_myotubes"], r["differentiation_index"]) for r in M.field_indices(nuclei, tubes, links).collect()}
    assert got == {"a": (1, 0, 0.0), "b": (0, 1, 0.0)}
    assert {(r["fov"], r["k"], r["n_tubes"]) for r in M.nuclei_histogram(M.nuclei_per_tube(tubes, links)).collect()} == {("b", 0, 1)}
    assert M.fusion(M.nuclei_per_tube(tubes, links), nuclei).count() == 2


def test_tagged_union_needs_tables(spark):
    with pytest.raises(ValueError, match="no tables"):
        C.tagged_union({})


def test_empty_outlines(spark):
    none = spark.createDataFrame([], f"image_name string, object_idx long, polygon {POLYGON.simpleString()}")
    assert O.deduplicated(none).count() == 0 and O.morphology(none).count() == 0
    assert O.patch_grid(spark, spark.createDataFrame([("small", 500, 4000)], "image_name string, width int, height int")).count() == 0
    assert none.select(F.size("polygon")).count() == 0


def test_transcripts_by_each_files_header(spark, tmp_path):
    """Files with another order of columns are read by their own header, or refused; never taken by position."""
    for fov, text in (("FOV00001", "target,x,y\nA,1,2\n"), ("FOV00002", "x,y,target,more\n3,4,B,z\n5,bad,C,z\n")):
        (tmp_path / fov).mkdir()
        (tmp_path / fov / f"r_{fov}__target_call_coord.csv").write_text(text)
    got = sorted((r["fov"], r["target"], r["x"], r["y"]) for r in S.read_transcripts(spark, str(tmp_path), mixed_headers=True).collect())
    assert [g[:3] for g in got] == [("F00001", "A", 1.0), ("F00002", "B", 3.0), ("F00002", "C", 5.0)] and [g[3] for g in got] == [2.0, 4.0, None]
    with pytest.raises(Exception, match="(?i)header"):
        S.read_transcripts(spark, str(tmp_path)).collect()
    (tmp_path / "FOV00003").mkdir()
    (tmp_path / "FOV00003" / "a.csv").write_text("gene,x,y\nA,1,2\n")
    with pytest.raises(ValueError, match="target"):
        S.read_transcripts(spark, str(tmp_path), mixed_headers=True)


def test_places_over_a_table(spark):
    from fieldloom.operators.order import placed

    names = spark.range(5000).select((F.col("id") * 7919 % 4001).alias("v"))
    got = placed(names, F.col("v")).collect()
    assert sorted(r["place"] for r in got) == list(range(1, 5001))
    assert [r["v"] for r in sorted(got, key=lambda r: r["place"])] == sorted(r["v"] for r in got)
    assert placed(names.limit(0), F.col("v")).count() == 0


def test_measurement_tables(spark, tmp_path):
    """Rows a tube and a field, per field and together; an outline without area counts in no field's totals."""
    from fieldloom.model import POLYGON
    from fieldloom.operators import measure as M
    from fieldloom.sources import files

    box = lambda x, y, w, h: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    schema = f"slide string, fov int, object_idx long, polygon {POLYGON.simpleString()}"
    tubes = spark.createDataFrame([("S", 1, 0, box(0, 0, 40, 10)), ("S", 1, 1, box(0, 50, 40, 10)), ("S", 2, 0, box(0, 0, 8, 8)), ("S", 2, 1, [])], schema)
    nuclei = spark.createDataFrame([("S", 1, k, box(k, k, 2, 2)) for k in range(4)] + [("S", 2, 0, box(0, 0, 1, 1))], schema)
    links = spark.createDataFrame([("S", 1, 0, 0), ("S", 1, 1, 0), ("S", 1, 2, 1)], "slide string, fov int, nuc_idx long, myo_idx long")
    objects, fields = M.object_rows(tubes, links), M.field_rows(nuclei, tubes, links)
    got = {(r["fov"], r["object_id"]): (r["area"], r["n_nuclei"]) for r in objects.collect()}
    assert got == {(1, 0): (400.0, 2), (1, 1): (400.0, 1), (2, 0): (64.0, 0), (2, 1): (0.0, 0)}
    assert {r["width"] for r in objects.where("fov = 2 and object_id = 1").collect()} == {0.0}
    assert 9.5 < objects.where("fov = 1 and object_id = 0").first()["width"] < 10.7
    assert fields.columns == ["slide", "fov", "total_myotubes", "total_nuclei", "nuclei_in_myotubes", "differentiation_index", "n_nuclei_0", "n_nuclei_1", "n_nuclei_2"]
    assert {tuple(r)[1:] for r in fields.collect()} == {(1, 2, 4, 3, 0.75, 0, 1, 1), (2, 1, 1, 0, 0.0, 1, 0, 0)}
    files.write_measurements(objects, fields, str(tmp_path / "m"))
    read = spark.read.option("header", True).csv(str(tmp_path / "m/per_object/_slide=S/_fov=1"))
    assert read.count() == 2 and read.columns == ["slide", "fov", "object_id", "width", "area", "n_nuclei"]
    assert spark.read.option("header", True).csv(str(tmp_path / "m/combined/all_per_field")).count() == 2
    assert M.field_rows(nuclei, tubes.limit(0), links.limit(0)).count() == 2
