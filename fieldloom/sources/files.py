"""Readers and writers of the pipeline's files: spots, outlines, panels, lookups, results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldloom.functions import identifiers as I


def folder_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def read_transcripts(spark: SparkSession, root: str, *, mixed_headers: bool = False) -> DataFrame:
    """Spots (fov, target, x, y) of the CSV files in one folder per field under ``root``.

    The field comes from the folder's name. Of a folder's files the first named ``*_target_call_coord.csv`` counts, else
    the first ``*.csv``; a folder without one gives nothing. All files must have one header, which Spark checks for each
    file while it reads; with ``mixed_headers`` each file's own header says where its columns are, at the price of one
    more pass over the files. A file that lacks one of the columns is an error.
    """
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(root).select("path")
    rank = F.when(F.col("path").endswith("_target_call_coord.csv"), 0).otherwise(1)
    first = Window.partitionBy(folder_of(F.col("path"))).orderBy(rank, "path")
    chosen = names.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).select("path")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    if not mixed_headers:
        reader = spark.read.option("header", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true")
        raw = reader.option("enforceSchema", False).schema(reader.csv(root).schema).csv(root)
        I.require_columns(raw, ["target", "x", "y"], "transcript table")
        placed = raw.select("target", F.col("x").try_cast("double").alias("x"), F.col("y").try_cast("double").alias("y"), plain(F.col("_metadata.file_path")).alias("_path"))
        return placed.join(chosen.select(plain("path").alias("_path")), "_path", "left_semi").select(I.fov_token(folder_of(F.col("_path"))).alias("fov"), "target", "x", "y")
    heads = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    heads = heads.where(F.col("_metadata.file_block_start") == 0).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("_at"))
    header = heads.groupBy("path").agg(F.min_by("value", "_at").alias("header"))
    kinds = header.withColumn("_path", plain("path")).join(chosen.select(plain("path").alias("_path")), "_path", "left_semi")
    orders = [r["header"] for r in kinds.select("header").distinct().collect()]  # a handful: what wrote the files decides them
    out = spark.createDataFrame([], "fov string, target string, x double, y double")
    for order in orders:
        columns = [c.strip().strip('"') for c in order.rstrip("\r").split(",")]
        if missing := [c for c in ("target", "x", "y") if c not in columns]:
            raise ValueError(f"transcript table lacks columns {missing}; it has {columns}")
        own = kinds.where(F.col("header") == order).select("_path")
        schema = ", ".join(f"`c{k}` string" for k in range(len(columns)))
        at = {c: f"c{columns.index(c)}" for c in ("target", "x", "y")}
        raw = spark.read.option("header", True).option("enforceSchema", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").schema(schema).csv(root)
        placed = raw.select(F.col(at["target"]).alias("target"), F.col(at["x"]).try_cast("double").alias("x"), F.col(at["y"]).try_cast("double").alias("y"), plain(F.col("_metadata.file_path")).alias("_path"))
        out = out.unionByName(placed.join(own, "_path", "left_semi").select(I.fov_token(folder_of(F.col("_path"))).alias("fov"), "target", "x", "y"))
    return out


def parse_outlines(lines: DataFrame, scale: Column | float = 1.0, scale_y: Column | float | None = None) -> DataFrame:
    """Outlines from lines (image_name, line_no, line): class and x y pairs from 0 to 1, by the scale.

    Blank lines, odd numbers of coordinates, unreadable numbers and under three points are left out.
    """
    sx = F.lit(scale) if isinstance(scale, float) else scale
    sy = sx if scale_y is None else F.lit(scale_y) if isinstance(scale_y, float) else scale_y
    parts = F.split(F.trim("line"), r"\s+")
    numbers = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: s.try_cast("double"))
    split = lines.where(F.trim("line") != "").select("*", F.element_at(parts, 1).alias("cls"), numbers.alias("_v"))
    good = split.where((F.size("_v") % 2 == 0) & (F.size("_v") >= 6) & ~F.exists("_v", lambda v: v.isNull()))
    at = F.sequence(F.lit(0), F.expr("size(_v) div 2 - 1"))
    poly = F.transform(at, lambda i: F.struct((F.element_at("_v", (2 * i + 1).cast("int")) * sx).alias("x"), (F.element_at("_v", (2 * i + 2).cast("int")) * sy).alias("y")))
    return good.withColumn("polygon", poly).drop("_v", "line")


def read_outlines(spark: SparkSession, path: str, patch_size: int = 1024) -> DataFrame:
    """Outlines of text files, one file a patch: image_name, line_no, fov, patch_idx, cls, polygon in patch pixels.

    Files whose name has no field are dropped.
    """
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("image_name"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    found = parse_outlines(whole, float(patch_size))
    named = found.withColumns({"fov": I.fov_token(F.col("image_name")), "patch_idx": I.patch_index(F.col("image_name"))})
    return named.where(F.col("fov").isNotNull())


def scaled_by_image(lines: DataFrame, images: DataFrame) -> DataFrame:
    """Outlines scaled by their image's own width and height; images (image_name, width, height)."""
    return parse_outlines(lines.join(images, "image_name"), F.col("width").cast("double"), F.col("height").cast("double"))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """(gene, pos) of a panel CSV: column gene, else target, else the first; repeats once, in order of first place."""
    raw = spark.read.option("header", True).csv(path)
    return panel(raw.withColumn("_at", F.monotonically_increasing_id()))


def panel(raw: DataFrame, at: str = "_at") -> DataFrame:
    name = next((c for c in ("gene", "target") if c in raw.columns), raw.columns[0])
    own = raw.select(F.trim(F.col(f"`{name}`").cast("string")).alias("gene"), F.col(at).alias("pos")).where(F.coalesce("gene", F.lit("")) != "")
    return own.groupBy("gene").agg(F.min("pos").cast("long").alias("pos"))


def read_field_lines(spark: SparkSession, path: str) -> DataFrame:
    """The positional lookup of cell lines: row_idx and one column a slide. One file, read in order."""
    raw = spark.read.option("header", True).csv(path)
    order = Window.orderBy("_id")  # a lookup of one row a field
    return raw.withColumn("_id", F.monotonically_increasing_id()).withColumn("row_idx", (F.row_number().over(order) - 1).cast("int")).drop("_id")


def write_objects(objects: DataFrame, path: str) -> None:
    """All fields in one table by slide, field and kind; reading the parent is the combined table."""
    objects.write.partitionBy("slide", "fov", "kind").parquet(path)


def write_cohorts(nuclei: DataFrame, myotubes: DataFrame, path: str) -> None:
    """The combined nuclei and myotubes, the nuclei off the edges, those in tubes, and the tubes with classified nuclei."""
    from fieldloom.operators.cohort import classified_tubes
    from fieldloom.operators.outlines import drop_edge_objects

    inner = drop_edge_objects(nuclei)
    tables: Mapping[str, DataFrame] = {"nuclei": nuclei, "myotubes": myotubes, "nuclei_non_edge": inner, "myonuclei": inner.where(I.in_tube(F.col("myotube_id"))), "myotubes_classified": classified_tubes(myotubes)}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def write_result(df: DataFrame, path: str, params: Mapping[str, object]) -> None:
    """A result as CSV, cell_line first, with the run's parameters in one row beside it; a header even without rows."""
    first = [c for c in ("cell_line",) if c in df.columns]
    df.select(*first, *(c for c in df.columns if c not in first)).write.option("header", True).csv(f"{path}/result")
    schema = T.StructType([T.StructField(k, T.StringType()) for k in params])
    df.sparkSession.createDataFrame([tuple(str(v) for v in params.values())], schema).coalesce(1).write.option("header", True).csv(f"{path}/params")


def write_measurements(objects: DataFrame, fields: DataFrame, path: str, keys: Sequence[str] = ("slide", "fov")) -> None:
    """Tables of :func:`fieldloom.operators.measure.object_rows` and ``field_rows`` as CSV: a folder a field, and all together."""
    for name, df in (("per_object", objects), ("per_field", fields)):
        beside = df.withColumns({f"_{k}": F.col(k) for k in keys})  # the field's name stays in its rows
        beside.write.partitionBy(*(f"_{k}" for k in keys)).option("header", True).csv(f"{path}/{name}")
        df.write.option("header", True).csv(f"{path}/combined/all_{name}")


def outline_lines(objects: DataFrame, file: str = "image_name") -> DataFrame:
    """(file, line): each outline as its class and coordinates with six decimals."""
    numbers = F.flatten(F.transform("polygon", lambda p: F.array(F.format_string("%.6f", p["x"]), F.format_string("%.6f", p["y"]))))
    return objects.select(file, "object_idx", F.concat_ws(" ", F.col("cls").cast("string"), F.array_join(numbers, " ")).alias("line"))


def write_outlines(objects: DataFrame, path: str, file: str = "image_name") -> None:
    """One folder of text a mask file, its lines in the order of the objects."""
    whole = outline_lines(objects, file).groupBy(file).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("object_idx", "line"))), lambda s: s["line"]), "\n").alias("value"))
    whole.write.partitionBy(file).text(path)
