"""Cohorts: quality control, class labels, per-line and per-slide tables. Counts are long, non-zero entries only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import identifiers as I
from fieldloom.operators.order import placed, placed_within, quantiles

CONTROL_GENES = r"(?i)SystemControl|Negative"


def cell_qc(cells: DataFrame, counts: DataFrame, key: str = "cell") -> DataFrame:
    """``cells`` with total counts and number of genes seen, 0 for cells without any."""
    sums = counts.groupBy(key).agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("n_genes"))
    return cells.join(sums, key, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total", "n_genes")})


def gene_cells(counts: DataFrame) -> DataFrame:
    """In how many cells each gene is seen."""
    return counts.groupBy("gene").agg(F.count_if(F.col("n") > 0).alias("n_cells"))


def qc_cascade(counts: DataFrame, *, min_total: int = 100, min_cells: int = 100, controls: str = CONTROL_GENES, key: str = "cell") -> DataFrame:
    """Counts of the cells with enough counts, then of the genes in enough of these cells, then without control genes.

    Control genes still count in the cells' totals.
    """
    good = counts.groupBy(key).agg(F.sum("n").alias("_total")).where(F.col("_total") >= min_total).select(key)
    rest = counts.join(good, key, "left_semi")
    genes = rest.where(F.col("n") > 0).groupBy("gene").agg(F.count("*").alias("_cells")).where((F.col("_cells") >= min_cells) & ~F.col("gene").rlike(controls)).select("gene")
    return rest.join(genes, "gene", "left_semi")


def classifier_table(raw: DataFrame, slide: str) -> DataFrame:
    """The canonical classifier table from image_name, predicted_class, sigmoid_logits; an error names names that don't parse."""
    I.require_columns(raw, ["image_name", "predicted_class"], "classifier table")
    logits = F.col("sigmoid_logits").cast("double") if "sigmoid_logits" in raw.columns else F.lit(None).cast("double")
    stem = I.image_stem(F.col("image_name"))
    parts = I.crop_fields(stem)
    bad = raw.where(parts["field"].isNull()).select("image_name")
    n = bad.count()
    if n:
        raise ValueError(f"{n} image names don't parse, such as {[r[0] for r in bad.limit(5).collect()]}")
    return raw.select(F.lit(slide.lower()).alias("slide"), *(c.alias(k) for k, c in parts.items()), parts["cell_line"].alias("labels"), stem.alias("image_name"), F.col("predicted_class"), logits.alias("sigmoid_logits"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key, with all columns, by rising ``order`` (nulls first). Parts of a key are reduced before they
    meet."""
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(*order))
    return df.groupBy(*(F.col(k).alias(f"_key_{k}") for k in keys)).agg(first.alias("_first")).select("_first.*")


def merge_classes(cells: DataFrame, classifier: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``cells`` with the class columns of the first classifier row of their key; slides are compared in upper case."""
    right = first_per_key(classifier.withColumn("slide", I.slide_key(F.col("slide"))) if "slide" in keys else classifier, keys, order)
    left = cells.withColumn("_slide", F.col("slide")).withColumn("slide", I.slide_key(F.col("slide"))) if "slide" in keys else cells
    joined = left.join(right.drop(*[c for c in right.columns if c in cells.columns and c not in keys]), list(keys), "left")
    return joined.withColumn("slide", F.col("_slide")).drop("_slide") if "slide" in keys else joined


def class_distribution(cells: DataFrame, label: str = "predicted_class") -> DataFrame:
    """Cells of each class by cell line, and their share of the line in percent."""
    n = cells.groupBy("cell_line", label).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("cell_line")))


def slide_statistics(cells: DataFrame, classes: Sequence[str], label: str = "predicted_class") -> DataFrame:
    """Mean counts and genes per slide, over all cells and over those of each class (columns named by the class)."""
    own = [F.avg(F.when(F.col(label) == c, F.col(v))).alias(f"mean_{v}_{I.column_fragment(c)}") for c in classes for v in ("total", "n_genes")]
    return cells.groupBy("slide").agg(F.count("*").alias("n_cells"), F.avg("total").alias("mean_total"), F.avg("n_genes").alias("mean_n_genes"), *own)


def tube_class_counts(nuclei: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Normal and abnormal nuclei of each tube; ``nuclei`` has ``keys`` and class_group. A class nobody has counts 0."""
    return nuclei.groupBy(*keys).agg(F.count_if(F.col("class_group") == "Normal").alias("n_normal_nuclei"), F.count_if(F.col("class_group") == "Abnormal").alias("n_abnormal_nuclei"))


def with_class_counts(tubes: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tubes with their class counts, compared as text; 0 where there are none."""
    named = counts.select(*(I.as_key(F.col(k)).alias(f"_k_{k}") for k in keys), "n_normal_nuclei", "n_abnormal_nuclei")
    joined = tubes.withColumns({f"_k_{k}": I.as_key(F.col(k)) for k in keys}).join(named, [f"_k_{k}" for k in keys], "left")
    return joined.select(*tubes.columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_normal_nuclei", "n_abnormal_nuclei")))


def morphology_class(tubes: DataFrame) -> DataFrame:
    """Tubes with pct_abnormal (null without nuclei) and morphology_class: -1 none, 1 all normal, 2 all abnormal, 3 both."""
    normal, abnormal = F.col("n_normal_nuclei"), F.col("n_abnormal_nuclei")
    total = normal + abnormal
    kind = F.when(total == 0, -1).when(abnormal == 0, 1).when(normal == 0, 2).otherwise(3)
    return tubes.withColumns({"pct_abnormal": F.when(total > 0, 100 * abnormal / total), "morphology_class": kind.cast("int")})


def classified_tubes(tubes: DataFrame) -> DataFrame:
    return tubes.where(F.col("n_normal_nuclei") + F.col("n_abnormal_nuclei") > 0)


def field_cell_lines(table: DataFrame, slide: str | None = None, fov_base: int = 0) -> DataFrame:
    """(fov_no, cell_line) from a positional table (row_idx, one column a slide): row i is field i + ``fov_base``.

    The named slide's column, or the first that isn't blank; blank is ''.
    """
    columns = [slide] if slide else [c for c in table.columns if c != "row_idx"]
    filled = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns]
    return table.select((F.col("row_idx") + fov_base).cast("int").alias("fov_no"), F.coalesce(*filled, F.lit("")).alias("cell_line"))


def with_cell_line(objects: DataFrame, lines: DataFrame) -> DataFrame:
    """Objects with their field's cell line, '' if it has none."""
    return objects.join(lines, "fov_no", "left").withColumn("cell_line", F.coalesce("cell_line", F.lit("")))


def match_coverage(cells: DataFrame, column: str = "predicted_class") -> DataFrame:
    return cells.agg(F.count("*").alias("n"), F.count_if(F.col(column).isNotNull()).alias("assigned"), F.count_if(F.col(column).isNull()).alias("missing"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, null included."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def five_numbers(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, and the exact five-number summary."""
    plain = df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.min(column).cast("double").alias("least"), F.max(column).cast("double").alias("most"))
    q = quantiles(df, by, F.col(column), {"q25": 0.25, "median": 0.5, "q75": 0.75})
    joined = plain.join(q, list(by), "left") if by else plain.join(F.broadcast(q), F.lit(True), "left")  # a row on both sides
    return joined.select(*by, "n", "mean", "sd", "least", "q25", "median", "q75", "most")


def unique_names(df: DataFrame, name: str, order: Sequence[str], separator: str = ".") -> DataFrame:
    """``df`` with repeated names told apart by a number: a, a.1, a.2."""
    at = F.col("_repeat")
    own = placed_within(df, [name], *(F.col(c) for c in order), name="_repeat", start=0)
    return own.withColumn(name, F.when(at > 0, F.concat_ws(separator, name, at.cast("string"))).otherwise(F.col(name))).drop("_repeat")


def tagged_union(tables: dict[str, DataFrame], prefix: str | None = None) -> DataFrame:
    """Tables of several slides as one, with the slide; missing columns are null. ``prefix`` names an id to tell apart."""
    out: DataFrame | None = None
    for slide, df in tables.items():
        own = df.withColumn("slide", F.lit(slide))
        own = own.withColumn(prefix, F.concat_ws("_", F.lit(slide), F.col(prefix).cast("string"))) if prefix else own
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def on_gene_union(counts: DataFrame) -> DataFrame:
    """Counts with gene_idx in the union of all their genes, by name."""
    return counts.join(placed(counts.select("gene").distinct(), F.col("gene"), name="gene_idx", start=0), "gene")


def common_dimensions(tables: Sequence[DataFrame], column: str) -> bool:
    """Whether every table has the array column, of one and the same width."""
    if not all(column in t.columns for t in tables):
        return False
    widths = {r[0] for t in tables for r in t.select(F.size(column)).distinct().limit(2).collect()}
    return len(widths) <= 1


def wide(df: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide over the given names, 0 where there is no value."""
    return df.groupBy(key).pivot(name, list(names)).agg(F.sum(value)).na.fill(0)


def complete_fields(objects: DataFrame, keys: Sequence[str], patches: int, kinds: Sequence[str] = ("nuclei", "myotubes")) -> DataFrame:
    """Objects of the fields that have enough patches of every kind."""
    enough = [F.count_distinct(F.when(F.col("kind") == k, F.col("patch_idx"))) >= patches for k in kinds]
    per = objects.groupBy(*keys).agg(*(e.alias(f"_ok{i}") for i, e in enumerate(enough)))
    ok = per.where(" and ".join(f"_ok{i}" for i in range(len(enough)))).select(*keys)
    return objects.join(ok, list(keys), "left_semi")
