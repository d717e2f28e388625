"""Whole tests: differential expression of two groups, and regression on nuclei and their abnormal share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import effects as E
from fieldloom.operators.negbin import Dispersions, design_table, fit_genes
from fieldloom.sessions import cut, owning


#: Nuclei: one common curve for a line, on a short grid. Tubes and trends: the defaults, a curve that follows abundance.
NUCLEI = Dispersions(length=11, low=-6.0, high=6.0, trended=False)
TUBES = Dispersions()


@owning
def two_groups(cells: DataFrame, counts: DataFrame, *, min_cells: int = 100, dispersions: Dispersions = NUCLEI) -> tuple[DataFrame, DataFrame]:
    """Group 1 against 0 by cell line: the result and the skipped lines with their reasons.

    ``cells`` (cell, cell_line, group), ``counts`` (cell, gene, n). Genes seen in enough cells of either group are kept,
    size factors run over these, cells without counts keep a small factor.
    """
    cells = cells.where(F.col("group").isin(0, 1) & F.col("cell_line").isNotNull())
    genes, _ = cut(E.detected_genes(counts, cells, min_cells), "detected")
    factors, _ = cut(E.size_factors(cells, counts, genes), "factors")
    skipped = E.skipped_lines(cells, genes, factors)
    tested = factors.join(skipped, "cell_line", "left_anti")
    design, names = design_table(tested, ["group"])
    fitted = fit_genes(counts, design, genes.join(skipped, "cell_line", "left_anti"), names, tested=["group"], dispersions=dispersions)
    fitted, _ = cut(fitted, "fits")  # read several times below
    means = E.group_means(counts, tested, genes)
    done = E.adjusted(fitted.join(means, ["cell_line", "gene"]).withColumnRenamed("p_group", "p"), ["cell_line"])
    flagged = E.flagged(done)
    return flagged.select("cell_line", F.col("gene").alias("names"), F.col("beta_intercept").alias("beta0"), F.col("beta_group").alias("beta1"), "log2fc", "mean_1", "mean_0", F.col("p").alias("pvals"), F.col("p_adj").alias("pvals_adj"), "significant", "up", "down"), skipped


@owning
def trend(tubes: DataFrame, counts: DataFrame, *, min_tubes: int = 50, min_area: float | None = None, slide: str | None = "slide", dispersions: Dispersions = TUBES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per cell line and gene: effects of the number of nuclei (per deviation) and of their abnormal share.

    ``tubes`` (cell, cell_line, n_normal_nuclei, n_abnormal_nuclei, morphology_class, slide; area if ``min_area`` is
    given); only tubes of class 1 or 2 with a nucleus count. Size factors run over all genes. ``fc_`` are fold changes
    per unit, for the share also per 0.1. Returns the result, the skipped lines with their reasons, and the tubes tested
    with their covariates (total_nuc, total_nuc_sc, prop_abn).
    """
    lined = tubes.where(F.col("cell_line").isNotNull()).withColumn("total_nuc", F.col("n_normal_nuclei") + F.col("n_abnormal_nuclei"))
    large = F.coalesce(F.col("area") >= min_area, F.lit(False)) if min_area is not None else F.lit(True)
    classed = large & F.coalesce(F.col("morphology_class").isin(1, 2), F.lit(False))
    counted = classed & F.coalesce(F.col("total_nuc") >= 1, F.lit(False))
    own = lined.where(counted).withColumn("prop_abn", E.stabilised_share(F.col("n_abnormal_nuclei"), F.col("total_nuc")))
    own = E.z_scored(own, ["cell_line"], "total_nuc", "total_nuc_sc")
    factors, _ = cut(E.size_factors(own, counts).where(F.col("size_factor") > 0), "factors")
    genes, _ = cut(E.detected_genes(counts, factors, min_tubes, None), "detected")
    seen = lined.groupBy("cell_line").agg(*(F.count_if(c).alias(n) for c, n in ((large, "_large"), (classed, "_classed"), (counted, "_counted"))))
    seen = seen.join(factors.groupBy("cell_line").agg(F.sum("total").alias("_total")), "cell_line", "left").join(genes.groupBy("cell_line").agg(F.count("*").alias("_genes")), "cell_line", "left")
    reason = F.lit(None).cast("string")
    for column, why in (("_genes", "no gene passes"), ("_total", "no counts"), ("_counted", "no tube with nuclei"), ("_classed", "no tube of class 1 or 2"), ("_large", "no tube is large enough")):
        reason = F.when(F.coalesce(column, F.lit(0)) == 0, why).otherwise(reason)  # the last one checks first
    skipped = seen.select("cell_line", reason.alias("reason")).where(F.col("reason").isNotNull())
    tested = factors.join(skipped, "cell_line", "left_anti")
    design, names = design_table(tested, ["total_nuc_sc", "prop_abn"], slide=slide)
    fitted = fit_genes(counts, design, genes, names, tested=["total_nuc_sc", "prop_abn"], dispersions=dispersions)
    fitted, _ = cut(fitted, "fits")  # read several times below
    for c in ("total_nuc_sc", "prop_abn"):
        fitted = E.adjusted(fitted, ["cell_line"], f"p_{c}", f"fdr_{c}")
    result = fitted.withColumns({"fc_total_nuc_sc": F.exp("beta_total_nuc_sc"), "fc_prop_abn": F.exp("beta_prop_abn"), "fc_prop_abn_0.1": F.exp(0.1 * F.col("beta_prop_abn"))})
    return result, skipped, tested


def trend_predictions(result: DataFrame, tested: DataFrame, *, top: int = 50, steps: int = 50, reference: str = "median") -> DataFrame:
    """Predicted means of each line's ``top`` genes by the size of beta_prop_abn, along the line's range of abnormal shares.

    ``result`` and ``tested`` come from :func:`trend`. The number of nuclei is held at the line's median or mean.
    """
    if reference not in ("median", "mean"):
        raise ValueError("reference must be median or mean")
    at = F.percentile("total_nuc", F.lit(0.5)) if reference == "median" else F.avg("total_nuc")
    lines = tested.groupBy("cell_line").agg(at.alias("_at"), F.avg("total_nuc").alias("_mean"), F.stddev_samp("total_nuc").alias("_sd"), F.min("prop_abn").alias("prop_least"), F.max("prop_abn").alias("prop_most"))
    scaled = F.when(F.col("_sd") > 0, (F.col("_at") - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))
    lines = lines.select("cell_line", scaled.alias("total_ref_sc"), "prop_least", "prop_most")
    best = E.top_effects(result, top, "cell_line", "beta_prop_abn", absolute=True)
    return E.prediction_surface(best.select("cell_line", "gene", "rank", F.col("beta_intercept").alias("beta0"), F.col("beta_total_nuc_sc").alias("beta_total"), F.col("beta_prop_abn").alias("beta_prop")), lines, steps)
