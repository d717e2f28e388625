"""Relational parts of the differential tests: filters, size factors, means, adjustment, ranking.

A cell line is a key column throughout, never a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.operators.order import placed_within, quantiles
from fieldloom.sessions import cut, owning

EPS = 1e-6
#: Different p-values that share a window.
P_VALUES_A_BIN = 8_192


def log2_ratio(a: Column, b: Column, eps: float = EPS) -> Column:
    return F.log2((a + eps) / (b + eps))


def stabilised_share(part: Column, total: Column, c: float = 0.5) -> Column:
    """A share drawn towards a half by c pseudo-counts on each side."""
    return (part + c) / (total + 2 * c)


def z_scored(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the z-score of a value in its group; 0 where the deviation is 0 or undefined."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    z = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))
    return df.join(stats, by).withColumn(out, z).drop("_mean", "_sd")


def testable_objects(cells: DataFrame, *, min_area: float | None = None, band: tuple[float, float] | None = None) -> DataFrame:
    """Cells with at least the area and with a sigmoid strictly outside the band, whose bounds may come in any order."""
    out = cells
    if min_area is not None:
        out = out.where(F.col("area") >= min_area)
    if band is not None:
        low, high = sorted(band)
        out = out.where((F.col("sigmoid") < low) | (F.col("sigmoid") > high))
    return out


def detected_genes(counts: DataFrame, cells: DataFrame, least: int, group: str | None = "group") -> DataFrame:
    """(cell_line, gene) seen in at least ``least`` cells of either group, or of all cells if there is no group."""
    seen = counts.where(F.col("n") > 0).join(cells.select("cell", "cell_line", *([group] if group else [])), "cell")
    n = [F.count_if(F.col(group) == g) for g in (0, 1)] if group else [F.count("*")]
    return seen.groupBy("cell_line", "gene").agg(F.greatest(*n).alias("_n") if len(n) > 1 else n[0].alias("_n")).where(F.col("_n") >= least).select("cell_line", "gene")


@owning
def size_factors(cells: DataFrame, counts: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """``cells`` (cell, cell_line) with total and size_factor: the total by the median of the line's totals above 0.

    Totals run over ``genes`` (cell_line, gene) if given, else over all. A factor of 0 becomes a thousandth of the
    line's smallest positive one. Lines without any count have none.
    """
    entries = counts.join(cells.select("cell", "cell_line"), "cell")
    entries = entries.join(genes, ["cell_line", "gene"], "left_semi") if genes is not None else entries
    totals = cells.join(entries.groupBy("cell").agg(F.sum("n").alias("total")), "cell", "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))
    totals, _ = cut(totals, "totals")
    seen = totals.where(F.col("total") > 0)
    least = seen.groupBy("cell_line").agg(F.min("total").alias("_least"))
    return totals.join(least, "cell_line").join(quantiles(seen, ["cell_line"], F.col("total"), {"_median": 0.5}), "cell_line").withColumn("size_factor", F.when(F.col("total") > 0, F.col("total") / F.col("_median")).otherwise(F.col("_least") / F.col("_median") * 1e-3)).drop("_median", "_least")


def group_means(counts: DataFrame, factors: DataFrame, genes: DataFrame, eps: float = EPS) -> DataFrame:
    """Per cell line and gene: sums and means by size factors in group 1 and 0, and their log2 ratio."""
    line = factors.groupBy("cell_line").agg(*(F.sum(F.when(F.col("group") == g, F.col("size_factor"))).alias(f"_sf{g}") for g in (0, 1)))
    entries = counts.join(factors.select("cell", "cell_line", "group"), "cell").join(genes, ["cell_line", "gene"], "left_semi")
    sums = entries.groupBy("cell_line", "gene").agg(*(F.sum(F.when(F.col("group") == g, F.col("n")).otherwise(0)).alias(f"sum_{g}") for g in (0, 1)))
    means = sums.join(line, "cell_line").withColumns({f"mean_{g}": F.col(f"sum_{g}") / F.col(f"_sf{g}") for g in (0, 1)})
    return means.withColumn("log2fc", log2_ratio(F.col("mean_1"), F.col("mean_0"), eps)).drop("_sf0", "_sf1")


@owning
def adjusted(df: DataFrame, by: list[str], p: str = "p", out: str = "p_adj", width: int = P_VALUES_A_BIN) -> DataFrame:
    """``df`` with Benjamini-Hochberg adjusted p-values in each group; nulls stay null and don't count.

    Equal p-values are one row with a count until the end: they share the rank of the last of them. Ranks are places in
    the group's order. The running minimum from above is made within bins of ``width`` ranks and carried over a small
    table of the bins, so that no task sorts a whole group, wherever its values crowd and however many are equal.
    """
    known = df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg(F.count("*").alias("_times"))
    ranked, _ = cut(placed_within(known, by, F.col("_p"), name="_before", start=0, before=F.col("_times")), "ranked")
    sizes = ranked.groupBy(*by).agg(F.sum("_times").alias("_n"))
    raw = ranked.join(sizes, by).withColumns({"_q": F.col("_p") * F.col("_n") / (F.col("_before") + F.col("_times")), "_bin": F.floor(F.col("_before") / width)})
    downward = Window.partitionBy(*by).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    above = raw.groupBy(*by, "_bin").agg(F.min("_q").alias("_least")).select(*by, "_bin", F.min("_least").over(downward).alias("_above"))
    inside = F.min("_q").over(Window.partitionBy(*by, "_bin").orderBy(F.desc("_p")))
    values = raw.withColumn("_inside", inside).join(above, [*by, "_bin"]).select(*by, F.col("_p").alias(p), F.least(F.lit(1.0), "_inside", F.coalesce("_above", F.lit(1.0))).alias("_adjusted"))
    kept = [c for c in df.columns if c != out]
    done = df.where(F.col(p).isNotNull()).join(values, [*by, p]).select(*kept, F.col("_adjusted").alias(out))
    return done.unionByName(df.where(F.col(p).isNull()).select(*kept, F.lit(None).cast("double").alias(out)))


def flagged(df: DataFrame, *, alpha: float = 0.05, least: float = 0.25) -> DataFrame:
    """``df`` (log2fc, p_adj) with significant, up and down."""
    sig = F.coalesce((F.col("p_adj") < alpha) & (F.abs("log2fc") >= least), F.lit(False))
    return df.withColumns({"significant": sig, "up": sig & (F.col("log2fc") > 0), "down": sig & (F.col("log2fc") < 0)})


def top_effects(df: DataFrame, n: int, by: str, value: str, absolute: bool = False, tie: str = "gene") -> DataFrame:
    """The n rows of each group with the largest effect, signed or absolute, ties by name; with their rank."""
    size = F.abs(value) if absolute else F.col(value)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(size.desc(), tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def skipped_lines(cells: DataFrame, genes: DataFrame, factors: DataFrame) -> DataFrame:
    """(cell_line, reason) of lines that can't be tested: a class is missing, no gene passes, or there are no counts."""
    both = cells.groupBy("cell_line").agg(F.count_distinct("group").alias("_groups"))
    own = genes.groupBy("cell_line").agg(F.count("*").alias("_genes"))
    total = factors.groupBy("cell_line").agg(F.sum("total").alias("_total"))
    joined = both.join(own, "cell_line", "left").join(total, "cell_line", "left")
    reason = F.when(F.col("_groups") < 2, "a class is missing").when(F.coalesce("_genes", F.lit(0)) == 0, "no gene passes").when(F.coalesce("_total", F.lit(0)) == 0, "no counts")
    return joined.select("cell_line", reason.alias("reason")).where(F.col("reason").isNotNull())


def covariate_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per group mean, sd, exact median, least and most of a value."""
    plain = df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).cast("double").alias("least"), F.max(value).cast("double").alias("most"))
    return plain.join(quantiles(df, [by], F.col(value), {"median": 0.5}), by, "left").select(by, "mean", "sd", "median", "least", "most")


def prediction_surface(coefficients: DataFrame, reference: DataFrame, steps: int = 50) -> DataFrame:
    """mu = exp(b0 + b1 * total + b2 * prop) along ``steps`` (at least 2) even proportions over the line's own range.

    ``coefficients``: cell_line, gene, beta0, beta_total, beta_prop; ``reference``: cell_line, total_ref_sc, prop_least,
    prop_most.
    """
    place = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_k")
    at = coefficients.join(reference, "cell_line").select("*", place)
    at = at.withColumn("prop_abn", F.col("prop_least") + F.col("_k") * (F.col("prop_most") - F.col("prop_least")) / F.lit(float(steps - 1)))
    at = at.withColumn("mu", F.exp(F.col("beta0") + F.col("beta_total") * F.col("total_ref_sc") + F.col("beta_prop") * F.col("prop_abn")))
    return at.drop("_k", "prop_least", "prop_most")
