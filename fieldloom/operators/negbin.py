"""Negative-binomial tests per gene: shared dispersion, log-linear fit, likelihood ratio.

Cells of a line are cut into chunks and its genes into blocks; a unit is the counts of one block of genes in one chunk of
cells with the design of these cells. A round of a fit evaluates every open problem (a gene, a dispersion, the free
coefficients) on every unit of its gene and sums the units' scores, informations and log-likelihoods by problem; the
small systems are solved per problem. So a line may have any number of cells: no task holds more than a unit, the driver
holds none, and each round starts from a written table.

The dispersion follows the published weighted likelihood approach (Robinson and Smyth 2008; McCarthy, Chen and Smyth
2012; Chen, Lun and Smyth 2014): adjusted profile likelihoods on a grid, a common or a trended curve (local means over
genes of like abundance), and each gene's own curve moderated towards it. How much is estimated from the spread of the
genes' residual deviances around a smooth of their abundance (Smyth 2004). Coefficients aren't shrunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fieldloom.operators.order import placed_within
from fieldloom.sessions import cut, discard, owning

#: log2 of the dispersion over that of the grid's middle.
GRID_RANGE = (-10.0, 10.0)
GRID_LENGTH = 21
MIDDLE = 0.1
#: Cells of a chunk, genes of a block: the counts that a task holds at once.
CHUNK_CELLS, BLOCK_GENES = 2_048, 32
#: Problems of a unit that are evaluated together.
TOGETHER = 128
#: Rows of problems that are sent to every task; beyond it they are joined by a shuffle.
BROADCAST_PROBLEMS = 200_000
MAX_ROUNDS = 60
RIDGE = 1e-10
#: Genes ranked side by side for the trend.
TREND_GENES = 512


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series after a shift past 8."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    inv = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + inv / 12 - inv**3 / 360 + inv**5 / 1260 - shift


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of :func:`log_gamma`, for x > 0."""
    y = np.array(x, dtype=np.float64)
    shift = np.zeros_like(y)
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + 1 / y, shift)
        y = np.where(low, y + 1, y)
    q = 1 / (y * y)
    return np.log(y) - 0.5 / y - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q / 240))) - shift


def trigamma(x: np.ndarray) -> np.ndarray:
    """Derivative of :func:`digamma`, for x > 0."""
    y = np.array(x, dtype=np.float64)
    shift = np.zeros_like(y)
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + 1 / (y * y), shift)
        y = np.where(low, y + 1, y)
    q = 1 / (y * y)
    return 1 / y + q / 2 + q / y * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q / 30))) + shift


def trigamma_inverse(v: float) -> float:
    """The x whose trigamma is ``v`` > 0, by halving: trigamma falls, from 1/x² towards 1/x."""
    low, high = 1e-8, max(2.0, 2 / v)
    for _ in range(200):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if float(trigamma(np.array(middle))) > v else (low, middle)
    return math.sqrt(low * high)


def fixed_part(y: np.ndarray, dispersion: np.ndarray) -> np.ndarray:
    """The share of each count's log-likelihood that the mean doesn't change; 0 for a count of 0."""
    r = 1 / dispersion
    return log_gamma(y + r) - log_gamma(r) - log_gamma(y + 1)


def dispersion_grid(length: int = GRID_LENGTH, low: float = GRID_RANGE[0], high: float = GRID_RANGE[1]) -> np.ndarray:
    return MIDDLE * 2.0 ** np.linspace(low, high, length)


def peaks(grid: np.ndarray, curves: np.ndarray) -> np.ndarray:
    """Dispersion at the maximum of each row's curve over the grid, by the parabola around its best point."""
    logs = np.log2(grid)
    k = np.argmax(curves, axis=1)
    inner = np.clip(k, 1, len(grid) - 2)
    rows = np.arange(len(curves))
    a, b, c = (curves[rows, inner + s] for s in (-1, 0, 1))
    bend = a - 2 * b + c
    bent = (k == inner) & (bend < 0)
    moved = np.where(bent, 0.5 * (a - c) / np.where(bent, bend, -1.0), 0.0)
    return 2 ** (logs[k] + moved * (logs[1] - logs[0]))


def design_table(cells: DataFrame, columns: Sequence[str], *, slide: str | None = None) -> tuple[DataFrame, list[str]]:
    """(cell_line, cell, offset, x): an intercept, the columns, and the slide's levels but the first of each line.

    ``cells`` has size_factor; blank or null slides are UNKNOWN. A level that a line doesn't have, or has first, is 0
    for its cells. With one level in all there is no slide column.
    """
    own = cells
    names = ["intercept", *columns]
    terms = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    if slide:
        level = F.coalesce(F.nullif(F.trim(F.col(slide).cast("string")), F.lit("")), F.lit("UNKNOWN"))
        own = own.withColumn("_slide", level)
        first = own.groupBy("cell_line").agg(F.min("_slide").alias("_first"))
        levels = sorted(r[0] for r in own.select("_slide").distinct().collect())
        own = own.join(first, "cell_line")
        for other in levels[1:]:
            names.append(f"slide_{other}")
            terms.append(((F.col("_slide") == other) & (F.col("_first") != other)).cast("double"))
    return own.select("cell_line", "cell", F.log("size_factor").alias("offset"), F.array(*terms).alias("x")), names


def doubles(values: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one length as rows."""
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(values) else np.zeros((0, width))


def as_lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel()))


@dataclass
class Unit:
    """Counts of a block of genes in a chunk of cells, dense, and the cells' design."""

    y: np.ndarray
    x: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, row: int, width: int) -> Unit:
        offset, x, at, column, n = (np.frombuffer(batch.column(c)[row].as_py() or b"", kind) for c, kind in (("offset", "<f8"), ("x", "<f8"), ("at", "<i4"), ("col", "<i4"), ("n", "<f8")))
        y = np.zeros((len(offset), batch.column("genes")[row].as_py()))
        y[at, column] = n
        return Unit(y, x.reshape(-1, width), offset)

    def evaluate(self, column: np.ndarray, beta: np.ndarray, dispersion: np.ndarray) -> np.ndarray:
        """A row a problem: moving part of the log-likelihood, score, upper triangles of the expected and of the observed
        information."""
        p = self.x.shape[1]
        upper = np.triu_indices(p)
        squares = self.x[:, upper[0]] * self.x[:, upper[1]]
        n = len(upper[0])
        out = np.empty((len(column), 1 + p + 2 * n))
        for low in range(0, len(column), TOGETHER):
            own = slice(low, low + TOGETHER)
            y, d = self.y[:, column[own]], dispersion[own]
            eta = np.clip(self.x @ beta[own].T + self.offset[:, None], -30, 30)
            mu = np.exp(eta)
            v = 1 + d * mu
            rest = np.log1p(d * mu)
            out[own, 0] = (y * (eta + np.log(d) - rest)).sum(axis=0) - rest.sum(axis=0) / d
            out[own, 1 : 1 + p] = ((y - mu) / v).T @ self.x
            out[own, 1 + p : 1 + p + n] = (mu / v).T @ squares
            out[own, 1 + p + n :] = ((1 + d * y) * mu / (v * v)).T @ squares
        return out

    def spread(self, column: np.ndarray, beta: np.ndarray, dispersion: np.ndarray) -> np.ndarray:
        """A row a problem: moving part of the log-likelihood where every mean is the count itself, and the upper triangle
        of the design's squares over the cells that tell something: not those with a count of 0 and a mean below 0.0001."""
        upper = np.triu_indices(self.x.shape[1])
        squares = self.x[:, upper[0]] * self.x[:, upper[1]]
        out = np.empty((len(column), 1 + len(upper[0])))
        for low in range(0, len(column), TOGETHER):
            own = slice(low, low + TOGETHER)
            y = self.y[:, column[own]]
            telling = (y > 0) | (np.clip(self.x @ beta[own].T + self.offset[:, None], -30, 30) >= math.log(1e-4))
            out[own, 0] = saturated(y, dispersion[own])
            out[own, 1:] = telling.T.astype(np.float64) @ squares
        return out


def units_of(counts: DataFrame, design: DataFrame, genes: DataFrame, width: int, chunk: int = CHUNK_CELLS, block: int = BLOCK_GENES) -> tuple[DataFrame, DataFrame]:
    """Units (cell_line, block, chunk, genes, offset, x, at, col, n; the last five packed) and (cell_line, gene, g), the
    genes' numbers within their line: gene g is column g % block of block g // block. Lines without cells have no unit."""
    numbered, _ = cut(placed_within(genes.select("cell_line", "gene").distinct(), ["cell_line"], F.col("gene"), name="g", start=0), "genes")
    cells, _ = cut(placed_within(design, ["cell_line"], F.col("cell"), name="c", start=0), "cells")
    place = [(F.col("c") / chunk).cast("int").alias("chunk"), (F.col("c") % chunk).cast("int").alias("at")]
    col = [(F.col("g") / block).cast("int").alias("block"), (F.col("g") % block).cast("int").alias("col")]
    entries = counts.where(F.col("n") > 0).join(cells.select("cell_line", "cell", *place), "cell").join(numbered.select("cell_line", "gene", *col), ["cell_line", "gene"])
    dense = entries.groupBy("cell_line", "chunk", "block").agg(F.collect_list(F.struct("at", "col", F.col("n").cast("double").alias("n"))).alias("entries"))
    chunks = cells.select("cell_line", *place, "offset", "x").groupBy("cell_line", "chunk").agg(F.collect_list(F.struct("at", "offset", "x")).alias("cells"))
    blocks = numbered.select("cell_line", *col).groupBy("cell_line", "block").agg(F.count("*").cast("int").alias("genes"))
    # the fit is dense: every cell of a line counts for every gene of it, in blocks
    pairs = chunks.join(blocks, "cell_line").join(dense, ["cell_line", "chunk", "block"], "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed: list[list[bytes]] = [[], [], [], [], []]
            for k in range(batch.num_rows):
                own = batch.column("cells")[k].values
                order = np.argsort(own.field("at").to_numpy())
                packed[0].append(own.field("offset").to_numpy()[order].astype("<f8").tobytes())
                packed[1].append(doubles(own.field("x"), width)[order].astype("<f8").tobytes())
                held = batch.column("entries")[k].values
                for to, name, kind in ((2, "at", "<i4"), (3, "col", "<i4"), (4, "n", "<f8")):
                    packed[to].append(held.field(name).to_numpy().astype(kind).tobytes() if held is not None else b"")
            yield pa.record_batch([*(batch.column(c) for c in ("cell_line", "block", "chunk", "genes")), *(pa.array(x, pa.binary()) for x in packed)], names=["cell_line", "block", "chunk", "genes", "offset", "x", "at", "col", "n"])

    spark = counts.sparkSession
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # fits cost far more than their bytes tell
    made = pairs.mapInArrow(pack, "cell_line string, block int, chunk int, genes int, offset binary, x binary, at binary, col binary, n binary")
    return cut(made.repartition(tasks, "cell_line", "block", "chunk"), "units")[0], numbered


def summed(units: DataFrame, problems: DataFrame, names: Sequence[str], of: Callable[[Unit, dict[str, np.ndarray]], np.ndarray], width: int, block: int = BLOCK_GENES, many: int | None = None) -> DataFrame:
    """Per problem the sums of ``of`` over all units of its gene, as columns ``names``.

    ``problems``: cell_line, g, k, d (dispersion), beta. They go to the units by line and block, as a broadcast if there
    are few (``many``, counted here if not known).
    """
    many = problems.count() if many is None else many
    slim = problems.select("cell_line", (F.col("g") / block).cast("int").alias("block"), F.struct("g", "k", "d", "beta").alias("q"))
    grouped = slim.groupBy("cell_line", "block").agg(F.collect_list("q").alias("q"))  # as many as a block's problems
    grouped = F.broadcast(grouped) if many <= BROADCAST_PROBLEMS else grouped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q = batch.column("q")[row].values
                asked = {"g": q.field("g").to_numpy(), "d": q.field("d").to_numpy(), "beta": doubles(q.field("beta"), width)}
                found = of(Unit.of(batch, row, width), asked)
                line = pa.array([batch.column("cell_line")[row].as_py()] * len(q), pa.string())
                yield pa.record_batch([line, q.field("g"), q.field("k"), *(pa.array(found[:, c]) for c in range(len(names)))], names=["cell_line", "g", "k", *names])

    schema = "cell_line string, g long, k int, " + ", ".join(f"{c} double" for c in names)
    return units.join(grouped, ["cell_line", "block"]).mapInArrow(run, schema).groupBy("cell_line", "g", "k").agg(*(F.sum(c).alias(c) for c in names))


def solved(information: np.ndarray, score: np.ndarray, free: np.ndarray) -> np.ndarray:
    """A step for each row, 0 for coefficients that aren't free."""
    p = score.shape[1]
    both = free[:, :, None] & free[:, None, :]
    held = np.where(both, information, 0.0) + np.eye(p) * np.where(free, RIDGE, 1.0)[:, None, :]
    return np.linalg.solve(held, np.where(free, score, 0.0)[:, :, None])[:, :, 0]


STATE = "cell_line string, g long, k int, d double, free int, beta array<double>, step array<double>, size double, best double, information array<double>, done boolean"


def fit(units: DataFrame, problems: DataFrame, width: int, block: int = BLOCK_GENES, rounds: int = MAX_ROUNDS) -> DataFrame:
    """Coefficients of every problem by Newton's steps, halved while the log-likelihood falls; it is concave.

    ``problems``: cell_line, g, k (its number within the gene), d, free (bit b: coefficient b is fitted, else kept),
    beta to start from. The result (written) adds best, the moving part of the log-likelihood, and information.
    """
    spark = units.sparkSession
    upper = np.triu_indices(width)
    names = ["ll", *(f"s{b}" for b in range(width)), *(f"i{b}" for b in range(len(upper[0]))), *(f"o{b}" for b in range(len(upper[0])))]
    nothing = F.array_repeat(F.lit(0.0), width)
    begun = problems.select("cell_line", "g", "k", "d", "free", "beta", nothing.alias("step"), F.lit(1.0).alias("size"), F.lit(-math.inf).alias("best"), F.array_repeat(F.lit(0.0), width * width).alias("information"), F.lit(False).alias("done"))

    def written(state: DataFrame) -> tuple[DataFrame, str, int]:
        seen = Observation()
        table, path = cut(state.observe(seen, F.count_if(~F.col("done")).alias("open")), "problems")
        return table, path, seen.get["open"]

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            beta, step, information = (doubles(column[c], w) for c, w in (("beta", width), ("step", width), ("information", width * width)))
            size, best = (column[c].to_numpy() for c in ("size", "best"))
            done = column["done"].to_numpy(zero_copy_only=False)
            free = (column["free"].to_numpy()[:, None] >> np.arange(width)) & 1 == 1
            reached = column["ll"].to_numpy(zero_copy_only=False)
            met = np.isfinite(reached)
            done = done | ~met
            slack = 1e-13 * np.abs(np.where(np.isfinite(best), best, 0.0))
            stands = met & ((reached >= best - 1e-12 - slack) | (size < 1e-4))
            better = stands & (reached > best)
            gain = np.where(better, reached - best, 0.0)
            to = beta + size[:, None] * step
            score = np.column_stack([column[f"s{b}"].to_numpy(zero_copy_only=False) for b in range(width)])
            full, seen = np.zeros((len(to), width, width)), np.zeros((len(to), width, width))
            for b, (i, j) in enumerate(zip(*upper, strict=True)):
                full[:, i, j] = full[:, j, i] = column[f"i{b}"].to_numpy(zero_copy_only=False)
                seen[:, i, j] = seen[:, j, i] = column[f"o{b}"].to_numpy(zero_copy_only=False)
            beta = np.where(better[:, None], to, beta)
            best = np.where(better, reached, best)
            information = np.where(better[:, None], full.reshape(len(to), -1), information)
            near = (np.abs(size[:, None] * step).max(axis=1, initial=0.0) < 1e-4) | (gain < 1e-10 + slack)  # the error left is of the square
            done = done | (stands & ~better) | (better & near & (gain < 1e-8 + 10 * slack))
            go = better & ~done
            if go.any():
                step = step.copy()
                step[go] = solved(seen[go], score[go], free[go])
            size = np.where(go, 1.0, np.where(done, size, size / 2))
            yield pa.record_batch(
                [*(column[c] for c in ("cell_line", "g", "k", "d", "free")), as_lists(beta), as_lists(step), pa.array(size), pa.array(best), as_lists(information), pa.array(done)],
                names=["cell_line", "g", "k", "d", "free", "beta", "step", "size", "best", "information", "done"],
            )

    state, path, many = written(begun)
    rounds_written, finished = [path], []
    while many and len(finished) < rounds:
        open_ones = state.where(~F.col("done"))
        asked = open_ones.withColumn("beta", F.zip_with("beta", F.transform("step", lambda s: s * F.col("size")), lambda b, s: b + s))
        sums = summed(units, asked, names, lambda unit, q: unit.evaluate(q["g"] % block, q["beta"], q["d"]), width, block, many)
        held = F.broadcast(open_ones) if many <= BROADCAST_PROBLEMS else open_ones
        state, path, many = written(sums.join(held, ["cell_line", "g", "k"]).mapInArrow(advance, STATE))
        rounds_written.append(path)
        finished.append(state)
    # a problem that no round ended stands as the last one left it
    parts = [*(t.where("done") for t in finished[:-1]), *finished[-1:]]
    result = parts[0] if parts else state
    for other in parts[1:]:
        result = result.unionByName(other)
    result, _ = cut(result.drop("step", "size", "done"), "fitted")
    for path in rounds_written:
        discard(spark, path)
    return result


@dataclass
class Dispersions:
    """How a test estimates its dispersions: the grid, whether the common curve follows abundance, and the weight of the
    common curve in degrees of freedom (None: estimated)."""

    length: int = GRID_LENGTH
    low: float = GRID_RANGE[0]
    high: float = GRID_RANGE[1]
    trended: bool = True
    prior_df: float | None = None

    @property
    def grid(self) -> np.ndarray:
        return dispersion_grid(self.length, self.low, self.high)


def abundances(units: DataFrame, numbered: DataFrame, grid: np.ndarray, width: int, block: int) -> DataFrame:
    """Per gene: total of its counts, exposure (sum of size factors), cells, and the fixed part at each dispersion."""
    names = ["total", "exposure", "cells", *(f"f{k}" for k in range(len(grid)))]

    def sums(unit: Unit, q: dict[str, np.ndarray]) -> np.ndarray:
        y = unit.y[:, q["g"] % block]
        out = np.zeros((y.shape[1], len(names)))
        out[:, 0], out[:, 1], out[:, 2] = y.sum(axis=0), np.exp(unit.offset).sum(), len(y)
        at, column = np.nonzero(y)
        values, place = np.unique(y[at, column], return_inverse=True)
        for k, d in enumerate(grid):
            out[:, 3 + k] = np.bincount(column, fixed_part(values, np.array(d))[place], minlength=y.shape[1])
        return out

    asked = numbered.select("cell_line", "g", F.lit(0).alias("k"), F.lit(1.0).alias("d"), F.array_repeat(F.lit(0.0), width).alias("beta"))
    found = summed(units, asked, names, sums, width, block).withColumn("fixed", F.array(*(f"f{k}" for k in range(len(grid)))))
    return found.select("cell_line", "g", "total", "exposure", "cells", "fixed", F.log2((F.col("total") + 0.5) / F.col("exposure")).alias("abundance"))


def span_of(n: Column) -> Column:
    """Genes that a local mean takes in: all up to 50 of them, a quarter of very many."""
    return F.ceil(F.when(n <= 50, n).otherwise(n * (0.25 + 0.75 * F.sqrt(F.lit(50.0) / n)))).cast("int")


@owning
def trend_curves(curves: DataFrame, length: int, genes: int = TREND_GENES) -> DataFrame:
    """(cell_line, g, common): for each gene the mean curve of the genes of like abundance, nearest ones weighing most
    (tricube over as many as :func:`span_of` says). ``curves``: cell_line, g, abundance, curve.

    Genes are ranked by abundance and dealt to ranges of the ranks; a range also gets as many genes on both sides as its
    means may reach.
    """
    ranked, _ = cut(placed_within(curves.select("cell_line", "g", "abundance", "curve"), ["cell_line"], F.col("abundance"), F.col("g"), name="_r", start=0), "ranked")
    sizes = ranked.groupBy("cell_line").agg(F.count("*").alias("_n")).withColumn("_span", span_of(F.col("_n")))
    first, last = F.floor((F.col("_r") - F.col("_span")) / genes), F.floor((F.col("_r") + F.col("_span")) / genes)
    most = F.floor((F.col("_n") - 1) / genes)
    spread = ranked.join(F.broadcast(sizes), "cell_line").withColumn("_range", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, most).cast("int"))))

    def smooth(group: pa.Table) -> pa.Table:
        group = group.sort_by("_r").combine_chunks()
        at, abundance = group["_r"].to_numpy(), group["abundance"].to_numpy()
        curve = doubles(group["curve"].combine_chunks(), length)
        span = group["_span"][0].as_py()
        own = np.flatnonzero(at // genes == group["_range"][0].as_py())
        out = np.empty((len(own), length))
        for to, k in enumerate(own):
            near = slice(max(0, k - span), k + span + 1)
            distance = np.abs(abundance[near] - abundance[k])
            reach = np.partition(distance, min(span, len(distance)) - 1)[min(span, len(distance)) - 1]
            weight = np.clip(1 - (distance / (reach * (1 + 1e-9))) ** 3, 0, None) ** 3 if reach > 0 else (distance == 0).astype(np.float64)
            out[to] = weight @ curve[near] / weight.sum()
        return pa.table([group["cell_line"].take(pa.array(own)), group["g"].take(pa.array(own)), as_lists(out)], names=["cell_line", "g", "common"])

    return spread.select("cell_line", "g", "abundance", "curve", "_r", "_span", "_range").groupBy("cell_line", "_range").applyInArrow(smooth, "cell_line string, g long, common array<double>")


@owning
def prior_weights(genes: DataFrame) -> DataFrame:
    """(cell_line, prior_df): degrees of freedom of the common curve, infinite where the genes don't differ more than by
    chance. ``genes``: cell_line, abundance, deviance, df (residual).

    The logarithm of a mean deviance, less what its degrees of freedom make it expect, is fitted by a cubic of abundance;
    the variance left over, less what the degrees of freedom make it, is a trigamma of half the prior's.
    """
    known = genes.where((F.col("df") > 0) & F.col("deviance").isNotNull()).withColumn("s2", F.col("deviance") / F.col("df"))
    lines = known.groupBy("cell_line").agg(F.avg("s2").alias("_mean"), F.min("abundance").alias("_low"), F.max("abundance").alias("_high"))

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column("df").to_numpy() / 2
            e = np.log(batch.column("s2").to_numpy()) - digamma(half) + np.log(half)
            yield pa.record_batch([batch.column("cell_line"), batch.column("a"), pa.array(e), pa.array(trigamma(half))], names=["cell_line", "a", "e", "v"])

    scaled = F.when(F.col("_high") > F.col("_low"), 2 * (F.col("abundance") - F.col("_low")) / (F.col("_high") - F.col("_low")) - 1).otherwise(F.lit(0.0))
    ready = known.join(F.broadcast(lines), "cell_line").select("cell_line", scaled.alias("a"), F.greatest("s2", 1e-5 * F.col("_mean"), F.lit(1e-300)).alias("s2"), F.col("df").cast("double").alias("df"))
    spread, _ = cut(ready.mapInArrow(expected, "cell_line string, a double, e double, v double"), "spread")
    powers = spread.groupBy("cell_line").agg(F.count("*").alias("n"), *(F.sum(F.pow("a", F.lit(k))).alias(f"a{k}") for k in range(7)), *(F.sum(F.col("e") * F.pow("a", F.lit(k))).alias(f"e{k}") for k in range(4)))

    def coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                terms = min(4, max(1, r["n"] // 5))
                left = np.array([[r[f"a{i + j}"] for j in range(terms)] for i in range(terms)])
                found, _, rank, _ = np.linalg.lstsq(left, np.array([r[f"e{i}"] for i in range(terms)]), rcond=1e-10)
                rows.append((r["cell_line"], [*found.tolist(), *[0.0] * (4 - terms)], int(rank)))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.int64())], names=["cell_line", "c", "rank"])

    curve = powers.mapInArrow(coefficients, "cell_line string, c array<double>, rank long")
    a = F.col("a")
    fitted = F.col("c")[0] + a * (F.col("c")[1] + a * (F.col("c")[2] + a * F.col("c")[3]))
    off = spread.join(F.broadcast(curve), "cell_line").withColumn("off", (F.col("e") - fitted) * (F.col("e") - fitted))
    left_over = off.groupBy("cell_line").agg((F.sum("off") / F.greatest(F.count("*") - F.first("rank"), F.lit(1)) - F.avg("v")).alias("extra"), (F.count("*") > F.first("rank")).alias("enough"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [2 * trigamma_inverse(v) if ok and v is not None and v > 1e-9 else math.inf for v, ok in zip(batch.column("extra").to_pylist(), batch.column("enough").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("cell_line"), pa.array(out, pa.float64())], names=["cell_line", "prior_df"])

    return left_over.mapInArrow(weigh, "cell_line string, prior_df double")


@owning
def fit_genes(counts: DataFrame, design: DataFrame, genes: DataFrame, names: Sequence[str], *, tested: Sequence[str], dispersions: Dispersions | None = None, chunk: int = CHUNK_CELLS, block: int = BLOCK_GENES) -> DataFrame:
    """Per cell line and gene: dispersion, common_dispersion (at the line's or the trend's curve), prior_df, beta_<name>
    for each column, and p_<name> for each tested one.

    ``counts`` (cell, gene, n) non-zero entries, ``design`` from :func:`design_table`, ``genes`` (cell_line, gene).
    """
    how = dispersions or Dispersions()
    grid, width = how.grid, len(names)
    every = (1 << width) - 1
    units, numbered = units_of(counts, design, genes, width, chunk, block)
    sums, _ = cut(abundances(units, numbered, grid, width, block), "abundances")
    start = F.concat(F.array(F.log((F.col("total") + 0.5) / F.col("exposure"))), F.array_repeat(F.lit(0.0), width - 1))
    at = F.posexplode(F.array(*(F.lit(float(d)) for d in grid))).alias("k", "d")
    profile = fit(units, sums.select("cell_line", "g", start.alias("beta"), F.lit(every).alias("free"), at), width, block)

    def adjusted_likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            information = doubles(batch.column("information"), width * width).reshape(-1, width, width) + RIDGE * np.eye(width)
            value = batch.column("best").to_numpy() - 0.5 * np.linalg.slogdet(information)[1]  # Cox and Reid
            yield pa.record_batch([*(batch.column(c) for c in ("cell_line", "g", "k")), pa.array(value)], names=["cell_line", "g", "k", "v"])

    values = profile.select("cell_line", "g", "k", "best", "information").mapInArrow(adjusted_likelihoods, "cell_line string, g long, k int, v double")
    ordered = values.groupBy("cell_line", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("moving"))
    curves, _ = cut(sums.join(ordered, ["cell_line", "g"]).withColumn("curve", F.zip_with("moving", "fixed", lambda a, b: a + b)), "curves")
    if how.trended:
        common = trend_curves(curves, how.length)
    else:
        each = curves.select("cell_line", F.posexplode("curve").alias("k", "v")).groupBy("cell_line", "k").agg(F.avg("v").alias("v"))
        mean = each.groupBy("cell_line").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("common"))
        common = curves.select("cell_line", "g").join(F.broadcast(mean), "cell_line")

    def at_peak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(peaks(grid, doubles(batch.column("common"), len(grid))))], names=["cell_line", "g", "common", "d"])

    shared, _ = cut(common.select("cell_line", "g", "common").mapInArrow(at_peak, "cell_line string, g long, common array<double>, d double"), "common")
    # from each gene's coefficients at the grid's dispersion nearest to the common one
    near = F.least(F.greatest(F.round((F.log2(F.col("d") / MIDDLE) - how.low) / ((how.high - how.low) / (how.length - 1))), F.lit(0)), F.lit(how.length - 1)).cast("int")
    warm = shared.select("cell_line", "g", "d", near.alias("k")).join(profile.select("cell_line", "g", "k", "beta"), ["cell_line", "g", "k"])
    if how.prior_df is None:
        at_common = fit(units, warm.select("cell_line", "g", F.lit(0).alias("k"), "d", F.lit(every).alias("free"), "beta"), width, block)
        triangle = [f"x{b}" for b in range(width * (width + 1) // 2)]
        full = summed(units, at_common.select("cell_line", "g", "k", "d", "beta"), ["best_possible", *triangle], lambda unit, q: unit.spread(q["g"] % block, q["beta"], q["d"]), width, block)
        full = residual_freedom(full, triangle, width)
        joined = at_common.join(full, ["cell_line", "g", "k"]).join(sums.select("cell_line", "g", "abundance"), ["cell_line", "g"])
        known = joined.select("cell_line", "g", "abundance", F.greatest(2 * (F.col("best_possible") - F.col("best")), F.lit(0.0)).alias("deviance"), "df")
        known, _ = cut(known, "deviances")
        weights = prior_weights(known)
    else:
        known = sums.select("cell_line", "g", F.greatest(F.col("cells") - width, F.lit(0.0)).alias("df"))
        weights = sums.select("cell_line").distinct().withColumn("prior_df", F.lit(float(how.prior_df)))
    ready = curves.select("cell_line", "g", "curve").join(shared, ["cell_line", "g"]).join(known.select("cell_line", "g", "df"), ["cell_line", "g"]).join(F.broadcast(weights), "cell_line", "left")
    ready = ready.select("cell_line", "g", "curve", "common", "d", "df", F.coalesce("prior_df", F.lit(math.inf)).alias("prior_df"))

    def moderate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, common = (doubles(batch.column(c), len(grid)) for c in ("curve", "common"))
            prior, trend = batch.column("prior_df").to_numpy(), batch.column("d").to_numpy()
            finite = np.isfinite(prior)
            weight = np.where(finite, prior, 0.0) / np.maximum(batch.column("df").to_numpy(), 1.0)
            found = np.where(finite, peaks(grid, own + weight[:, None] * common), trend)
            yield pa.record_batch([batch.column("cell_line"), batch.column("g"), pa.array(found), pa.array(trend), batch.column("prior_df")], names=["cell_line", "g", "dispersion", "common_dispersion", "prior_df"])

    tagwise, _ = cut(ready.mapInArrow(moderate, "cell_line string, g long, dispersion double, common_dispersion double, prior_df double"), "dispersions")
    places = [list(names).index(c) for c in tested]
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(every & ~(1 << b) if b is not None else every).alias("free"), F.lit(-1 if b is None else b).alias("b")) for k, b in enumerate([None, *places])))).alias("q")
    begun = tagwise.select("cell_line", "g", F.col("dispersion").alias("d")).join(warm.select("cell_line", "g", "beta"), ["cell_line", "g"]).select("cell_line", "g", "d", "beta", kinds)
    begun = begun.select("cell_line", "g", F.col("q.k").alias("k"), "d", F.col("q.free").alias("free"), F.transform("beta", lambda v, i: F.when(i == F.col("q.b"), 0.0).otherwise(v)).alias("beta"))
    done = fit(units, begun, width, block)
    best = F.map_from_entries(F.collect_list(F.struct("k", "best"))).alias("best")
    each = done.groupBy("cell_line", "g").agg(best, F.max(F.when(F.col("k") == 0, F.col("beta"))).alias("beta"))
    result = numbered.join(each, ["cell_line", "g"]).join(tagwise, ["cell_line", "g"])
    gains = result.select("cell_line", "gene", "dispersion", "common_dispersion", "prior_df", *(F.col("beta")[b].alias(f"beta_{c}") for b, c in enumerate(names)), *(F.greatest(F.col("best")[0] - F.col("best")[k], F.lit(0.0)).alias(f"p_{c}") for k, c in enumerate(tested, start=1)))
    at_p = [gains.columns.index(f"p_{c}") for c in tested]

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            for k in at_p:
                columns[k] = pa.array([math.erfc(math.sqrt(v)) for v in columns[k].to_pylist()], pa.float64())  # chi-squared, one degree: LR / 2
            yield pa.record_batch(columns, names=batch.schema.names)

    return gains.mapInArrow(chances, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in gains.schema.fields))


def residual_freedom(full: DataFrame, triangle: Sequence[str], width: int) -> DataFrame:
    """(cell_line, g, k, best_possible, df): the cells that tell something, less the rank of the design over them.

    A level of which a gene has no count fits its cells at 0: they and its column tell nothing. ``triangle``: the
    design's squares summed over the other cells, the first being that of the intercept, their number.
    """
    upper = np.triu_indices(width)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squares = np.zeros((batch.num_rows, width, width))
            for name, i, j in zip(triangle, *upper, strict=True):
                squares[:, i, j] = squares[:, j, i] = batch.column(name).to_numpy()
            scale = np.sqrt(np.maximum(np.einsum("kii->ki", squares), 1e-300))
            rank = np.linalg.matrix_rank(squares / (scale[:, :, None] * scale[:, None, :]), tol=1e-9, hermitian=True)
            df = np.maximum(squares[:, 0, 0] - rank, 0.0)
            yield pa.record_batch([*(batch.column(c) for c in ("cell_line", "g", "k", "best_possible")), pa.array(df)], names=["cell_line", "g", "k", "best_possible", "df"])

    return full.mapInArrow(ranked, "cell_line string, g long, k int, best_possible double, df double")


def saturated(y: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Moving part of each column's log-likelihood where every mean is the count itself."""
    out = np.zeros(y.shape[1])
    at, column = np.nonzero(y)
    value, own = y[at, column], d[column]
    np.add.at(out, column, value * np.log(own * value) - (value + 1 / own) * np.log1p(own * value))
    return out
