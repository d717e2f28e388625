"""Whitening of embeddings: exact integer sums, a centred covariance, its leading eigenvectors by QDWH spectral
divide-and-conquer, and one projection of every row.

The polar factor of a shifted symmetric matrix holds its signs: (U + I) / 2 projects on the eigenvectors above the shift.
The matrix is split into both invariant subspaces, and these again, until one is a single vector (Nakatsukasa and Higham
2013). It has as many rows as a vector has entries, whatever the number of vectors, and is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sessions import cut

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this in size count as it: a long has no room for more.
LARGEST = 1 << 61
#: Rows that are worked on together.
BLOCK = 2_048
#: An eigenvalue up to this many times the rounding of the trace is none: the vectors don't vary there.
ROUNDING = 64
_EPS = float(np.finfo(np.float64).eps)


def halley_weights(low: float) -> tuple[float, float, float]:
    """a, b and c of a step for singular values from ``low`` to 1."""
    d = np.cbrt(4 * (1 - low * low) / low**4)
    root = np.sqrt(1 + d)
    a = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * root))
    b = (a - 1) ** 2 / 4
    return a, b, a + b - 1


def polar_factor(matrix: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix that is not singular: its sign, by QR-based dynamically weighted Halley steps while the
    matrix is ill-conditioned, by Cholesky factors after."""
    n = len(matrix)
    x = matrix / np.linalg.norm(matrix)
    low = min(1.0, 1 / (np.sqrt(n) * np.linalg.norm(np.linalg.inv(x), 1)))
    eye = np.eye(n)
    for _ in range(40):
        a, b, c = halley_weights(max(low, _EPS))
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
            to = b / c * x + (a - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        else:
            w = np.linalg.cholesky(eye + c * x.T @ x)
            to = b / c * x + (a - b / c) * np.linalg.solve(w.T, np.linalg.solve(w, x.T)).T
        to = (to + to.T) / 2
        low = min(1.0, low * (a + b * low * low) / (1 + c * low * low))
        moved, x = np.linalg.norm(to - x), to
        if moved < np.cbrt(_EPS) and 1 - low < 10 * _EPS:
            break
    return x


def subspaces(matrix: np.ndarray, shift: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span what lies above ``shift``; None if nothing is above, nothing is
    below, or the shift is an eigenvalue."""
    n = len(matrix)
    shifted = matrix - shift * np.eye(n)
    try:
        projector = (polar_factor(shifted) + np.eye(n)) / 2
    except np.linalg.LinAlgError:
        return None
    if not np.isfinite(projector).all():
        return None
    k = round(float(np.trace(projector)))
    if not 0 < k < n:
        return None
    at = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")  # the projector's longest columns come first
    basis = np.linalg.qr(projector[:, at[:k]], mode="complete")[0]
    for _ in range(3):  # subspace iteration
        basis = np.linalg.qr(projector @ basis[:, :k], mode="complete")[0]
        if np.linalg.norm(basis[:, k:].T @ matrix @ basis[:, :k]) <= 10 * n * _EPS * np.linalg.norm(matrix):
            return basis, k
    return None


def leading(matrix: np.ndarray, want: int, size: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues of a symmetric matrix, falling, and their vectors as columns.

    ``size``: what rounding is measured by, the norm of the matrix that this one is a part of.
    """
    n = len(matrix)
    size = np.linalg.norm(matrix) if size is None else size
    mean = float(np.trace(matrix)) / n if n else 0.0
    if n <= 1 or np.linalg.norm(matrix - mean * np.eye(n)) <= n * _EPS * size:
        return np.diag(matrix)[:want].copy(), np.eye(n)[:, :want]
    spread = np.linalg.norm(matrix - mean * np.eye(n)) / np.sqrt(n)
    split = None
    # the mean lies between the least and the largest eigenvalue, and near it so does what isn't an eigenvalue
    for shift in (float(np.median(np.diag(matrix))), mean, *(mean + spread * s for s in (0.05, -0.05, 0.2, -0.2, 0.01, -0.01, 0.002, -0.002, 0.5, -0.5))):
        split = subspaces(matrix, shift)
        if split is not None:
            break
    if split is None:
        raise np.linalg.LinAlgError("no shift splits the matrix")
    basis, k = split
    parts = [(basis[:, :k], min(want, k)), (basis[:, k:], max(0, want - k))]
    values, vectors = [], []
    for own, more in parts:
        if more:
            part = own.T @ matrix @ own
            e, v = leading((part + part.T) / 2, more, size)
            values.append(e)
            vectors.append(own @ v)
    values, vectors = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def dense(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and these as rows of doubles, short ones padded with zeros."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False)
    parent = pc.list_parent_indices(column).to_numpy().astype(np.int64)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    rows = np.zeros((len(column), dim))
    rows[parent, np.arange(len(flat)) - starts[parent]] = flat
    keep = np.flatnonzero((lengths >= 0) & np.isfinite(rows).all(axis=1))
    return keep, rows[keep]


def whole_numbers(rows: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * rows), -LARGEST, LARGEST).astype(np.int64) + SHIFT


@dataclass
class Sums:
    """Of all vectors taking part: their number and the exact sum of each dimension."""

    n: int
    sums: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: longs where they have room, else Python's own integers."""
        most = max(map(abs, self.sums), default=0)
        if len(x) == 0 or self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + most < 1 << 62:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def squares(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of the squared deviations, exact."""
        d = self.deviations(x)
        if d.dtype == object:
            return [sum(v * v for v in row) for row in d.tolist()]
        if len(d) and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 62:
            return (d * d).sum(axis=1).tolist()
        size = np.abs(d)
        parts = [(size >> s) & 0xFFFFFF for s in (0, 24, 48)]  # products of 24 bits leave room for sums over dimensions
        return [sum(v << s for v, s in zip(row, (0, 25, 48, 49, 73, 96), strict=True)) for row in zip(*((a * b).sum(axis=1).tolist() for a, b in ((parts[0], parts[0]), (parts[0], parts[1]), (parts[1], parts[1]), (parts[0], parts[2]), (parts[1], parts[2]), (parts[2], parts[2]))), strict=True)]


def totals(vectors: DataFrame, dim: int) -> Sums:
    """``vectors`` (id, vector). Every task sums its rows; Spark sums the tasks' rows, one a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, dtype=np.int64), np.zeros(dim, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                keep, rows = dense(batch.column(1).slice(at, BLOCK), dim)
                x = whole_numbers(rows)
                n += len(keep)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.record_batch([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    found = vectors.mapInArrow(run, "i long, n long, high long, low long").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).orderBy("i").collect()
    return Sums(found[0]["n"] if found else 0, [(r["high"] << 32) + r["low"] for r in found])


def covariance(vectors: DataFrame, dim: int, fitted: Sums) -> np.ndarray:
    """Over all vectors, centred before they are multiplied. A task gives its upper triangle; Spark sums these."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                y = fitted.centred(whole_numbers(dense(batch.column(1).slice(at, BLOCK), dim)[1]))
                total += y.T @ y
        if total.any():
            yield pa.record_batch([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], names=["i", "j", "v"])

    out = np.zeros((dim, dim))
    found = vectors.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy() / max(fitted.n, 1)
    return out + np.triu(out, 1).T


def whiten(df: DataFrame, *, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row whose vector is neither null
    nor holds null or non-finite entries, for each of the leading components.

    Vectors shorter than the longest count as padded with zeros. Where the vectors don't vary (one vector, equal ones,
    fewer independent ones than components) ``whitened`` is null and ``explained`` 0. ``deviation`` is null where it
    exceeds a long. Rows that share a key, or have none, are rows of their own; other columns aren't read. A table
    without such rows gives none.
    """
    vectors = df.select(F.col(key).cast("long").alias("id"), F.col(column).alias("vector"))
    dim = vectors.agg(F.max(F.size("vector")).alias("d")).first()["d"] or 0
    dim = max(dim, 0)
    fitted = totals(vectors, dim)
    v = covariance(vectors, dim, fitted)
    values, axes = leading(v, min(components, dim)) if dim else (np.zeros(0), np.zeros((0, 0)))
    trace = float(np.trace(v))
    good = int((values > ROUNDING * max(dim, 1) * _EPS * trace).sum())
    made = len(values)
    shared = df.sparkSession.sparkContext.broadcast((fitted, axes[:, :good] / np.sqrt(values[:good])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, projection = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                keep, rows = dense(batch.column(1).slice(at, BLOCK), dim)
                x = whole_numbers(rows)
                squares = [s if s < 1 << 63 else None for s in own.squares(x)]
                white = own.centred(x) @ projection
                offsets = pa.array(np.arange(len(keep) + 1, dtype=np.int32) * white.shape[1])
                yield pa.record_batch([batch.column(0).slice(at, BLOCK).take(pa.array(keep)), pa.array(squares, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))], names=["vec_id", "deviation", "white"])

    table, _ = cut(vectors.mapInArrow(run, "vec_id long, deviation long, white array<double>"), "whitened")
    explained = [float(e) / trace if k < good else 0.0 for k, e in enumerate(values)]
    at = F.array(*(F.struct(F.lit(k + 1).alias("component"), (F.col("white")[k] if k < good else F.lit(None).cast("double")).alias("whitened"), F.lit(explained[k]).alias("explained")) for k in range(made)))
    if not made:
        at = F.array(F.struct(F.lit(1).alias("component"), F.lit(None).cast("double").alias("whitened"), F.lit(0.0).alias("explained")))
    wide = table.select("vec_id", "deviation", F.explode(at).alias("c"))
    return wide.select("vec_id", "c.component", F.lit(fitted.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(identity_error(table, good)).alias("identity_error"))


def identity_error(table: DataFrame, good: int) -> float:
    """Of the written results: how far their covariance, centred first, is from the identity at most; 0 without any."""
    if not good:
        return 0.0
    means = table.agg(*(F.avg(F.col("white")[k]).alias(f"m{k}") for k in range(good))).first()
    off = [F.col("white")[k] - F.lit(means[k]) for k in range(good)]
    pairs = [(i, j) for i in range(good) for j in range(i, good)]
    found = table.agg(*(F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[k] - (i == j)) for k, (i, j) in enumerate(pairs))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` that take part: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
