"""Embedding near-dedup: spherical k-means cells, blocked cosines inside cells, components of the links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.components import components
from fieldloom.llm.vectors import equal_classes, exact_cosines, matrix, unit, usable
from fieldloom.sessions import cut, owning

COSINE = 0.9
#: Cells are fitted on so many distinct vectors at most.
SAMPLE = 8192
ROUNDS = 8
#: Vectors of a side that meet in one group.
BLOCK = 2048
SEED = 3


def cells_for(n: int) -> int:
    """Number of cells; grows with the root of the vectors, so that assigning and comparing grow alike."""
    return max(1, round(math.sqrt(n) / 4))


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centres of unit rows. An empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        home = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centres[norm > 1e-9] = sums[norm > 1e-9] / norm[norm > 1e-9, None]
    return centres


class Cells:
    """Where a unit vector must be compared so that no pair within the distance is lost.

    Of two vectors whose nearest centres differ, i and j, the plane between c_i and c_j parts them. They lie at most
    ``reach`` apart, so one of them lies within half of it from that plane; it visits the other's cell. So every pair
    meets in a cell that is the home of at least one of them.
    """

    def __init__(self, centres: np.ndarray, cosine: float) -> None:
        self.centres = centres
        reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
        apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
        self.margin = reach / 2 * apart

    def visits(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home cell of each row, and a mask of the cells that it visits or lives in."""
        near = rows @ self.centres.T
        home = near.argmax(axis=1)
        at = np.arange(len(rows))
        mask = near[at, home][:, None] - near <= self.margin[home]
        mask[at, home] = True
        return home, mask


def grouped(index: DataFrame, cells: Cells, kind: str, homes: dict[int, int], guests: dict[int, int]) -> DataFrame:
    """Rows (id, copies, vec, home, cell, hb, gb, side) by group: a block of a cell's own and one of all it hosts."""
    shared = index.sparkSession.sparkContext.broadcast((cells, homes, guests))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, h_blocks, g_blocks = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                home, mask = c.visits(unit(matrix(part.column(2), kind)))
                ids = part.column(0).to_pylist()
                rows: list[tuple[int, int, int, int, int]] = []  # at, cell, hb, gb, side
                for i, cell in zip(*(x.tolist() for x in np.nonzero(mask)), strict=True):
                    place = ids[i] * 0x9E3779B97F4A7C15 % (1 << 64) >> 32
                    g = place * g_blocks[cell] >> 32
                    rows += [(i, cell, hb, g, 1) for hb in range(h_blocks.get(cell, 0))]
                    if home[i] == cell:
                        hb = place * h_blocks[cell] >> 32
                        rows += [(i, cell, hb, gb, 0) for gb in range(g_blocks[cell])]
                at, cell, hb, gb, side = (pa.array(x, pa.int32()) for x in (zip(*rows, strict=True) if rows else [()] * 5))
                take = [part.column(k).take(at) for k in range(3)]
                yield pa.record_batch([*take, pa.array(home, pa.int32()).take(at), cell, hb, gb, side], names=["id", "copies", "vec", "home", "cell", "hb", "gb", "side"])

    return index.select("id", "copies", "vec").mapInArrow(spread, "id long, copies long, vec binary, home int, cell int, hb int, gb int, side int")


def cell_counts(index: DataFrame, cells: Cells, kind: str) -> tuple[dict[int, int], dict[int, int]]:
    """Blocks of each cell's own vectors and of all that it hosts; the driver gets two numbers a cell."""
    shared = index.sparkSession.sparkContext.broadcast(cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n = np.zeros((len(c.centres), 2), dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                home, mask = c.visits(unit(matrix(batch.column(0).slice(low, BLOCK), kind)))
                n[:, 0] += np.bincount(home, minlength=len(n))
                n[:, 1] += mask.sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(len(n))), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["cell", "own", "all"])

    sums = index.select("vec").mapInArrow(count, "cell long, own long, all long").groupBy("cell").agg(F.sum("own").alias("own"), F.sum("all").alias("all")).collect()
    return {r["cell"]: -(-r["own"] // BLOCK) for r in sums if r["own"]}, {r["cell"]: -(-r["all"] // BLOCK) for r in sums if r["all"]}


def linked(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, cosine: float) -> np.ndarray:
    """Mask of pairs with at least the cosine; single precision decides but near the limit, where doubles do."""
    near = a.astype(np.float32) @ b.astype(np.float32).T
    out = near >= cosine + 1e-4
    i, j = np.nonzero((near >= cosine - 1e-4) & ~out)
    for low in range(0, len(i), 1 << 16):
        p, q = raw_a[i[low : low + (1 << 16)]], raw_b[j[low : low + (1 << 16)]]
        sure = exact_cosines(p, q) >= cosine
        out[i[low : low + (1 << 16)][sure], j[low : low + (1 << 16)][sure]] = True
    return out


@owning
def near_vectors(df: DataFrame, *, key: str = "vec_id", column: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``, by links between vectors of at least ``cosine``.

    Vectors null, zero or with null or non-finite components link with nothing. ``n_links`` counts the other vectors
    linked directly, ``component_id`` is the smallest id reachable, and ``kept`` marks it. The cells are fitted on a
    sample of ``sample`` distinct vectors at most, by the order of their ids' hashes; every vector is compared. Equal
    vectors are one node with a count. A group of a cell's own vectors and one of its guests report, for each node, a
    count and one link to the smallest node that it reaches within them, so that a dense group of copies sends rows in
    proportion to its size. Of rows that share an id, the one
    with the least packed vector counts. A row with a null id gives n_links 0, a null component and kept false. No rows give none.
    """
    vectors, _, kind = usable(df, key, column)
    vectors, _ = cut(vectors.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    classes, members = equal_classes(vectors, 1)
    index = vectors.withColumnRenamed("id", "rep").join(classes.select("rep", "copies"), "rep").dropDuplicates(["rep"])
    index, _ = cut(index.select(F.col("rep").alias("id"), "copies", "vec"), "index")
    n = index.count()
    everything = df.select(F.col(key).cast("long").alias("id"))
    if n:
        picked = index.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(sample).select("vec").toArrow()
        rows = unit(matrix(picked.column("vec").combine_chunks(), kind))
        cells = Cells(spherical_kmeans(rows, cells_for(n)), cosine)
    else:
        cells = Cells(np.ones((1, 1)), cosine)
    homes, guests = cell_counts(index, cells, kind)
    shared = df.sparkSession.sparkContext.broadcast(cells)

    def compare(group: pa.Table) -> pa.Table:
        c = shared.value
        side = group.column("side").to_numpy()
        ids, copies, home = (group.column(x).to_numpy() for x in ("id", "copies", "home"))
        raw = matrix(group.column("vec").combine_chunks(), kind)
        rows = unit(raw)
        h, g = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        nodes, totals, least = [], [], []
        if len(h) and len(g):
            cell = int(group.column("cell")[0].as_py())
            mask = linked(rows[h], rows[g], raw[h], raw[g], cosine)
            own = home[g] == cell
            mask &= ~own[None, :] | (ids[h][:, None] < ids[g][None, :])
            # a guest whose home this row visits too: the pair counts in the cell of the smaller number
            _, visits = c.visits(rows[h])
            mask &= own[None, :] | ~visits[:, home[g]] | (cell < home[g])[None, :]
            label_h, label_g = ids[h].copy(), ids[g].copy()
            hi, gi = np.nonzero(mask.any(axis=1))[0], np.nonzero(mask.any(axis=0))[0]
            mask = mask[np.ix_(hi, gi)]
            label_h, label_g = label_h[hi], label_g[gi]
            if mask.size:
                top = np.iinfo(np.int64).max
                while True:
                    to_h = np.minimum(label_h, np.where(mask, label_g[None, :], top).min(axis=1))
                    to_g = np.minimum(label_g, np.where(mask, to_h[:, None], top).min(axis=0))
                    if (to_h == label_h).all() and (to_g == label_g).all():
                        break
                    label_h, label_g = to_h, to_g
                dense = mask.astype(np.float64)
                for at, weight, label in ((h[hi], dense @ copies[g[gi]], label_h), (g[gi], dense.T @ copies[h[hi]], label_g)):
                    nodes.append(ids[at])
                    totals.append(np.rint(weight).astype(np.int64))
                    least.append(label)
        out = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (nodes, totals, least)]
        return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(("node", "n", "least"), out, strict=True)})

    found = grouped(index, cells, kind, homes, guests).groupBy("cell", "hb", "gb").applyInArrow(compare, "node long, n long, least long")
    found, _ = cut(found, "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("others"))
    reached = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    known = classes.join(counts.withColumnRenamed("node", "rep"), "rep", "left").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    known, _ = cut(known.select("rep", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "labels")
    placed = members.dropDuplicates(["id"]).join(known, "rep").select("id", "n_links", "component_id")
    component = F.coalesce("component_id", "id")
    return everything.join(placed, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings``: vec_id, n_links, component_id, kept."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


OP3_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL
), known AS (
  SELECT * FROM vectors WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM known a JOIN known b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
), least AS (
  SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counted USING (vec_id) LEFT JOIN least USING (vec_id)
"""
