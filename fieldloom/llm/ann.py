"""Approximate nearest neighbours by cross-polytope hashing with several probes, ranked again exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.vectors import equal_classes, exact_cosines, matrix, unit, usable
from fieldloom.sessions import cut, owning

NEAREST = 5
QUERY_EVERY = 50
TABLES = 16
PROBES = 8
#: A table's hash may join so many rotations' axes that its buckets hold about so many vectors, but two at most and not
#: more than so many buckets: the driver gets a count for each bucket that has vectors.
LOAD, MAX_ROTATIONS, MAX_BUCKETS = 2048, 2, 1 << 18
#: Joined rotations are taken only where so large a share of the nearest of a sample of queries is found, by comparing that
#: sample with all vectors; so many queries at most are in it.
RECALL, SAMPLE_QUERIES = 0.95, 256
SEED = 11
#: Vectors, and queries, that meet in one group at most on average.
BLOCK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; its length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations_for(n: int, dim: int) -> int:
    """Rotations that a table's hash may join: more axes to choose from as vectors get more."""
    width = 1 << max(0, dim - 1).bit_length()
    most = max(r for r in range(1, MAX_ROTATIONS + 1) if r == 1 or (2 * width) ** r <= MAX_BUCKETS)
    return min(most, max(1, round(math.log(max(1, n / LOAD), 2 * width))))


def forms(n: int, dim: int, tables: int, probes: int, seed: int) -> Iterator[tuple[Hasher, int]]:
    """Hashes and probes to try, the one with fewest candidates first, the last one with one rotation."""
    for rotations in range(rotations_for(n, dim), 0, -1):
        hasher = Hasher(dim, tables, seed, rotations)
        for more in (1, 4) if rotations > 1 else (1,):
            yield hasher, min(more * probes * rotations**3, hasher.buckets)


def sampled_recall(index: DataFrame, sample: DataFrame, truth: DataFrame, hasher: Hasher, kind: str, probes: int, k: int) -> float:
    """Share of the ``truth`` (q, rep, score: the k nearest of each of ``sample``) that the hash finds, or what is as near."""
    least = truth.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    found = candidates(index, sample, hasher, kind, probes, k).where(F.col("q") != F.col("rep")).join(least, "q").where(F.col("score") >= F.col("least") - 1e-12)
    got = found.groupBy("q").agg(F.count("*").alias("got")).join(least, "q", "right")
    share = got.agg(F.sum(F.least(F.coalesce("got", F.lit(0)), "n")).alias("got"), F.sum("n").alias("n")).first()
    return share["got"] / share["n"] if share["n"] else 1.0


class Hasher:
    """Pseudo-rotations: three times random signs and a Hadamard transform; in each table one or more of them."""

    def __init__(self, dim: int, tables: int, seed: int, rotations: int = 1) -> None:
        self.width = 1 << max(0, dim - 1).bit_length()
        self.tables, self.buckets = tables, (2 * self.width) ** rotations
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, rotations, 3, self.width))

    def nearest(self, rows: np.ndarray, table: int, n: int) -> np.ndarray:
        """The ``n`` nearest buckets of each unit row, nearest first: a rotation's bucket is the nearest signed axis (axis,
        or axis + width for its negative), and those of several rotations are near by the sum of what they fall short."""
        codes = short = np.zeros((len(rows), 1))
        for rotation in self.signs[table]:
            y = np.pad(rows, ((0, 0), (0, self.width - rows.shape[1])))
            for signs in rotation:
                y = hadamard(y * signs)
            both = np.concatenate([y, -y], axis=1)
            own = both.argmax(axis=1)[:, None] if n == 1 else np.argsort(-both, axis=1, kind="stable")[:, :n]
            near = np.take_along_axis(both, own, axis=1)
            sums = (short[:, :, None] + (near[:, :1] - near)[:, None, :]).reshape(len(rows), -1)
            joined = (codes[:, :, None] * 2 * self.width + own[:, None, :]).reshape(len(rows), -1)
            best = np.argsort(sums, axis=1, kind="stable")[:, :n]
            codes, short = np.take_along_axis(joined, best, axis=1), np.take_along_axis(sums, best, axis=1)
        return codes.astype(np.int64)


class Everything:
    """One bucket of all vectors: an exact scan in blocks."""

    tables, buckets = 1, 1

    def nearest(self, rows: np.ndarray, table: int, n: int) -> np.ndarray:
        return np.zeros((len(rows), 1), dtype=np.int64)


def hashed(vectors: DataFrame, hasher: Hasher | Everything, kind: str, probes: int, block: dict[tuple[int, int], int], other: dict[tuple[int, int], int], role: int) -> DataFrame:
    """Rows for each group that a vector (id, vec) takes part in: one block of its own side, all of the other side."""
    shared = vectors.sparkSession.sparkContext.broadcast((hasher, block, other))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, own_blocks, other_blocks = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                rows = unit(matrix(part.column(1), kind))
                ids = part.column(0).to_numpy()
                at, table, bucket, mine, theirs = [], [], [], [], []
                for t in range(h.tables):
                    axes = h.nearest(rows, t, probes)
                    for i, own in enumerate(axes.tolist()):
                        for b in own:
                            place = int(ids[i]) * 0x9E3779B97F4A7C15 % (1 << 64) >> 32
                            place = place * own_blocks.get((t, b), 1) >> 32
                            for o in range(other_blocks.get((t, b), 0)):
                                at.append(i)
                                table.append(t)
                                bucket.append(b)
                                mine.append(place)
                                theirs.append(o)
                take = pa.array(at, pa.int64())
                blocks = [pa.array(mine, pa.int32()), pa.array(theirs, pa.int32())]
                yield pa.record_batch(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(table, pa.int32()), pa.array(bucket, pa.int64()), *(blocks if role == 0 else blocks[::-1]), pa.array([role] * len(at), pa.int32())],
                    names=["id", "vec", "t", "bucket", "vb", "qb", "role"],
                )

    return vectors.mapInArrow(spread, "id long, vec binary, t int, bucket long, vb int, qb int, role int")


def bucket_counts(vectors: DataFrame, hasher: Hasher | Everything, kind: str, probes: int) -> dict[tuple[int, int], int]:
    """Vectors in each bucket of each table that has any."""
    shared = vectors.sparkSession.sparkContext.broadcast(hasher)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for batch in batches:
            rows = unit(matrix(batch.column(0), kind))
            for t in range(h.tables if len(rows) else 0):
                b, n = np.unique(h.nearest(rows, t, probes), return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(b), t)), pa.array(b), pa.array(n)], names=["t", "bucket", "n"])

    sums = vectors.select("vec").mapInArrow(count, "t long, bucket long, n long").groupBy("t", "bucket").agg(F.sum("n").alias("n"))
    return {(r["t"], r["bucket"]): r["n"] for r in sums.collect()}


def candidates(index: DataFrame, questions: DataFrame, hasher: Hasher | Everything, kind: str, probes: int, k: int) -> DataFrame:
    """(q, rep, score): for each of ``questions`` (id, vec) the ``k`` best of each group of buckets' blocks it meets in."""
    v_blocks = {b: -(-n // BLOCK) for b, n in bucket_counts(index, hasher, kind, 1).items()}
    q_blocks = {b: -(-n // BLOCK) for b, n in bucket_counts(questions, hasher, kind, probes).items()}
    rows = hashed(index, hasher, kind, 1, v_blocks, q_blocks, 0).unionByName(hashed(questions, hasher, kind, probes, q_blocks, v_blocks, 1))

    def best(group: pa.Table) -> pa.Table:
        role = group.column("role").to_numpy()
        ids = group.column("id").to_numpy()
        raw = matrix(group.column("vec").combine_chunks(), kind)
        vi, qi = np.nonzero(role == 0)[0], np.nonzero(role == 1)[0]
        out: tuple[list[np.ndarray], ...] = ([], [], [])
        if len(vi) and len(qi):
            scaled = unit(raw)
            n = min(k, len(vi))
            for low in range(0, len(qi), BLOCK):
                part = qi[low : low + BLOCK]
                near = scaled[part] @ scaled[vi].T
                # all that may be among the best once scored exactly, ties with the last of them included
                limit = np.partition(near, len(vi) - n, axis=1)[:, len(vi) - n] - 1e-12
                q, v = np.nonzero(near >= limit[:, None])
                score = exact_cosines(raw[part[q]], raw[vi[v]])
                order = np.lexsort((ids[vi[v]], -score, q))
                first = np.searchsorted(q[order], np.arange(len(part)))
                order = order[np.arange(len(order)) - first[q[order]] < n]
                for to, x in zip(out, (ids[part[q[order]]], ids[vi[v[order]]], score[order]), strict=True):
                    to.append(x)
        done = [np.concatenate(x) if x else np.zeros(0, dtype=kind_) for x, kind_ in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table({"q": pa.array(done[0], pa.int64()), "rep": pa.array(done[1], pa.int64()), "score": pa.array(done[2], pa.float64())})

    found = rows.groupBy("t", "bucket", "vb", "qb").applyInArrow(best, "q long, rep long, score double")
    return found.groupBy("q", "rep").agg(F.max("score").alias("score"))


def form_for(index: DataFrame, questions: DataFrame, n: int, dim: int, tables: int, probes: int, seed: int, kind: str, k: int) -> tuple[Hasher, int]:
    """The first of :func:`forms` with the recall wanted; one rotation, which finds far neighbours too, isn't measured."""
    every = list(forms(n, dim, tables, probes, seed))
    if len(every) > 1:
        sample, _ = cut(questions.orderBy(F.xxhash64(F.lit(seed), "id")).limit(SAMPLE_QUERIES), "sample")
        near = candidates(index, sample, Everything(), kind, 1, k + 1).where(F.col("q") != F.col("rep"))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
        truth, _ = cut(near.withColumn("r", rank).where(F.col("r") <= k).drop("r"), "truth")
        for hasher, own in every[:-1]:
            if sampled_recall(index, sample, truth, hasher, kind, own, k + 1) >= RECALL:
                return hasher, own
    return every[-1]


@owning
def nearest(df: DataFrame, query: Column, *, key: str = "vec_id", column: str = "embedding", k: int = NEAREST, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``df`` where ``query`` holds, not itself.

    Vectors null, zero or with null or non-finite components take no part. Each table's hash is the nearest signed axis
    of a pseudo-rotated unit vector; a query looks into the ``probes`` nearest buckets of every table. For large tables
    it may be that of two joined, with more probes, if these find ``RECALL`` of what a sample of the queries has nearest
    among all vectors; else it is one. All vectors in a bucket are candidates, however many: buckets are dealt in blocks by their counts, and a group
    holds one block of vectors and one of queries. Scores are cosines in double precision, ties go to the smaller id.
    Equal vectors are searched once, with the k + 1 smallest ids kept for each, which is as many as any query can ask
    for. Queries that found fewer than k are compared with all vectors. No vectors give none. Of rows that share an id,
    the one with the least packed vector is taken. Other columns are not read.
    """
    vectors, dim, kind = usable(df, key, column)
    vectors, _ = cut(vectors.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    classes, members = equal_classes(vectors, k + 1)
    asked = df.where(query).select(F.col(key).cast("long").alias("id")).distinct()
    asked, _ = cut(asked.join(members, "id"), "queries")
    index, _ = cut(vectors.join(classes.select(F.col("rep").alias("id")), "id"), "index")
    questions = index.join(asked.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    n = index.count()
    hasher, probes = form_for(index, questions, n, dim, tables, probes, seed, kind, k)

    def placed(once: DataFrame) -> DataFrame:
        few = once.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("rank") <= k + 1).drop("rank")
        return few.join(classes.select("rep", "ids"), "rep").select("q", "score", "ids")

    few, _ = cut(placed(candidates(index, questions, hasher, kind, probes, k + 1)), "nearest")
    got = few.groupBy("q").agg(F.sum(F.size("ids")).alias("n"))
    short, _ = cut(questions.join(got.where(F.col("n") > k).select(F.col("q").alias("id")), "id", "left_anti"), "short")
    if not short.isEmpty():
        few = few.join(short.select(F.col("id").alias("q")), "q", "left_anti").unionByName(placed(candidates(index, short, Everything(), kind, 1, k + 1)))
    each = asked.select(F.col("id").alias("query_id"), F.col("rep").alias("q")).join(few, "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows of ``embeddings`` whose vec_id is divisible by 50; query_id, rank, vec_id, score."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % QUERY_EVERY == 0)
