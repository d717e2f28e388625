"""What the operators on embeddings share: usable vectors, packed, and classes of equal ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.sessions import cut


def dimension(df: DataFrame, column: str) -> int:
    """Length of the longest vector; shorter ones count as if padded with zeros."""
    return df.agg(F.max(F.size(column)).alias("d")).collect()[0]["d"] or 0


def matrix(packed: pa.Array, kind: str) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    rows = packed.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1).astype(np.float64) if rows else np.zeros((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so that no square overflows."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True) if len(rows) else rows
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)) if len(rows) else rows


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision; the same whatever the rows around them.

    Rows are first scaled by powers of two, which changes no digit and keeps squares from overflowing.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(df: DataFrame, key: str, column: str) -> tuple[DataFrame, int, str]:
    """(id, vec) of the vectors that are neither null nor zero and hold finite components only; their length and kind."""
    dim = dimension(df, column)
    kind = "<f4" if df.schema[column].dataType.elementType.simpleString() == "float" else "<f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = [], []
            for at, own in enumerate(batch.column(1)):
                if own.is_valid and len(own):
                    v = own.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(v).all() and v.any():
                        ids.append(at)
                        vecs.append(np.pad(v, (0, dim - len(v))).tobytes())
            yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(vecs, pa.binary())], names=["id", "vec"])

    known = df.where(F.col(key).isNotNull() & F.col(column).isNotNull())
    return known.select(F.col(key).cast("long"), column).mapInArrow(packed, "id long, vec binary"), dim, kind


def equal_classes(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Of (id, vec): each class of equal vectors as (rep, copies, ids), and (id, rep) for every vector.

    ``rep`` is the smallest id, ``ids`` the ``keep`` smallest. A class may hold a third of all vectors, so its ids are
    ranked in parts before they meet.
    """
    keyed, _ = cut(vectors.select("id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")), "digests")
    sizes = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    first = keyed.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(256)))
    for keys in (["h1", "h2", "part"], ["h1", "h2"]):
        first = first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("rank") <= keep)
    lists = first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes, _ = cut(sizes.join(lists, ["h1", "h2"]), "classes")
    members = keyed.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep")
    return classes.select("rep", "copies", "ids"), members
