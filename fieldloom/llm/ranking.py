"""Gapless row numbers and running sums per key that no single task has to gather.

A key may hold a third of all rows. Each key is cut into order-preserving buckets; a window numbers the rows of one
(key, bucket), and a small table of bucket totals, itself windowed per key, gives each bucket its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.names import fresh

#: Rows that one (key, bucket) holds on average if a single key holds everything.
ROWS_PER_BUCKET = 5_000


def buckets_for(n_rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Number of buckets; grows with the rows, so that a bucket doesn't."""
    return max(1, -(-n_rows // per_bucket))


def running(df: DataFrame, key: Column, order: Column, buckets: int, *, weight: Column | None = None, out: str = "_before", tie: Column | None = None) -> DataFrame:
    """Add ``out``: how much weight (rows, without ``weight``) of the same key stands before this row.

    ``order`` is a string of hex digits, evenly spread (a digest), by which rows of a key are ordered; ``tie`` breaks
    ties. Nulls in ``key`` are one key. Rows equal in order and tie get distinct places in any order. Empty input
    gives empty output. Columns of ``df`` keep their names and values, but one named ``out`` is replaced.
    """
    w = F.lit(1) if weight is None else weight
    digits = 6
    c = fresh(df, "key", "order", "weight", "bucket", "inner", "offset", "tie", "out")
    own = df.withColumns({c["key"]: F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")), c["order"]: order, c["weight"]: w.cast("long"), c["tie"]: F.lit(0) if tie is None else tie})
    own = own.withColumn(c["bucket"], F.floor(F.conv(F.substring(c["order"], 1, digits), 16, 10).cast("long") * buckets / (16**digits)).cast("int"))
    totals = own.groupBy(c["key"], c["bucket"]).agg(F.sum(c["weight"]).alias("sum"))
    ahead = Window.partitionBy(c["key"]).orderBy(c["bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(c["key"], c["bucket"], F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias(c["offset"]))
    inner = Window.partitionBy(c["key"], c["bucket"]).orderBy(c["order"], c["tie"]).rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn(c["inner"], F.coalesce(F.sum(c["weight"]).over(inner), F.lit(0)))
    joined = placed.join(offsets, [c["key"], c["bucket"]]).withColumn(c["out"], F.col(c["inner"]) + F.col(c["offset"]))
    return joined.select(*(joined[x] for x in df.columns if x.lower() != out.lower()), joined[c["out"]].alias(out))
