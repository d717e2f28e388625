"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.ranking import buckets_for, running

SHARDS = 40
#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def jump_shards(key: Column, *counts: int) -> list[Column]:
    """The shard of ``key`` for each number of shards, without a ring table (Lamping and Veach 2014).

    A key jumps through shard numbers b0 = 0 < b1 < b2 ...: from b it jumps to floor((b + 1) / u) with u uniform in
    (0, 1], drawn from a hash of the key and the jump's index. With n shards it lives at the last b below n, so one
    more shard takes a key only if the key jumps exactly to it. A null key hashes like any other value.
    """
    if not counts or min(counts) < 1:
        raise ValueError("a shard count must be at least 1")
    top = max(counts)

    def step(acc: Column, i: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, i), 33).cast("double") + 1) / F.lit(float(1 << 31))
        to = F.least(F.floor((acc["at"] + 1) / u), F.lit(top).cast("long"))
        last = [F.when(to < n, to).otherwise(acc[f"s{n}"]).alias(f"s{n}") for n in counts]
        return F.when(acc["at"] < top, F.struct(to.alias("at"), *last)).otherwise(acc)

    zero = F.struct(F.lit(0).cast("long").alias("at"), *(F.lit(0).cast("long").alias(f"s{n}") for n in counts))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(top)), zero, step)
    return [path[f"s{n}"].cast("int") for n in counts]


def shard_by_key(df: DataFrame, key: str, shards: int = SHARDS, *, buckets: int) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (with one more shard) and ``slot`` (place in the shard, gapless from 0).

    The law is ``key``: the key and the number of shards decide, nothing else. Every row is kept. Equal keys share a
    shard and get slots of their own, in any order. A null key is a key like others. Columns of the added names are
    replaced, others stay as they are; ``key`` itself can't be one of them. Empty input: empty output.
    """
    added = ("shard", "grown_shard", "slot")
    if key.lower() in added:
        raise ValueError(f"the key can't be a column that is replaced: {key}")
    now, grown = jump_shards(F.col(key), shards, shards + 1)
    placed = df.drop(*(c for c in df.columns if c.lower() in added)).withColumns({"shard": now, "grown_shard": grown})
    spread = F.lpad(F.hex(F.xxhash64(F.lit(29), F.col(key))), 16, "0")
    return running(placed, F.col("shard"), spread, buckets, out="slot", tie=F.col(key))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 39 by doc_id; size is the text's UTF-8 bytes (null: none) plus 16."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    buckets = buckets_for(docs.count() // SHARDS)
    out = shard_by_key(rows, "doc_id", SHARDS, buckets=buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
