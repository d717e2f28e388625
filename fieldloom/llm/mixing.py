"""Mixing sources to target weights by capped water-filling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.joins import small_side
from fieldloom.llm.names import fresh
from fieldloom.llm.ranking import buckets_for
from fieldloom.sessions import cut, owning

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: A row a source is broadcast for so many sources; with more, it is joined like any table.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of (source, size): source, source_size, target (double), quota (long).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``max_epochs`` times its source's size and the excess goes to the others by weight, until none is above. That is
    one water level L with target = min(cap, L * weight): by rising cap / weight, the first k at which
    (total - caps before k) / (weights from k on) <= cap_k / weight_k gives L. ``quota`` is the target in whole words.
    A source of size 0 has target 0. Windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", turn).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    everything = Window.partitionBy(F.lit(0))
    rising = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(onward))
    per = per.withColumn("water", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("level").alias("level")))).over(everything)["level"])
    per = per.withColumn("target", F.when(F.col("water") * F.col("w") < F.col("cap"), F.col("water") * F.col("w")).otherwise(F.col("cap").cast("double")))
    return per.select("source", "source_size", "target", F.least(F.floor(F.col("target") + 0.5).cast("long"), "cap").alias("quota"))


@owning
def mix(docs: DataFrame, *, buckets: int | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source, more) with size, source_size, target, repeats, part and taken.

    A source's quota is ``repeats`` whole copies of each of its documents and one more of documents in the order of a
    seeded digest of doc_id (then of text) until the quota is full; the last of these is taken for its first ``part``
    words only. So ``taken`` = repeats * size + part adds up to the quota and never passes max_epochs * size. Rows alike
    in doc_id, source and text at the end of the quota share what is left of it evenly, which may leave less than a word
    a row untaken. A document of size 0, a null text among them, is taken for 0 words. Null sources are one source, a
    null doc_id has a digest of its own. Extra columns stay; those named like the added ones are replaced. No rows give
    none.

    Only numbers are shuffled: sums by source and bucket of the digest tell in which bucket a source's quota ends, only
    that bucket's sizes are put in order, and each row is then decided where it is read. ``buckets`` (from the number of
    rows, if None) sets how many rows a bucket has.
    """
    buckets = buckets_for(docs.count()) if buckets is None else buckets
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    order = F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), F.hex(F.xxhash64("text")))
    bucket = F.floor(F.conv(F.substring(order, 1, 6), 16, 10).cast("long") * buckets / 16**6).cast("int")
    size = n_words(F.col("text"))

    sums, _ = cut(docs.select("source", key.alias("key"), bucket.alias("bucket"), size.alias("size")).groupBy("source", "key", "bucket").agg(F.sum("size").alias("size")), "sums")
    plan = source_targets(sums, weights, max_epochs).withColumn("key", key).drop("source")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0).cast("long")))
    plan = plan.withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size"))
    up_to = Window.partitionBy("key").orderBy("bucket")
    summed = sums.select("key", "bucket", "size", F.sum("size").over(up_to).alias("through")).join(plan.select("key", "rest"), "key")
    ends = summed.where((F.col("rest") > 0) & (F.col("through") >= F.col("rest")) & (F.col("through") - F.col("size") < F.col("rest")))
    ends = ends.groupBy("key").agg(F.min(F.struct("bucket", (F.col("rest") - (F.col("through") - F.col("size"))).alias("left"))).alias("e")).select("key", F.col("e.bucket").alias("at"), F.col("e.left").alias("left"))

    last = docs.select(key.alias("key"), bucket.alias("bucket"), order.alias("order"), "text").join(small_side(ends, BROADCAST_SOURCES), "key").where(F.col("bucket") == F.col("at"))
    ranked = last.select("key", "order", "left", n_words(F.col("text")).alias("size")).groupBy("key", "order").agg(F.first("left").alias("left"), F.sum("size").alias("size"), F.count("*").alias("rows"))
    ranked = ranked.withColumn("before", F.sum("size").over(Window.partitionBy("key").orderBy("order")) - F.col("size"))
    edge = ranked.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("size") >= F.col("left")))
    edge = edge.select("key", F.col("order").alias("edge"), F.floor((F.col("left") - F.col("before")) / F.col("rows")).cast("long").alias("piece"))
    decided, _ = cut(plan.join(edge, "key", "left").select("key", "source_size", "target", "whole", "edge", "piece"), "sources")

    own = fresh(docs, "key", "order", "source_size", "target", "whole", "edge", "piece")
    placed = docs.withColumns({own["key"]: key, own["order"]: order}).join(small_side(decided.select(*(F.col(c).alias(own[c]) for c in decided.columns)), BROADCAST_SOURCES), own["key"])
    first = F.col(own["order"]) < F.col(own["edge"])
    part = F.when(F.col(own["order"]) == F.col(own["edge"]), F.least(F.col(own["piece"]), size)).otherwise(F.lit(0).cast("long"))
    full = F.coalesce(first, F.lit(False)) | ((part > 0) & (part == size))
    repeats = F.col(own["whole"]) + F.coalesce(full, F.lit(False)).cast("long")
    part = F.when(full, F.lit(0).cast("long")).otherwise(part)
    added = {"size": size, "source_size": F.col(own["source_size"]), "target": F.col(own["target"]), "repeats": repeats, "part": part, "taken": repeats * size + part}
    return placed.select(*(F.col(c) for c in docs.columns if c.lower() not in added), *(c.alias(name) for name, c in added.items()))


def materialise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as documents: one row for each whole repetition, and one with the first ``part`` words for a part."""
    name = fresh(mixed, "cut")["cut"]
    copies = F.when(F.col("repeats") > 0, F.array_repeat(F.lit(False), F.col("repeats").cast("int"))).otherwise(F.array().cast("array<boolean>"))
    rows = mixed.withColumn(name, F.explode(F.concat(copies, F.when(F.col("part") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when(F.col(name), F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``: doc_id, size, source_size, target, taken."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: Digests order the documents of a source alike in both engines; the level is found by the same search over sources.
OP6_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM per
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM per) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighed
), water AS (
  SELECT arg_min(lvl, cap / w) AS lvl FROM levels WHERE lvl <= cap / w
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT lvl FROM water) * w) AS target, cap FROM levels
), quotas AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), cap) AS quota FROM targets
), placed AS (
  SELECT doc_id, size, source,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('17:' || doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size
            + greatest(0, least(size, quota - (quota // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source
"""
