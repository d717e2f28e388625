"""A training corpus from raw documents, in stages that are each written before the next reads them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import langid, lines, mixing, nearcopies, packing
from fieldloom.llm.joins import small_side
from fieldloom.sessions import cut, discard, owning, shared_dir, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The expression has no equal in SQL: a fitted classifier, fingerprints and a tokenizer.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their predicted language as lang; those whose text is null or has no letter go.

    Where no label was there to learn from, those with a letter stay as they are.
    """
    ship(spark)
    model = langid.fit(docs.where(~langid.held_out()).select("text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.identify(docs, model).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many hold; n_chars follows. A document may be left empty."""
    ship(spark)
    return lines.drop_common_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together; rows without one can't be named and stay.
    """
    ship(spark)
    found = nearcopies.near_copies(docs)
    go = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where(~F.col("stays")).select("doc_id")
    go, _ = cut(go, "copies")
    return docs.join(small_side(go), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks: none, once or several times, the last of a source in part.

    Null sources are one source, null and wordless texts take no part, repeated rows count each; see
    :func:`fieldloom.llm.mixing.mix`. Only the five columns of documents go on, whatever else there is.
    """
    ship(spark)
    return mixing.materialise(mixing.mix(docs), COLUMNS).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, in sequences of 2048 tokens.

    A null text is an empty one; repeated rows are packed each; see :func:`fieldloom.llm.packing.pack_documents`.
    """
    ship(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


@owning
def written(spark: SparkSession, stage: Callable[[SparkSession, DataFrame, str], DataFrame], docs: DataFrame, sf_dir: str, path: str) -> DataFrame:
    """A stage's result, written and read again; the working tables of the stage go."""
    stage(spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again; the one before goes then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        docs = written(spark, stage, docs, sf_dir, path)
        if before:
            discard(spark, before)
        before = path
    return docs
