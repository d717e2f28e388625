"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import alignment, ann, embeddings, htmltext, langid, lines, mixing, packing, passages, sharding, simhash, urlfilter, whitening
from fieldloom.sessions import ship

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__doc__ = query.__doc__
    return run


def queries() -> dict[str, Query]:
    found = (
        lines.op1_line_dedup,
        passages.op2_passages,
        embeddings.op3_embeddings,
        packing.op4_packing,
        langid.op5_langid,
        mixing.op6_mixing,
        ann.op7_ann,
        simhash.op8_simhash,
        sharding.op9_sharding,
        htmltext.op10_html,
        alignment.op11_alignment,
        urlfilter.op12_urls,
        whitening.op13_whitening,
    )
    return {f.__name__: _shipped(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": lines.OP1_SQL, "op2_passages": passages.OP2_SQL, "op3_embeddings": embeddings.OP3_SQL, "op6_mixing": mixing.OP6_SQL}
