"""The stages one after the other, each against what it must do to its own input."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from fieldloom.llm import registry


@pytest.fixture(scope="module")
def stages(spark, docs):
    out, current = [docs], docs
    for _, stage in P.STAGES:
        current = stage(spark, current, "").cache()
        out.append(current)
    return out


def test_columns_and_order(stages):
    assert [name for name, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mix_sources", "best_fit_packing"]
    assert all(s.columns == P.COLUMNS for s in stages[1:-1])


def test_decisions(stages, rows):
    raw, named, lined, single, mixed, packed = ([r.asDict() for r in s.collect()] for s in stages)
    lettered = {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in named} == lettered and len(raw) > len(named)
    assert {r["doc_id"] for r in lined} == lettered and sum(len(r["text"]) for r in lined) < sum(len(r["text"]) for r in named)
    assert all(r["n_chars"] == len(r["text"]) for r in lined + mixed)
    assert {r["doc_id"] for r in single} < lettered
    base = [i for i, t, *_ in rows if t and t == rows[20][1]]
    assert len([i for i in base if i in {r["doc_id"] for r in single}]) == 1
    words = lambda rs: sum(len(r["text"].encode().split()) for r in rs)
    assert abs(words(mixed) - words(single)) <= 6
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}


def test_run_on_driver_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    got = P.run(spark, "/root/testdata/sf0.001")
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert got.count() > 0 and full.where("n > 2048 or n <> end").count() == 0


def test_result_holds_the_tokens(spark):
    from tokenizers import Tokenizer

    from fieldloom.llm import packing

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["one text", "one", "other words here", "w " * 3000]  # whole and cut copies share a doc_id
    docs = spark.createDataFrame([(k // 3, x, "en", "s", len(x)) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.best_fit_packing(spark, docs, "").collect()
    want = [[*t.encode(x, add_special_tokens=False).ids, packing.END_ID] for x in texts]
    pieces = sorted((k // 3, own[s : s + 2048]) for k, own in enumerate(want) for s in range(0, len(own), 2048))
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], dtype="<u4").tolist()) for r in got) == pieces
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)


def test_language_id_labels_what_stays(spark, empty):
    rows = [(k, t, lang, "s", 1) for k in range(40) for t, lang in [("the stone and the water", "en") if k % 2 else ("der stein und das wasser", "de")]]
    wrong = next(k for k in range(101, 200) if zlib.crc32(str(k).encode()) % 5 == 0)  # held out: else its own label is learned
    odd = [(100, "the water and the stone", None, "s", 1), (wrong, "das wasser und der stein", "en", "s", 1), (200, "12 !", "en", "s", 1)]
    got = {r["doc_id"]: r["lang"] for r in P.language_id(spark, spark.createDataFrame(rows + odd, empty.schema), "").collect()}
    assert got[100] == "en" and got[wrong] == "de" and 200 not in got and len(got) == 42
    bare = spark.createDataFrame([(1, "some text", None, "s", 1), (2, "\u00df1", None, "s", 1), (3, "12 !", None, "s", 1), (4, None, None, "s", 1)], empty.schema)
    assert {r["doc_id"]: r["lang"] for r in P.language_id(spark, bare, "").collect()} == {1: None, 2: None}


def test_registry():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)


def test_stages_on_odd_tables(spark, empty):
    for _, stage in P.STAGES:
        assert stage(spark, empty, "").count() == 0
    rows = spark.createDataFrame([(None, "a text of words", None, None, None), (None, None, "en", "s", 1), (5, "a text of words", "en", None, 3), (5, "a text of words", "en", None, 3), (9, "a text of words", "en", "s", 3)], empty.schema).withColumn("size", F.lit("mine"))
    got = {name: sorted((r["doc_id"] or -1) for r in stage(spark, rows, "").collect()) for name, stage in P.STAGES}
    assert got["language_id"] == [-1, 5, 5, 9] and got["line_dedup"] == [-1, -1, 5, 5, 9]
    assert got["simhash_dedup"] == [-1, -1, 5, 5]
    assert set(got["mix_sources"]) <= {-1, 5, 9} and got["best_fit_packing"] == [-1, -1, 5, 5, 9]
