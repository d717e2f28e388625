"""Near copies against all pairs compared plainly, also where one group is large."""

from __future__ import annotations

import random

import corpus_pipeline as P
from fieldloom.llm import nearcopies
from tests.llm.conftest import SCHEMA, sentence


def plain(texts: dict[int, str | None]) -> dict[int, int]:
    """Smallest id of each text's group, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            both = sets[i] & sets[j]
            if j > i and (len(both) * 5 >= len(sets[i] | sets[j]) * 4):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return root


def changed(rng: random.Random, words: list[str], n: int) -> str:
    out = list(words)
    for k in rng.sample(range(5, len(words) - 5), n):
        out[k] = "x" + out[k]
    return " ".join(out)


def test_all_pairs_from_four_fifths_on(spark):
    rng = random.Random(11)
    texts: dict[int, str | None] = {900: None, 901: " \n", 902: "two words", 903: "Two  WORDS", 904: "two other"}
    for k in range(60):
        base = sentence(rng, 300).split()
        texts |= {4 * k: " ".join(base), 4 * k + 1: changed(rng, base, rng.randint(3, 6)), 4 * k + 2: changed(rng, base, rng.randint(6, 9))}
    rows = [(i, t, "en", "s", 0) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(texts)
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == want
    assert {r["doc_id"] for r in P.simhash_dedup(spark, docs, "").collect()} == set(want.values())


def test_a_large_group(spark):
    rng = random.Random(12)
    base = sentence(rng, 200).split()
    texts = {k: changed(rng, base, rng.randint(1, 5)) for k in range(150)}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == plain(texts)
