from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with shared lines and passages, exact and near copies, nulls, white space of all kinds, a long text."""
    rng = random.Random(7)
    common = "This common line IS held by many documents, far more than five."
    passage = sentence(rng, 70)
    texts: list[str | None] = [None, "", " \t\n\r\x0b\x0c ", "one", "Two words", "É ß µ   x"]
    texts += [f"{sentence(rng, 30)}\n  {common.upper() if k % 2 else common}\t\n{sentence(rng, 12)}\n" for k in range(8)]
    texts += [f"{sentence(rng, 11 + k)} {passage} {sentence(rng, 9)}" for k in range(6)]
    base = sentence(rng, 300)
    words = base.split()
    texts += [base, base, base.upper()] + [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (3, 150, 299)]
    texts += [sentence(rng, 20_000), *(sentence(rng, rng.randint(1, 400)) for _ in range(20))]
    return [(k * 3 + 1, t, "en", f"s{k % 4}" if k % 5 else None, len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
