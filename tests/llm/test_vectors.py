"""Embedding near-dedup and nearest neighbours against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from fieldloom.llm import ann, embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 20))
    rows = [b + 0.18 * rng.normal(size=20) * (k > 0) for b in base for k in range(6)]
    rows += [base[0]] * 25 + [2 * base[1]] + list(rng.normal(size=(100, 20)))
    ids = rng.permutation(len(rows)) * 2
    good = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(ids, rows, strict=True)]
    bad = [(9001, None), (9003, [0.0] * 20), (9005, [1.0, None] + [0.0] * 18), (9007, [float("nan")] + [1.0] * 19), (9009, [float("inf")] + [1.0] * 19), (9011, [])]
    return good, bad


@pytest.fixture(scope="module")
def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in vectors[0] + vectors[1]], SCHEMA).repartition(3)


def cosines(good):
    x = np.array([v for _, v in good], dtype=np.float64)
    n = np.sqrt((x * x).sum(axis=1))
    return x @ x.T / n[:, None] / n


def test_links(vectors, table, monkeypatch):
    good, bad = vectors
    monkeypatch.setattr(embeddings, "BLOCK", 16)  # many blocks and guests
    close = cosines(good) >= 0.9
    ids = [i for i, _ in good]
    label = dict(zip(ids, ids, strict=True))
    for _ in range(20):
        label = {i: min(label[ids[j]] for j in np.nonzero(close[k])[0]) for k, i in enumerate(ids)}
    want = {i: (int(close[k].sum()) - 1, label[i], label[i] == i) for k, i in enumerate(ids)} | {i: (0, i, True) for i, _ in bad}
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(table).collect()}
    assert got == want and max(v[0] for v in want.values()) >= 25 and len({v[1] for v in want.values()}) < len(want) - 100


def test_links_edges(spark, table):
    assert embeddings.near_vectors(table.limit(0)).count() == 0
    few = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.1]), (None, [1.0, 0.0]), (8, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(few).collect())
    assert got == [(-1, 0, None, False), (1, 1, 1, True), (3, 1, 1, False), (8, 0, 8, True)]


def test_neighbours(vectors, table):
    good, _ = vectors
    ids = np.array([i for i, _ in good])
    near = cosines(good)
    np.fill_diagonal(near, -9)
    got: dict[int, list] = {}
    for r in ann.nearest(table, table["vec_id"] % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [k for k, i in enumerate(ids) if i % 10 == 0]
    assert set(got) == {int(ids[k]) for k in queries}
    hits = 0
    for k in queries:
        order = np.lexsort((ids, -np.round(near[k], 12)))[:5]
        own = got[int(ids[k])]
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        hits += len({int(ids[j]) for j in order} & {v for _, v, _ in own})
        at = {int(i): near[k][j] for j, i in enumerate(ids)}
        assert all(s == pytest.approx(at[v], abs=1e-12) for _, v, s in own)
    assert hits >= 0.9 * 5 * len(queries)


def test_neighbours_edges(spark):
    few = spark.createDataFrame([(10, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (50, [0.0, 0.0])], SCHEMA.replace(", label int", ""))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(few, few["vec_id"] % 10 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(10, 1, 3, 1.0), (10, 2, 20, 1.0), (20, 1, 3, 1.0), (20, 2, 10, 1.0)]
    assert ann.nearest(few.limit(0), few["vec_id"] == 1).count() == 0


def test_hadamard():
    x = np.eye(8)
    h = ann.hadamard(x)
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8**-0.5)


def test_ties_go_to_the_smaller_id(spark):
    """Many exact and scaled multiples of a query's vector in one bucket: by score, then by id."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    rows = [(50, base.tolist()), *((int(i), rng.normal(size=16).tolist()) for i in range(101, 301))]
    rows += [(int(i), (base * s).tolist()) for i, s in zip(rng.permutation(np.arange(1001, 1041)), [0.5, 2.0, 3.7, 1.1] * 10, strict=True)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = [(r["vec_id"], r["score"]) for r in ann.nearest(table, table["vec_id"] == 50).orderBy("rank").collect()]
    others = [(i, np.array(v)) for i, v in rows if i != 50]
    score = ann.exact_cosines(np.tile(base, (len(others), 1)), np.array([v for _, v in others]))
    assert got == [(others[k][0], score[k]) for k in np.lexsort(([i for i, _ in others], -score))[:5]]


def test_huge_and_tiny_components(spark):
    rows = [(50, [1e200, 2e200]), (2, [1e200, 2.1e200]), (3, [2e-200, 4e-200]), (4, [1e200, -1e200]), (5, [3.0, 6.0]), (6, [0.0, 1e-310])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in ann.nearest(table, table["vec_id"] == 50).collect()}
    a = np.array([1.0, 2.0]) / np.sqrt(5)
    want = {2: a @ [1, 2.1] / np.hypot(1, 2.1), 3: 1.0, 4: a @ [1, -1] / np.sqrt(2), 5: 1.0, 6: a[1]}
    assert got == pytest.approx(want, abs=1e-12)
    found = {r["id"]: r["n_links"] for r in embeddings.near_vectors(table).collect()}
    assert found == {50: 3, 2: 4, 3: 3, 4: 0, 5: 3, 6: 1}  # 2 and 6: 0.903


def recall(got, near, ids, every: int) -> float:
    """Of the true five of each query, whatever their cosine, the share found."""
    found: dict[int, set] = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    queries = [k for k, i in enumerate(ids) if i % every == 0]
    true = [(k, j) for k in queries for j in np.argsort(-near[k])[:5]]
    return sum(ids[j] in found[ids[k]] for k, j in true) / len(true)


def test_joined_rotations_only_with_their_recall(spark, monkeypatch):
    """Two rotations forced: with neighbours near and far the recall holds, and where they don't reach it one is taken."""
    monkeypatch.setattr(ann, "rotations_for", lambda n, dim: 2)
    rng = np.random.default_rng(5)
    far = rng.normal(size=(1500, 32))
    near = np.repeat(rng.normal(size=(250, 32)), 6, axis=0) + 0.15 * rng.normal(size=(1500, 32))
    chosen = {}
    plain = ann.form_for

    def noted(*args):
        chosen[name] = plain(*args)
        return chosen[name]

    monkeypatch.setattr(ann, "form_for", noted)
    for name, rows in (("far", far), ("near", near), ("none will do", far)):
        monkeypatch.setattr(ann, "RECALL", 1.01 if name == "none will do" else 0.95)
        df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
        scaled = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        cosine = scaled @ scaled.T
        np.fill_diagonal(cosine, -9)
        assert recall(ann.nearest(df, df["vec_id"] % 10 == 0).collect(), cosine, list(range(1500)), 10) >= 0.93
    assert chosen["near"][0].signs.shape[1] == 2 and chosen["none will do"][0].signs.shape[1] == 1


def test_rotations_follow_the_table():
    assert [ann.rotations_for(n, 64) for n in (0, 1000, 100_000, 10**7, 10**12)] == [1, 1, 1, 2, 2]
    assert ann.rotations_for(10**9, 1024) == 1  # of which the driver would get too many counts
