"""Line dedup, passages, SimHash, packing, sharding and mixing against plain loops on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import components, lines, mixing, packing, passages, ranking, sharding, simhash

WHITE = " \t\n\r\x0b\x0c"


def ascii_lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# lines


def plain_lines(rows):
    split = {r[0]: (r[1] or "").split("\n") for r in rows}
    key = lambda x: ascii_lower(x.strip(WHITE))
    held = defaultdict(set)
    for i, own in split.items():
        for x in own:
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    out = {}
    for i, own in split.items():
        stay = [x for x in own if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == i]
        out[i] = (len(own), len(own) - len(stay), "\n".join(stay))
    return out


def test_lines(docs, rows):
    want = plain_lines(rows)
    assert sum(v[1] for v in want.values()) == 7
    assert by_id(lines.drop_common_lines(docs), "n_lines", "n_dropped", "text") == want


def test_lines_edges(spark, docs, empty):
    assert lines.drop_common_lines(empty).count() == 0
    odd = docs.withColumn("n_lines", F.lit("mine")).withColumn("digest", F.lit(1)).unionByName(docs.limit(0).withColumns({"n_lines": F.lit(""), "digest": F.lit(0)}))
    out = lines.drop_common_lines(odd)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "digest", "n_lines", "n_dropped"] and out.count() == docs.count()
    text = "the same line of more than forty characters, you see"
    same = spark.createDataFrame([(1, text)] * 5 + [(None, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_dropped"]) for r in lines.drop_common_lines(same).collect()) == [(-1, 0)] + [(1, 0)] * 5  # the largest doc_id keeps it in all its rows


# passages


def plain_passages(rows):
    split = {r[0]: (r[1] or "").encode().split() for r in rows}
    first: dict[bytes, int] = {}
    for i in sorted(split):
        for k in range(len(split[i]) - 49):
            first.setdefault(b" ".join(split[i][k : k + 50]), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[b" ".join(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def test_passages(docs, rows):
    found = passages.repeated_passages(docs).withColumn("kept", F.lower(F.hex("kept_sha")))
    want = plain_passages(rows)
    assert sum(v[1] > 0 for v in want.values()) >= 9
    assert by_id(found, "n_words", "n_removed", "kept") == want
    cut = by_id(passages.cut_passages(docs, found), "text")
    assert {i: sha(t[0]) for i, t in cut.items()} == {i: v[2] for i, v in want.items()}


def test_passages_edges(spark, empty, docs):
    assert passages.repeated_passages(empty).count() == 0
    text = " ".join(f"w{k}" for k in range(60))
    rows = spark.createDataFrame([(5, text, 1), (5, text, 2), (9, text, 3), (None, text, 4), (2, "x " + text[:100], 5)], "doc_id long, text string, spans int")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in passages.repeated_passages(rows).collect())
    assert got == [(-1, 0), (2, 0), (5, 0), (5, 0), (9, 60)]


def test_cover():
    differences = {(a - b) % passages.PERIOD for a in passages.COVER for b in passages.COVER}
    assert differences == set(range(passages.PERIOD))
    hashes = passages.WordHashes()
    w = [b"a", b"b", b"c"] * 40
    lane = hashes.lanes(w)[:, 0]
    h = hashes.rolling(lane, 20, np.arange(100))
    assert all(h[k] == h[k + 3] for k in range(90)) and len(set(h.tolist())) == 3


# SimHash


def plain_fingerprint(text, words=3):
    w = [x for x in re.split(f"[{WHITE}]+", ascii_lower(text or "")) if x]
    s = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(nodes, linked):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_simhash(docs, rows, distance):
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows}
    want = reachable(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= distance)
    found = by_id(simhash.near_duplicates(docs, distance=distance), "fp", "component_id")
    assert {i: v[0] % (1 << 64) for i, v in found.items()} == fps
    assert {i: v[1] for i, v in found.items()} == want and len(set(want.values())) < len(want) - 4


def test_simhash_crowd(spark):
    """Many fingerprints around one value, and some by chance, give the links of all pairs."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    values = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))} | {int(v) for v in rng.integers(0, 1 << 62, 200)}
    fps = spark.createDataFrame([(v, v) for v in values], "fp long, id long")
    links = [(r["a"], r["b"]) for r in simhash.links(fps).collect()]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = reachable(values, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {v: got.get(v, v) for v in values} == want


def crowd_of(spark, crowd: int, others: int):
    """Values of 14 bits around one centre, and others by chance."""
    rng = np.random.default_rng(4)
    centre = int(rng.integers(1 << 62))
    values = sorted({centre ^ (int(v) << 20) for v in rng.permutation(1 << 14)[:crowd]} | {int(v) for v in rng.integers(0, 1 << 62, others)})
    return values, spark.createDataFrame([(v, v) for v in values], "fp long, id long")


def test_simhash_crowd_rows(spark, monkeypatch):
    """A crowd takes no more than its rows: it doesn't make all fingerprints probe with flipped bits."""
    rows = []

    def counting(df, name):
        rows.append(df.count())
        raise InterruptedError

    monkeypatch.setattr(simhash, "cut", counting)
    for crowd in (600, 1200):
        values, fps = crowd_of(spark, crowd, 3000)
        with pytest.raises(InterruptedError):
            simhash.links(fps)
        assert crowd <= rows[-1] <= 3 * len(values), (crowd, rows)
    assert rows[1] <= 2.2 * rows[0]


@pytest.mark.parametrize("plan", [[(range(0, 32), 1), (range(32, 64), 0)], [(range(0, 21), 2)]])
def test_simhash_flips(spark, monkeypatch, plan):
    """Any plan's probes find all links, a fingerprint flips only its rarer values, and flips alone don't share a key."""
    values, fps = crowd_of(spark, 150, 150)
    plan = [(list(bits), most) for bits, most in plan]
    n, both = simhash.bit_statistics(fps)
    common = simhash.mask_of(np.flatnonzero(2 * np.diag(both) > n).tolist())
    probes = simhash.probe_keys(fps, plan, common).collect()
    assert len(probes) < 0.6 * n * sum(math.comb(len(bits), k) for bits, most in plan for k in range(most + 1))
    kept = simhash.sharing(spark.createDataFrame([(1, 0, 9, 1, 0), (2, 0, 9, 1, 0), (3, 0, 8, 1, 0), (4, 0, 8, 0, 1)], "id long, g int, key long, flips int, left int"), "g", "key")
    assert sorted(r["id"] for r in kept.collect()) == [3, 4]
    monkeypatch.setattr(simhash, "search_plan", lambda fps, distance: (plan, n, both))
    got = {r["node"]: r["component"] for r in components.components(simhash.links(fps)).collect()}
    assert {v: got.get(v, v) for v in values} == reachable(values, lambda a, b: (a ^ b).bit_count() <= 2)


def test_simhash_edges(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, None), (7, " ")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(rows).collect())
    assert got == [(-1, 4), (2, 2), (4, 4), (4, 4), (7, 2)]
    assert simhash.allocate(np.array([[0, 5, 50, 500], [0, 1, 2, 3], [0, 4, 40, 400]], dtype=float), 2) == (3.0, [-1, 2, -1])


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (9, 8), (500, 300), (300, 400)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {k: 300 for k in (300, 400, 500)}
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


# packing


def test_packing(docs, rows, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(docs).collect()
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    want = {(i, k, 2048 * k, len(own[2048 * k : 2048 * (k + 1)]), zlib.crc32(np.array(own[2048 * k : 2048 * (k + 1)], dtype="<u4").tobytes())) for i, own in ids.items() for k in range(-(-len(own) // 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    check_places(got)
    assert len({r["sequence_id"] for r in got}) <= -(-sum(r["length"] for r in got) // 2048) + 1


def check_places(got):
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_edges(spark, empty, docs):
    assert packing.pack_documents(empty).count() == 0
    same = packing.pack_documents(spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "a " * 3000)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in same) == [(-1, 1), (1, 2), (1, 2), (2, 953), (2, 2048)]
    check_places(same)
    with pytest.raises(ValueError, match="outside"):
        packing.pack(spark.createDataFrame([(1, 0, 3000)], "doc_id long, piece int, length long"))


def test_plan_takes_two_for_one():
    plans = packing.plan_bins({60: 1, 35: 1, 22: 1, 18: 1}, 100)  # 60 + 35 leaves 5; 60 + 22 + 18 fills the bin
    assert sorted(map(tuple, (p for p, _ in plans))) == [(35,), (60, 22, 18)]
    rng = np.random.default_rng(2)
    counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 100, 5000), return_counts=True), strict=True)}
    plans = packing.plan_bins(counts, 100)
    held = defaultdict(int)
    for own, n in plans:
        assert sum(own) <= 100
        for x in own:
            held[x] += n
    assert held == counts and sum(n for _, n in plans) <= 1.01 * sum(k * v for k, v in counts.items()) / 100


@pytest.mark.parametrize("text", ["don't we'll IT'S x's1 ½²", "Σίσυφος ΣΑΣ É é", "日本語 mix123 a\x1cb", "ªº µM ÀÉ ß ÿ ×÷", "..,!?''s " + "a" * 300, "<|endoftext|>x"])
def test_word_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    assert packing.WordIds(packing.default_tokenizer()).ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


# sharding


def plain_shard(spark, ids, n):
    out = {}
    for i in ids:
        at = step = 0
        while True:
            step += 1
            h = spark.range(1).select(F.xxhash64(F.lit(i).cast("long"), F.lit(step))).first()[0] % (1 << 64)
            to = int((at + 1) / (((h >> 33) + 1) / (1 << 31)))
            if to >= n:
                break
            at = to
        out[i] = at
    return out


def test_shards(spark, docs):
    n = spark.range(20_000).withColumnRenamed("id", "doc_id")
    got = sharding.shard_by_key(n, "doc_id", 40, buckets=ranking.buckets_for(20_000, 100)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values()) and sorted(slots) == list(range(40))
    assert all(400 < len(own) < 600 for own in slots.values())
    moved = [r for r in got if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {40} and 300 < len(moved) < 700
    some = {r["doc_id"]: r["shard"] for r in got if r["doc_id"] < 8}
    assert some == plain_shard(spark, some, 40)


def test_shards_edges(spark):
    assert sharding.shard_by_key(spark.range(0), "id", buckets=1).count() == 0
    same = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    got = sharding.shard_by_key(same, "doc_id", 3, buckets=1).collect()
    ones = [r for r in got if r["doc_id"] == 1]
    assert len({r["shard"] for r in ones}) == 1 and len({(r["shard"], r["slot"]) for r in got}) == 3
    with pytest.raises(ValueError, match="at least 1"):
        sharding.jump_shards(F.col("x"), 0)


def test_clashing_names(spark, docs):
    """Columns named like working or added columns: no crash, none of the caller's values changed, none doubled."""
    taken = ["lost", "rank", "key", "order", "weight", "bucket", "inner", "offset", "tie", "out", "edge", "piece", "whole", "target", "cut", "words", "fp", "n"]
    odd = docs.where("doc_id <= 34").select("doc_id", "text", "source", *(F.concat(F.lit(k), F.col("doc_id")).alias(f"_{c}") for c in taken for k in [c]), F.lit("x").alias("slot"), F.lit("y").alias("Size"), F.lit("t").alias("TAKEN"), F.lit("z").alias("Shard"))

    def check(out, *added, n=12):
        assert len({c.lower() for c in out.columns}) == len(out.columns) and set(added) <= set(out.columns)
        got = out.collect()
        assert len(got) == n and all(r[f"_{c}"] == f"{c}{r['doc_id']}" for r in got for c in taken)

    check(lines.drop_common_lines(odd), "n_lines", "n_dropped")
    check(sharding.shard_by_key(odd, "doc_id", 4, buckets=2), "shard", "slot", "grown_shard")
    check(mixing.mix(odd, buckets=2), "size", "taken")
    check(packing.pack(odd.withColumns({"piece": F.lit(0), "length": F.lit(7).cast("long")})), "sequence_id", "offset")
    assert mixing.materialise(mixing.mix(odd, buckets=2), ["doc_id", "_cut"]).where("_cut <> concat('cut', doc_id)").count() == 0
    assert simhash.near_duplicates(odd).columns == ["doc_id", "fp", "component_id"] and simhash.near_duplicates(odd).count() == 12


# mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full: dict = {}
    while True:
        left = sum(sizes.values()) - sum(full.values())
        open_ = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("buckets", [1, 7])
def test_mix(docs, rows, buckets):
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sums = defaultdict(int)
    for i, n in size.items():
        sums[source[i]] += n
    target = plain_targets(dict(sums))
    got = mixing.mix(docs, buckets=buckets).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["repeats"] * r["size"] + r["part"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sums)
    again = mixing.mix(docs.repartition(2), buckets=buckets + 3).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    made = mixing.materialise(mixing.mix(docs, buckets=buckets), ["doc_id", "text"]).collect()
    assert sum(len((r["text"] or "").encode().split()) for r in made) == sum(taken.values())


def test_mix_edges(spark, empty):
    assert mixing.mix(empty, buckets=1).count() == 0
    rows = spark.createDataFrame([(1, None, "a", 9), (1, None, "a", 9), (2, "x y z", None, 9), (3, "x", "\U0001f600", 9), (4, "x", "￮", 9)], "doc_id long, text string, source string, size int")
    got = mixing.mix(rows, buckets=2).collect()
    assert len(got) == 5 and {r["taken"] for r in got if r["doc_id"] == 1} == {0}
    want = plain_targets({"a": 0, None: 3, "\U0001f600": 1, "￮": 1})
    assert {r["source"]: r["target"] for r in got} == pytest.approx(want)
