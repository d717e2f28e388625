"""SimHash near-dedup with a generalised pigeonhole search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.components import components
from fieldloom.sessions import cut, discard, owning

BITS = 64
SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Shingles hashed at once.
BLOCK = 1 << 15


def simhash(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes ``h``, as an unsigned integer; none: zero."""
    ones = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(h), BLOCK):
        bits = np.unpackbits(h[low : low + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """A text's fingerprint: A-Z lower-cased, words between ASCII white space, shingles with repeats."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles: Iterator[bytes] = iter([b" ".join(found)])
    else:
        shingles = map(b" ".join, zip(*(islice(found, k, None) for k in range(words)), strict=False))
    return simhash(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8"))


def fingerprints(docs: DataFrame, *, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row of ``docs``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], dtype="<u8").view("<i8")
            yield pa.record_batch([batch.column(0), pa.array(own, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(hashed, f"doc_id {kind}, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many of them have bits i and j both set.

    A matrix of fixed size, summed on the cluster.
    """

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BITS * BITS + 1)
        for batch in batches:
            raw = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint8).reshape(-1, 8)
            for low in range(0, len(raw), BLOCK):
                bits = np.unpackbits(raw[low : low + BLOCK], axis=1, bitorder="little").astype(np.float32)
                total[:-1] += (bits.T @ bits).ravel()
                total[-1] += len(bits)
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.astype(np.int64))], names=["at", "n"])

    sums = fps.select("fp").mapInArrow(gram, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for r in sums.collect():
        out[r["at"]] = r["n"]
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, partitions: int, bits: list[int] | None = None) -> list[list[int]]:
    """``bits`` (all) in ``partitions`` groups of nearly equal size, each grown from a free bit by the most correlated one.

    Correlated bits in one group leave the groups independent of one another, so that few fingerprints agree by chance
    in any of them.
    """
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    free = list(range(BITS) if bits is None else bits)
    groups: list[list[int]] = []
    for k in range(partitions):
        size = -(-len(free) // (partitions - k))
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (like[b, group].mean(), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits: Iterable[int]) -> int:
    """The bits as a signed long."""
    return int(np.array([sum(1 << b for b in bits)], dtype="<u8").view("<i8")[0])


def row_estimates(same: dict[int, tuple[float, int]], n: int, both: np.ndarray, groups: list[list[int]], distance: int) -> np.ndarray:
    """Estimated rows made for each group and threshold from -1 (unused: none) to ``distance``.

    These are the probes, as many as if bits took their rarer values independently; those that share a key; and, for
    each of the latter, distance + 1 in the second pigeonhole. Pairs aren't made, so a crowd counts by its rows. ``same``
    has the pairs and the rows that agree in a whole group, counted over all fingerprints; pairs of wider thresholds
    grow from it as they would if bits agreed independently with the chance their share of ones gives, and bound the
    rows that share a key.
    """
    p = np.diag(both) / max(1, n)
    rare = np.minimum(p, 1 - p)
    agree = p * p + (1 - p) * (1 - p)
    out = np.zeros((len(groups), distance + 2))
    for g, bits in enumerate(groups):
        within = np.zeros(distance + 1)  # chance of exactly t differing bits
        within[0] = 1.0
        probes = within.copy()  # ways to choose exactly t bits of rarer values
        for b in bits:
            probes[1:] += probes[:-1] * rare[b]
            within[1:] = within[1:] * agree[b] + within[:-1] * (1 - agree[b])
            within[0] *= agree[b]
        for t in range(distance + 1):
            pairs, rows = same.get(g, (0.0, 0))
            made = n * probes[: t + 1].sum()
            shared = min(2 * pairs * within[: t + 1].sum() / max(within[0], 1e-300), made) if t else rows
            out[g, t + 1] = made + (distance + 2) * shared
    return out


def allocate(estimates: np.ndarray, distance: int) -> tuple[float, list[int]]:
    """A threshold per group, -1 for an unused one, of the least ``estimates`` in sum; that sum goes before.

    With thresholds t_i that sum up to distance - groups + 1, two fingerprints at most ``distance`` apart differ in at
    most t_i bits in some group i: if all differed in t_i + 1 or more, they would differ in distance + 1 or more.
    """
    need = distance + 1  # sum of t_i + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in estimates:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for step in range(need - used + 1):
                to = (cost + row[step], [*chosen, step - 1])
                if used + step not in following or to[0] < following[used + step][0]:
                    following[used + step] = to
        best = following
    return best[need]


def shared_whole(fps: DataFrame, groups: list[list[int]]) -> dict[int, tuple[float, int]]:
    """For each group, the pairs of fingerprints that agree in all of its bits, and the fingerprints in such pairs; one
    pass, sums per key. Groups without any are left out."""
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(mask_of(bits))) for bits in groups))).alias("g", "key")
    per = fps.select(keys).groupBy("g", "key").agg(F.count("*").alias("n"))
    found = per.where(F.col("n") > 1).groupBy("g").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs"), F.sum("n").alias("rows"))
    return {r["g"]: (r["pairs"], r["rows"]) for r in found.collect()}


def search_plan(fps: DataFrame, distance: int) -> tuple[list[tuple[list[int], int]], int, np.ndarray]:
    """The groups to probe with their thresholds, of the least estimated rows over all numbers of groups from 2
    (or 1, for distance 0) to distance + 1; so groups get wider as fingerprints get more. Also the bit statistics."""
    n, both = bit_statistics(fps)
    options = [correlated_groups(n, both, m) for m in range(min(2, distance + 1), distance + 2)]
    same = shared_whole(fps, [bits for groups in options for bits in groups])
    plans, low = [], 0
    for groups in options:
        own = {g: same[low + g] for g in range(len(groups)) if low + g in same}
        low += len(groups)
        cost, thresholds = allocate(row_estimates(own, n, both, groups, distance), distance)
        plans.append((cost, [(bits, t) for bits, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1], n, both


def probe_keys(fps: DataFrame, plan: list[tuple[list[int], int]], common: int) -> DataFrame:
    """(fp, id, g, key, flips, left): each probed group's bits in the fingerprint, and those with up to a threshold
    flipped, of the bits whose value isn't that in ``common``; so many are flipped, and so many more might be.

    Where two fingerprints differ, just one has the value in ``common``. If each flips those in which it hasn't, both
    get one key, and their flips together are the bits in which they differ. With the commoner values in ``common``, a
    fingerprint in a crowd around one value has few bits to flip.
    """
    probes = [(g, mask_of(bits), mask_of(flip), k, most - k) for g, (bits, most) in enumerate(plan) for k in range(most + 1) for flip in combinations(bits, k)]
    rare = F.col("fp").bitwiseXOR(F.lit(common))
    keys = (
        F.when(
            rare.bitwiseAND(F.lit(f)) == f,
            F.struct(F.lit(g).alias("g"), F.col("fp").bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(f)).alias("key"), F.lit(k).alias("flips"), F.lit(left).alias("left")),
        )
        for g, m, f, k, left in probes
    )
    return fps.select("fp", "id", F.explode(F.array_compact(F.array(*keys))).alias("x")).select("fp", "id", "x.*")


def rest_keys(shared: DataFrame, plan: list[tuple[list[int], int]], n: int, both: np.ndarray, distance: int) -> DataFrame:
    """``shared`` with r and rest: a second pigeonhole within each key, over the bits outside its group in distance + 1
    groups, so that one of them agrees as a whole."""
    outside = [correlated_groups(n, both, distance + 1, [b for b in range(BITS) if b not in set(bits)]) for bits, _ in plan]
    masks = F.element_at(F.array(*(F.array(*(F.lit(mask_of(b)) for b in own)) for own in outside)), F.col("g") + 1)
    return shared.select("*", F.posexplode(masks).alias("r", "mask")).withColumn("rest", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")


def sharing(keyed: DataFrame, *by: str) -> DataFrame:
    """The rows whose key ``by`` another row has too, and whose flips some row of that key leaves room for. A key has
    one row on the right, so no more rows come out than go in."""
    per = keyed.groupBy(*by).agg(F.count("*").alias("n"), F.max("left").alias("most")).where(F.col("n") > 1).drop("n")
    return keyed.join(per, list(by)).where(F.col("flips") <= F.col("most")).drop("most")


def half_way_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between ids of ``fps`` (fp, id) that connect just what lies within ``distance``, without pairs.

    Two fingerprints lie within ``distance`` if and only if some value lies within its half, rounded down, of one and
    its half rounded up of the other. Each goes to all such values, and all at a value link to the smallest id among
    those that are within the lesser half of it. A value has no more fingerprints than there are values around one (65
    for a distance of 2), so the work is linear in the fingerprints, however many of them crowd together.
    """
    less, more = distance // 2, distance - distance // 2
    flips = [(mask_of(f), k <= less) for k in range(more + 1) for f in combinations(range(BITS), k)]
    around = F.array(*(F.struct(F.lit(m).alias("flip"), F.lit(near).alias("near")) for m, near in flips))
    at = fps.select("fp", "id", F.explode(around).alias("x")).select(F.col("fp").bitwiseXOR(F.col("x.flip")).alias("value"), "id", "x.near")
    met = at.groupBy("value").agg(F.min(F.when(F.col("near"), F.col("id"))).alias("a"), F.collect_list("id").alias("ids"))
    return met.where(F.col("a").isNotNull() & (F.size("ids") > 1)).select("a", F.explode("ids").alias("b")).where(F.col("a") != F.col("b")).distinct()


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between ids of distinct fingerprints ``fps`` (fp, id) that connect all that differ in ``distance``
    bits at most, and none that don't.

    Probes by :func:`search_plan` leave the fingerprints that share a key, a second pigeonhole within each key those
    that also agree in a part of their other bits; what is left is verified by :func:`half_way_links`. No step makes
    pairs of a key's members.
    """
    plan, n, both = search_plan(fps, distance)
    common = mask_of(np.flatnonzero(2 * np.diag(both) > n).tolist())
    shared, _ = cut(sharing(probe_keys(fps, plan, common), "g", "key"), "probes")
    found = sharing(rest_keys(shared, plan, n, both, distance), "g", "key", "r", "rest")
    return half_way_links(found.select("fp", "id").distinct(), distance)


@owning
def near_duplicates(docs: DataFrame, *, words: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable by links, itself included) of each row of ``docs``.

    Documents link if their fingerprints differ in at most ``distance`` bits. A null or wordless text has fingerprint
    zero and links like any other. Rows with one doc_id each give a row. A null doc_id gives a row too, and never is a
    component_id unless no other doc_id has its fingerprint. No rows give none. Extra columns are not read. Equal
    fingerprints are one node; only distinct ones are searched. doc_id is a whole number, and component_id a long.
    """
    prints, _ = cut(fingerprints(docs, words=words, seed=seed), "fingerprints")
    nodes, nodes_path = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    reached = components(links(nodes.where(F.col("id").isNotNull()), distance))
    labelled, _ = cut(nodes.join(reached.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id")), "labels")
    discard(docs.sparkSession, nodes_path)
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, fingerprint, component_id."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
