"""Near copies by the similarity of their word shingles: fingerprints and banded min-hashes propose, shingles decide."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import simhash
from fieldloom.llm.components import components
from fieldloom.llm.joins import small_side
from fieldloom.sessions import cut, discard, owning

SHINGLE = 5
#: Texts are near copies from this share of common shingles on (of all that either has), as a fraction.
LEAST = (4, 5)
SEED = 42
#: Texts that agree in all min-hashes of a band are compared: at a similarity of 0.8, all but 0.672 ** 30 = 0.000007 are.
BANDS, ROWS = 30, 5
#: One bit of each of so many min-hashes is kept. Two of them differ with half the chance that the min-hashes do: at a
#: similarity of 0.8, in 51 bits on average (deviation 6.8), and in over 78 with a chance of 0.00004.
SKETCH, SKETCH_APART = 512, 78
#: Bits in which fingerprints of five-word shingles differ at most to be compared.
DISTANCE = 2
#: All pairs left are compared once they are no more than so many for each entry of a bucket, or after so many rounds.
PAIRS_AN_ENTRY, ROUNDS = 4, 2
#: Shingles min-hashed at once.
BLOCK = 256

_rng = np.random.default_rng(SEED)
FLIPS = _rng.integers(0, 1 << 32, (SKETCH, 1), dtype=np.uint32)
FACTORS = _rng.integers(0, 1 << 32, (SKETCH, 1), dtype=np.uint32) | np.uint32(1)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def shingles(found: list[bytes], words: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of runs of ``words`` words; a shorter text is one run, one without words has none."""
    if not found:
        return np.zeros(0, dtype="<u8")
    runs = map(b" ".join, zip(*(islice(found, k, None) for k in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), dtype="<u8"))


def sketch(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """A key for each band, and the last bit of each min-hash, 64 to a number; all as signed longs. No shingles: none."""
    if not len(hashes):
        return [], []
    least = np.full(SKETCH, np.iinfo(np.uint32).max, dtype=np.uint32)
    own = hashes.astype(np.uint32)
    for low in range(0, len(own), BLOCK):
        np.minimum(least, ((own[low : low + BLOCK] ^ FLIPS) * FACTORS).min(axis=1), out=least)
    raw = least.tobytes()
    width = 4 * ROWS
    keys = [xxhash.xxh64_intdigest(raw[k * width : (k + 1) * width], k) for k in range(BANDS)]
    bits = np.packbits((least & np.uint32(1)).astype(np.uint8), bitorder="little").view("<i8")
    return np.array(keys, dtype="<u8").view("<i8").tolist(), bits.tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, words (128-bit digest of the text's words), size (distinct shingles), fp (their SimHash), keys and bits
    (:func:`sketch`) of each row of ``docs``."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, fps, keys, bits = [], [], [], [], []
            for t in batch.column(1):
                found = words_of(t.as_py())
                hashes = shingles(found)
                digests.append(xxhash.xxh3_128_digest(b" ".join(found)))
                sizes.append(len(hashes))
                fps.append(simhash.simhash(hashes))
                own = sketch(hashes)
                keys.append(own[0])
                bits.append(own[1])
            longs = pa.list_(pa.int64())
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, dtype="<u8").view("<i8")), pa.array(keys, longs), pa.array(bits, longs)]
            yield pa.record_batch(columns, names=["doc_id", "words", "size", "fp", "keys", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sketched, f"doc_id {kind}, words binary, size long, fp long, keys array<long>, bits array<long>")


def shingled(docs: DataFrame) -> DataFrame:
    """``docs`` (words, text) to words and their distinct shingles, for the rows whose text has these words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                digests, lists = [], []
                for w, t in zip(batch.column(0).slice(low, 512).to_pylist(), batch.column(1).slice(low, 512), strict=True):
                    found = words_of(t.as_py())
                    if xxhash.xxh3_128_digest(b" ".join(found)) == w:
                        digests.append(w)
                        lists.append(shingles(found).view("<i8"))
                yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["words", "shingles"])

    return docs.select("words", "text").mapInArrow(hashed, "words binary, shingles array<long>")


def may_be_alike(a: str, b: str) -> Column:
    """Of two nodes' columns: their numbers of shingles and their sketches allow the similarity asked for."""
    top, bottom = LEAST
    sizes = (F.col(f"{a}.size") * bottom >= F.col(f"{b}.size") * top) & (F.col(f"{b}.size") * bottom >= F.col(f"{a}.size") * top)
    apart = sum((F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(SKETCH // 64)), F.lit(0))
    return sizes & (apart <= SKETCH_APART)


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Of ``pairs`` (wa, fa, wb, fb), the ends (a, b) of those similar enough by their shingles in ``bodies``."""
    top, bottom = LEAST
    sized = pairs.join(bodies.toDF("wb", "sb"), "wb").join(bodies.toDF("wa", "sa"), "wa")
    common = F.size(F.array_intersect("sa", "sb"))
    # common / (a + b - common) >= top / bottom
    return sized.where(common * (top + bottom) >= (F.size("sa") + F.size("sb")) * top).select(F.col("fa").alias("a"), F.col("fb").alias("b"))


def by_fingerprints(nodes: DataFrame) -> DataFrame:
    """Pairs (wa, fa, wb, fb) that the SimHash search links; nodes of one fingerprint meet its first."""
    prints = nodes.groupBy("fp").agg(F.min(F.struct("first", "words")).alias("m")).select("fp", F.col("m.first").alias("id"), F.col("m.words").alias("w"))
    linked = simhash.links(prints.select("fp", "id"), DISTANCE)
    across = linked.join(prints.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(prints.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    same = nodes.join(prints, "fp").where(F.col("words") != F.col("w")).select(F.col("words").alias("wa"), F.col("first").alias("fa"), F.col("w").alias("wb"), F.col("id").alias("fb"))
    return across.select("wa", F.col("a").alias("fa"), "wb", F.col("b").alias("fb")).unionByName(same)


def edges(entries: DataFrame, nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links (a, b) that connect all near copies among ``nodes`` (words, first, size, fp, bits, keys, degree) that share a key
    in ``entries`` (key, words).

    Fingerprints first; then, while pairs are many, all of a key meet one of them, the one that shares most keys with
    others, or another by lot. What gets connected needs no more comparing, so the work on a group of near copies
    around one text grows with its size, not the square. The last round compares each pair left that isn't connected
    yet and that the sketches allow, so none that shares a key is passed over.
    """
    found, path = cut(verified(by_fingerprints(nodes), bodies), "links")
    for turn in range(ROUNDS + 1):
        reached = components(found).toDF("first", "c")
        labelled, _ = cut(nodes.join(reached, "first", "left").withColumn("c", F.coalesce("c", "first")), "labelled")
        own = entries.join(labelled, "words")
        per = own.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.count("*").alias("groups"))
        live, _ = cut(per.where(F.col("groups") > 1).select("key", "n", "own"), "live")
        total = live.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
        if not total[0]:
            break
        last = turn == ROUNDS or total[1] <= PAIRS_AN_ENTRY * total[0]
        left = own.join(live.select("key"), "key").select("key", F.struct("words", "first", "size", "bits", "keys", "degree", "c").alias("a"))
        once = F.lit(True)
        if last:
            right, ordered = left.withColumnRenamed("a", "b"), F.col("a.words") < F.col("b.words")
            once = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("key")  # of all keys that a pair shares
        else:
            rank = F.struct((-F.col("a.degree") if turn == 0 else F.xxhash64(F.lit(turn), "a.words")).alias("r"), F.col("a.words").alias("w"))
            right, ordered = left.groupBy("key").agg(F.min_by("a", rank).alias("b")), F.col("a.words") != F.col("b.words")
        met = left.join(right, "key").where(ordered & (F.col("a.c") != F.col("b.c")) & may_be_alike("a", "b") & once)
        pairs, pairs_path = cut(met.select(F.col("a.words").alias("wa"), F.col("a.first").alias("fa"), F.col("b.words").alias("wb"), F.col("b.first").alias("fb")).distinct(), "pairs")
        following, following_path = cut(found.unionByName(verified(pairs, bodies)), "links")
        for gone in (path, pairs_path):
            discard(entries.sparkSession, gone)
        found, path = following, following_path
        if last:
            break
    return found


@owning
def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable by links, itself included) of each row of ``docs``.

    Documents link if they have at least four fifths of their distinct five-word shingles in common, of all that either
    has; a text of fewer words is one shingle, and texts without words are alike. Rows with one doc_id are one document.
    A null doc_id gives a row too, and never is a component_id unless no other doc_id has the same words.
    """
    spark = docs.sparkSession
    prints, _ = cut(sketches(docs), "sketches")
    unique, unique_path = cut(prints.groupBy("words").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("size", "fp", "keys", "bits"))), "nodes")
    keyed = unique.where(F.col("first").isNotNull()).select(F.explode("keys").alias("key"), "words")
    entries, entries_path = cut(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "key"), "shared")
    degrees = entries.groupBy("words").agg(F.sum("n").alias("degree"))
    nodes, nodes_path = cut(unique.join(degrees, "words"), "compared")
    bodies, bodies_path = cut(shingled(docs.select("doc_id", "text").join(small_side(nodes.select("words", F.col("first").alias("doc_id"))), "doc_id")).dropDuplicates(["words"]), "shingles")
    reached = components(edges(entries.select("key", "words"), nodes, bodies))
    labelled, _ = cut(unique.join(reached.withColumnRenamed("node", "first"), "first", "left").select("words", F.coalesce("component", "first").alias("component_id")), "labels")
    for path in (unique_path, entries_path, nodes_path, bodies_path):
        discard(spark, path)
    return prints.join(labelled, "words").select("doc_id", "component_id")
