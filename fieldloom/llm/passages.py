"""Substring dedup: passages repeated in other documents, found by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sessions import cut, discard

WINDOW = 50
PERIOD = 31
#: A difference set modulo 31. Every residue is the difference of two of them.
COVER = (1, 5, 11, 24, 25, 27)
#: Words of an anchor: any window holds one at every shift below the period.
ANCHOR = WINDOW - PERIOD + 1
#: Words whose hashes a worker remembers before it starts anew.
REMEMBERED_WORDS = 1_000_000

BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
EMPTY_SHA = hashlib.sha256(b"").digest()


class WordHashes(dict):
    """A number for each word, and its two 64-bit hashes by number."""

    def __init__(self) -> None:
        super().__init__()
        self.raw = bytearray()
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.raw += xxhash.xxh3_128_digest(word)
        return n

    def lanes(self, words: list[bytes]) -> np.ndarray:
        """The hashes of each word, as two columns."""
        if len(self) > REMEMBERED_WORDS:
            self.clear()
            self.raw = bytearray()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return np.frombuffer(self.raw, dtype="<u8").reshape(-1, 2)[at]

    def rolling(self, lane: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
        """A hash of the ``size`` words from each start: their hashes times rising powers of an odd base, modulo 2^64."""
        n = len(lane)
        if len(self.powers) <= n:
            self.powers, self.inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, x, dtype=np.uint64)]), dtype=np.uint64) for x in (BASE, INVERSE))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(lane * self.powers[:n], dtype=np.uint64)])
        # times the start's inverse power, so that equal windows are equal wherever they stand
        return (sums[starts + size] - sums[starts]) * self.inverse[starts]


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode().split()


def anchor_starts(n: int) -> np.ndarray:
    """Positions in the cover modulo the period from which an anchor fits into ``n`` words."""
    at = np.arange(max(0, n - ANCHOR + 1))
    return at[np.isin(at % PERIOD, COVER)]


def anchors(hashes: WordHashes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each anchor of a text long enough to hold a window."""
    if len(words) < WINDOW:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    starts = anchor_starts(len(words))
    return starts, hashes.rolling(hashes.lanes(words)[:, 0], ANCHOR, starts)


def summaries(docs: DataFrame, kind: str) -> DataFrame:
    """(doc_id, part, n_words, h1, h2, sha): a text's words in number, in a digest of 128 bits, and in SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, n, digests, sha = [], [], [], []
            for text in batch.column(1):
                words = split(text.as_py())
                joined = b" ".join(words)
                part.append(part_of(words))
                n.append(len(words))
                digests.append(xxhash.xxh3_128_digest(joined))
                sha.append(hashlib.sha256(joined).digest())
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.record_batch([batch.column(0), pa.array(part, pa.int32()), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sha, pa.binary())], names=["doc_id", "part", "n_words", "h1", "h2", "sha"])

    return docs.mapInArrow(run, f"doc_id {kind}, part int, n_words long, h1 long, h2 long, sha binary")


def anchor_documents(docs: DataFrame) -> DataFrame:
    """(h, n): anchors and in how many documents of a part of the input they stand, 2 for more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            own = [np.unique(anchors(hashes, split(t.as_py()))[1]) for t in batch.column(1)]
            h, n = np.unique(np.concatenate(own) if own else np.zeros(0, dtype=np.uint64), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["h", "n"])

    return docs.mapInArrow(run, "h long, n int")


def document_anchors(docs: DataFrame, kind: str) -> DataFrame:
    """(doc_id, h): the anchors of each document, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            own = [np.unique(anchors(hashes, split(t.as_py()))[1]) for t in batch.column(1)]
            at = np.repeat(np.arange(len(own)), [len(x) for x in own])
            h = np.concatenate(own) if own else np.zeros(0, dtype=np.uint64)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(h.view(np.int64))], names=["doc_id", "h"])

    return docs.mapInArrow(run, f"doc_id {kind}, h long")


def part_of(words: list[bytes]) -> int:
    """Tells apart texts that share a doc_id."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) & 0x7FFFFFFF


def candidate_windows(work: DataFrame, kind: str) -> DataFrame:
    """(w1, w2, doc_id, part, start): the windows around each shared anchor of ``work`` (doc_id, text, shared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                at, part, start, w1, w2 = [], [], [], [], []
                for i in range(low, min(batch.num_rows, low + 64)):
                    words = split(batch.column(1)[i].as_py())
                    begins, h = anchors(hashes, words)
                    shared = batch.column(2)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    edge = np.zeros(len(words) + PERIOD + 2, dtype=np.int32)
                    hit = begins[np.isin(h, shared)]
                    np.add.at(edge, np.maximum(0, hit - (WINDOW - ANCHOR)), 1)
                    np.add.at(edge, hit + 1, -1)
                    s = np.nonzero(np.cumsum(edge)[: max(0, len(words) - WINDOW + 1)])[0]
                    lanes = hashes.lanes(words)
                    w1.append(hashes.rolling(lanes[:, 0], WINDOW, s))
                    w2.append(hashes.rolling(lanes[:, 1], WINDOW, s))
                    at.append(np.full(len(s), i))
                    part.append(np.full(len(s), part_of(words), dtype=np.int32))
                    start.append(s.astype(np.int32))
                columns = [pa.array(np.concatenate(w1).view(np.int64)), pa.array(np.concatenate(w2).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(at)))]
                yield pa.record_batch([*columns, pa.array(np.concatenate(part)), pa.array(np.concatenate(start))], names=["w1", "w2", "doc_id", "part", "start"])

    return work.select("doc_id", "text", "shared").mapInArrow(run, f"w1 long, w2 long, doc_id {kind}, part int, start int")


def covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Mask of the words that windows from ``starts`` cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:n]) > 0


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha, spans) for every row of ``docs`` (doc_id, text).

    A window is 50 words in a row; a word goes if a window that covers it also starts in a document with a smaller
    doc_id, judged on the input. ``spans`` are the (start, end) of words that go, ``kept_sha`` the SHA-256 of those that
    stay, joined by one space. A null text has no words, and texts under 50 words lose none. Rows with one doc_id are
    one document where windows are compared and are cut each for itself. A row with a null doc_id loses nothing and
    takes nothing. No rows give none.

    Texts with the same words are settled by their digest: all but the smallest doc_id go whole, and only that one is
    searched. Two equal windows share an anchor at some shift below the period where both stand in the cover, so only
    windows around anchors that several documents hold are hashed whole, in 128 bits, and grouped to their smallest
    doc_id. All groupings are sums or minima with partial results before the shuffle; a passage in every document is a
    few rows there, and joins back can be split. Lists are collected per document only, no longer than the document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text")
    known = slim.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sums, _ = cut(summaries(slim, kind), "summaries")
    reps, _ = cut(sums.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull()).groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "reps")
    state = sums.join(reps, ["h1", "h2"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False)))
    shared, shared_path = cut(anchor_documents(known).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("h"), "anchors")
    hits = document_anchors(known, kind).join(shared, "h").groupBy("doc_id").agg(F.collect_set("h").alias("shared"))
    hits, hits_path = cut(hits.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "hits")
    work, _ = cut(known.join(hits, "doc_id"), "work")
    for path in (shared_path, hits_path):
        discard(spark, path)
    windows = candidate_windows(work, kind)
    least, least_path = cut(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where(F.col("least") < F.col("most")).drop("most"), "least")
    starts = windows.join(least, ["w1", "w2"]).where(F.col("doc_id") > F.col("least")).groupBy("doc_id", "part").agg(F.collect_set("start").alias("starts"))
    starts, _ = cut(starts, "starts")
    discard(spark, least_path)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, part, removed, sha, spans = [], [], [], [], []
            for i, (text, own, found) in enumerate(zip(*batch.columns[1:4], strict=True)):
                words = split(text.as_py())
                if part_of(words) != own.as_py():
                    continue
                mask = covered(len(words), found.values.to_numpy(zero_copy_only=False).astype(np.int64))
                turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                at.append(i)
                part.append(own.as_py())
                removed.append(int(mask.sum()))
                sha.append(hashlib.sha256(b" ".join(w for w, m in zip(words, mask, strict=True) if not m)).digest())
                spans.append([{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)])
            yield pa.record_batch(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(part, pa.int32()), pa.array(removed, pa.int64()), pa.array(sha, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "part", "removed", "cut_sha", "cut_spans"],
            )

    cuts = work.join(starts, "doc_id").select("doc_id", "text", "part", "starts").mapInArrow(remove, f"doc_id {kind}, part int, removed long, cut_sha binary, cut_spans array<struct<start: long, end: long>>")
    cuts = cuts.dropDuplicates(["doc_id", "part"])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    none = F.array().cast("array<struct<start: long, end: long>>")
    joined = state.join(cuts, ["doc_id", "part"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("cut_spans", none)).alias("spans"),
    )


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` (doc_id unique, text, more) with each text reduced to the words outside ``passages`` (doc_id, spans)."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    kept = F.filter(words, lambda w, i: ~F.exists("_pg_spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    found = docs.join(passages.select("doc_id", F.col("spans").alias("_pg_spans")), "doc_id")
    return found.withColumn("text", F.array_join(kept, " ")).select(*docs.columns)


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, n_words, n_removed, kept_sha256."""
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha")).alias("kept_sha256"))


#: Windows are compared by a digest of their words; a word goes if one that starts up to 49 words before it goes.
OP2_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place, len(words) AS n FROM split
), windows AS (
  SELECT doc_id, place, n, word,
         CASE WHEN place + 50 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS digest
  FROM placed
), least AS (
  SELECT digest, min(doc_id) AS least FROM windows WHERE digest IS NOT NULL GROUP BY digest
), judged AS (
  SELECT w.doc_id, w.place, w.word,
         coalesce(max(CASE WHEN w.doc_id > l.least THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM windows w LEFT JOIN least l USING (digest)
), told AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (WHERE gone = 0), '') AS kept FROM judged GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN told USING (doc_id)
"""
