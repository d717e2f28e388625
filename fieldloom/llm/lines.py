"""Line dedup: lines found in many documents go, except in one of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.names import fresh
from fieldloom.sessions import cut

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z lower-cased (``bytes`` methods touch ASCII only)."""
    return line.strip(b" \t\n\r\x0b\x0c").lower()


def line_digests(text: str | None, min_chars: int) -> list[bytes | None]:
    """128-bit digest of each line's key; None where the key has under ``min_chars`` code points."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line_key(line)
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def drop_common_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` (doc_id, text, more) with text reduced, and n_lines and n_dropped (long).

    A text is split at \\n; null or empty is one empty line. Keys of at least ``min_chars`` code points that occur in
    at least ``min_docs`` documents lose all their lines except in the largest doc_id that holds them. The other lines
    keep their place, joined by \\n. Every row is a document: rows with one doc_id count apart, and the largest doc_id
    keeps its lines in all its rows. A row with a null doc_id is kept as it is and counts for nothing. A null text
    becomes the empty text. Empty input gives empty output. Columns named n_lines or n_dropped are replaced; other
    columns stay.

    A document sends each key once, as a digest, and counts are summed before the shuffle, so that a line that every
    document holds is a few rows. Lost lines go back to their documents by a join that AQE can split, grouped by
    document, which loses no more lines than it has.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            digests: list[bytes] = []
            for i, text in enumerate(batch.column(1)):
                own = {d for d in line_digests(text.as_py(), min_chars) if d is not None}
                digests += own
                at += [i] * len(own)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(digests, pa.binary())], names=["doc_id", "digest"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    held = known.mapInArrow(keys, f"doc_id {id_type}, digest binary")
    common = held.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("stays")).where(F.col("n") >= min_docs)
    common, _ = cut(common.drop("n"), "common")  # a table of its own, so that the join below sees its size and can be split
    lost = held.join(common, "digest").where(F.col("doc_id") != F.col("stays"))
    plain = docs.drop("n_lines", "n_dropped")
    name = fresh(plain, "lost")["lost"]
    lost = lost.groupBy("doc_id").agg(F.collect_set("digest").alias(name))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields] + ["n_lines long", "n_dropped long"]
    names = [*plain.columns, "n_lines", "n_dropped"]
    place = names.index("text")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True):
                raw, gone = text.as_py() or "", gone.as_py()
                if gone:
                    gone = set(gone)
                    lines = raw.split("\n")
                    stay = [x for x, d in zip(lines, line_digests(raw, min_chars), strict=True) if d not in gone]
                    texts.append("\n".join(stay))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                else:
                    texts.append(raw)
                    n_lines.append(raw.count("\n") + 1)
                    n_dropped.append(0)
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, pa.string())
            yield pa.record_batch([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=names)

    return plain.join(lost, "doc_id", "left").select(*plain.columns, name).mapInArrow(reduce, ", ".join(fields))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM parts
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM numbered
), common AS (
  SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.stays AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
