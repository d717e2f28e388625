"""Alignment of two tokenizers' tokens of the same texts, on Arrow arrays, with counts of linked ids over all documents.

Both tokenizers cut the bytes of a text into ranges. Where a range of each ends at the same byte, a group ends. Two
tokens are linked where their ranges overlap. Per batch all of this is done by Arrow kernels on flattened lists (list
flatten, parent indices, cumulative sums cut at documents, a hash join on document and end, grouped counts); Spark
merges the batches' counts and joins them back to the documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.packing import byte_letters
from fieldloom.sessions import cut

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Bytes of text that are aligned together.
SLICE_BYTES = 1 << 20
#: Rows of counts that a worker gathers before it hands them on.
HELD_COUNTS = 400_000
#: Pairs of ids with at least this fraction of all links are looked up in a broadcast; there can't be more of them than
#: its inverse. All others are joined, and no key of that join can then be hot.
FREQUENT = 400_000

Encoder = Callable[[list[str]], list[list[int]]]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Tokens:
    """A vocabulary as arrays by id, and what turns texts into ids."""

    encode: Encoder
    octets: pa.Array
    digits: pa.Array
    lengths: pa.Array

    @staticmethod
    def of(encode: Encoder, octets: list[bytes]) -> Tokens:
        return Tokens(encode, pa.array(octets, pa.binary()), pa.array([str(k) for k in range(len(octets))], pa.string()), pa.array([len(x) for x in octets], pa.int64()))


def byte_level(path: str) -> Tokens:
    """Byte-level BPE of space and text. Where the ids follow the merges, its ranks are all there is to know, and a
    quicker library walks them to the same ids; any other file is left to the library that it was written for."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    octet = {letter: b for b, letter in byte_letters().items()}
    vocabulary = {bytes(octet[c] for c in token): k for token, k in whole["model"]["vocab"].items()}
    octets = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        octets[k] = token
    merged = [whole["model"]["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in whole["model"]["merges"]]
    plain = whole.get("normalizer") is None and (whole.get("pre_tokenizer") or {}) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and None not in merged and all(a < b for a, b in zip(merged, merged[1:], strict=False)) and len(vocabulary) == len(merged) + 256:
        import public_tokenizers
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        return Tokens.of(lambda texts: [own.encode_ordinary(f" {t}") for t in texts], octets)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return Tokens.of(lambda texts: [model.encode(f" {t}", add_special_tokens=False).ids for t in texts], octets)


def pieces(path: str) -> Tokens:
    """Pieces of a text, which the model puts a space before; the bytes that it falls back on stand for themselves."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    octets = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else b"" if model.is_control(k) else p.replace("▁", " ").encode() for k, p in enumerate(model.id_to_piece(list(range(len(model)))))]
    return Tokens.of(lambda texts: model.encode(texts, num_threads=1), octets)


def lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.fromiter((k for row in rows for k in row), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def spelled(ids: pa.ListArray, tokens: Tokens) -> pa.Array:
    """The bytes of each list's tokens, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pc.take(tokens.octets, pc.list_flatten(ids))), b"")


def tokenised(texts: list[str | None], a: Tokens, b: Tokens) -> tuple[pa.ListArray, pa.ListArray]:
    """Ids by both; no ids for texts that are null or empty or that either tokenizer doesn't spell to the byte."""
    known = [t or "" for t in texts]
    meant = pa.array([f" {t}".encode() if t else None for t in known], pa.binary())
    ids = [lists(t.encode(known)) for t in (a, b)]
    faithful = pc.fill_null(pc.and_(*(pc.equal(spelled(x, t), meant) for x, t in zip(ids, (a, b), strict=True))), False)
    if pc.all(faithful).as_py():
        return ids[0], ids[1]
    rows = [[own if ok else [] for own, ok in zip(x.to_pylist(), faithful.to_pylist(), strict=True)] for x in ids]
    return lists(rows[0]), lists(rows[1])


@dataclass
class Flat:
    """Tokens of a batch one after the other: ids, documents, ends within the document and within the batch."""

    ids: pa.Array
    docs: pa.Array
    ends: pa.Array
    reached: np.ndarray

    @staticmethod
    def of(rows: pa.ListArray, tokens: Tokens) -> Flat:
        ids, docs = pc.list_flatten(rows), pc.list_parent_indices(rows)
        reached = pc.cumulative_sum(pc.take(tokens.lengths, ids))
        before = pa.concat_arrays([pa.array([0], pa.int64()), reached])
        return Flat(ids, docs, pc.subtract(reached, pc.take(before, pc.take(rows.offsets, docs))), reached.to_numpy())


@dataclass
class Aligned:
    """Groups and links of a batch. ``a_to`` and ``b_to``: where each group's tokens end among all of the batch's."""

    a: Flat
    b: Flat
    a_to: np.ndarray
    b_to: np.ndarray
    link_docs: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def aligned(a_rows: pa.ListArray, b_rows: pa.ListArray, a_tokens: Tokens, b_tokens: Tokens) -> Aligned:
    """Each list of ``a_rows`` must spell the bytes that the same list of ``b_rows`` does."""
    a, b = Flat.of(a_rows, a_tokens), Flat.of(b_rows, b_tokens)
    left = pa.table({"doc": a.docs, "end": a.ends, "a_at": pa.array(np.arange(len(a.ids)))})
    right = pa.table({"doc": b.docs, "end": b.ends, "b_at": pa.array(np.arange(len(b.ids)))})
    both = left.join(right, keys=["doc", "end"], join_type="inner", use_threads=False).sort_by("a_at")
    a_last, b_last = both["a_at"].to_numpy(), both["b_at"].to_numpy()
    # a stretch between two neighbouring ends of either kind is one link: that of the tokens that hold it
    only_b = np.ones(len(b.ids), dtype=bool)
    only_b[b_last] = False
    only_b = np.flatnonzero(only_b)
    at_a = np.concatenate([np.arange(len(a.ids)), np.searchsorted(a.reached, b.reached[only_b])])
    at_b = np.concatenate([np.searchsorted(b.reached, a.reached), only_b])
    return Aligned(a, b, a_last + 1, b_last + 1, a.docs.to_numpy()[at_a], a.ids.to_numpy()[at_a], b.ids.to_numpy()[at_b])


def digests(found: Aligned, n_docs: int, a_tokens: Tokens, b_tokens: Tokens) -> tuple[np.ndarray, list[str]]:
    """Per document the number of groups and the SHA-256 of ``a1,a2|b1;a3|b2,b3``; nothing to hash gives ''."""

    def joined(to: np.ndarray, flat: Flat, tokens: Tokens) -> pa.Array:
        offsets = pa.array(np.concatenate([[0], to]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.take(tokens.digits, flat.ids)), ",")

    groups = pc.binary_join_element_wise(joined(found.a_to, found.a, a_tokens), joined(found.b_to, found.b, b_tokens), "|")
    docs = found.a.docs.to_numpy()[found.a_to - 1]
    offsets = np.searchsorted(docs, np.arange(n_docs + 1)).astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), groups), ";")
    return np.diff(offsets), [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts.to_pylist()]


def pair_counts(tables: list[pa.Table]) -> pa.Table:
    """(a, b, n) of tables of the same columns, each pair once."""
    return pa.concat_tables(tables).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])


def sliced(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` in sum; a larger row is a run by itself."""
    low = 0
    total = 0
    for k, size in enumerate(sizes):
        if k > low and total + size > most:
            yield low, k
            low, total = k, 0
        total += size
    if len(sizes) > low:
        yield low, len(sizes)


class Loaded:
    """Both vocabularies, read once by each worker that asks for them."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.paths = (a_path, b_path)

    def get(self) -> tuple[Tokens, Tokens]:
        held = _LOADED.get(self.paths)
        if held is None:
            held = _LOADED[self.paths] = (byte_level(self.paths[0]), pieces(self.paths[1]))
        return held


_LOADED: dict[tuple[str, str], tuple[Tokens, Tokens]] = {}
_STATS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def packed_ids(rows: pa.ListArray, kind: str) -> pa.Array:
    values, offsets = rows.values.to_numpy().astype(kind), rows.offsets.to_numpy()
    return pa.array([values[s:e].tobytes() for s, e in zip(offsets, offsets[1:], strict=False)], pa.binary())


def unpacked_ids(packed: pa.Array, kind: str) -> pa.ListArray:
    each = packed.to_pylist()
    ends = np.cumsum([0, *(len(x) for x in each)]) // np.dtype(kind).itemsize
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(each), kind).astype(np.int32)))


def encoded(docs: DataFrame, loaded: Loaded, key: str, column: str) -> DataFrame:
    """Rows of two kinds: documents with their ids, groups and digests (row is not null), and counts of pairs (a, b, n)."""
    stats = [x.split()[0] for x in _STATS.split(", ")]
    schema = pa.schema([*((x, pa.string() if x == "groups_sha256" else pa.int64()) for x in stats), ("ids_a", pa.binary()), ("ids_b", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def counts(tables: list[pa.Table]) -> pa.RecordBatch:
        whole = pair_counts(tables).combine_chunks()
        own = [pa.nulls(whole.num_rows, f.type) for f in schema][:-3]
        return pa.record_batch([*own, *(whole[c].combine_chunks() if whole.num_rows else pa.array([], schema.field(c).type) for c in ("a", "b", "n"))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_tokens, b_tokens = loaded.get()
        row = TaskContext.get().partitionId() << 33
        held: list[pa.Table] = []
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for low, high in sliced(sizes, SLICE_BYTES):
                part = batch.slice(low, high - low)
                n = part.num_rows
                a, b = tokenised(part.column(1).to_pylist(), a_tokens, b_tokens)
                found = aligned(a, b, a_tokens, b_tokens)
                n_groups, hashed = digests(found, n, a_tokens, b_tokens)
                n_links = np.bincount(found.link_docs, minlength=n)
                numbers = [np.arange(row, row + n), np.diff(a.offsets.to_numpy()), np.diff(b.offsets.to_numpy()), n_groups, n_links]
                numbers = [pa.array(x.astype(np.int64)) for x in numbers]
                row += n
                own = [numbers[0], part.column(0), *numbers[1:], pa.array(hashed, pa.string()), packed_ids(a, "<u4" if len(a_tokens.octets) > 65536 else "<u2"), packed_ids(b, "<u4" if len(b_tokens.octets) > 65536 else "<u2")]
                yield pa.record_batch([*own, *(pa.nulls(n, schema.field(c).type) for c in ("a", "b", "n"))], schema=schema)
                held.append(pair_counts([pa.table({"a": found.link_a, "b": found.link_b, "n": np.ones(len(found.link_a), dtype=np.int64)})]))
                if sum(t.num_rows for t in held) > HELD_COUNTS:
                    yield counts(held)
                    held = []
        if held:
            yield counts(held)

    return docs.select(F.col(key).cast("long"), F.col(column).cast("string")).mapInArrow(run, f"{_STATS}, ids_a binary, ids_b binary, a int, b int, n long")


@dataclass
class Frequent:
    """Counts of the frequent pairs, and whether each is its B id's highest; sorted by ``a << 32 | b``."""

    keys: np.ndarray
    n: np.ndarray
    best: np.ndarray


def looked_up(documents: DataFrame, loaded: Loaded, frequent: Frequent) -> DataFrame:
    """(row, a, b, times, count_sum, n_best) of (row, ids_a, ids_b): one row of the sums over a document's frequent pairs,
    whose a and b are below zero and spread, and one row for each other pair of the document, with its links."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)
    names = ["row", "a", "b", "times", "count_sum", "n_best"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_tokens, b_tokens = loaded.get()
        own = shared.value
        keys = pa.array(own.keys)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for low, high in sliced(sizes, SLICE_BYTES):
                part = batch.slice(low, high - low)
                rows = part.column(0).to_numpy()
                a, b = (unpacked_ids(part.column(k), "<u4" if len(t.octets) > 65536 else "<u2") for k, t in ((1, a_tokens), (2, b_tokens)))
                found = aligned(a, b, a_tokens, b_tokens)
                at = pc.index_in(pa.array((found.link_a.astype(np.int64) << 32) | found.link_b), keys)
                known = pc.is_valid(at).to_numpy(zero_copy_only=False)
                at = pc.drop_null(at).to_numpy()
                sums = pa.table({"doc": found.link_docs[known], "n": own.n[at], "best": own.best[at].astype(np.int64)}).group_by("doc", use_threads=False).aggregate([("n", "sum"), ("best", "sum")])
                total, best = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
                total[sums["doc"].to_numpy()] = sums["n_sum"].to_numpy()
                best[sums["doc"].to_numpy()] = sums["best_sum"].to_numpy()
                spread = (-1 - rows % 65_536).astype(np.int32)
                yield pa.record_batch([pa.array(x, k) for x, k in zip((rows, spread, spread, np.zeros_like(rows), total, best), kinds, strict=True)], names=names)
                if not known.all():
                    rest = pa.table({"doc": found.link_docs[~known], "a": found.link_a[~known], "b": found.link_b[~known]})
                    rest = rest.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")])
                    zero = np.zeros(rest.num_rows, dtype=np.int64)
                    columns = (rows[rest["doc"].to_numpy()], rest["a"].to_numpy(), rest["b"].to_numpy(), rest["count_all"].to_numpy(), zero, zero)
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return documents.mapInArrow(run, "row long, a int, b int, times long, count_sum long, n_best long")


def align(docs: DataFrame, *, a_path: str | None = None, b_path: str | None = None, key: str = "doc_id", column: str = "text", frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` its tokens, groups and links by both tokenizers, and the linked pairs of ids over all rows.

    The first result: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the commonest of its B id, ties
    included), count_sum (over links, how many links of all rows hold the same pair), groups_sha256. The second: a, b, n,
    best. Null and empty texts, and those that a tokenizer doesn't spell to the byte, have zeros and ''. Rows that share
    a key, or have none, are rows of their own; other columns aren't read. An empty table gives none.
    """
    loaded = Loaded(a_path or default_path(BYTE_LEVEL), b_path or default_path(PIECES))
    work, _ = cut(encoded(docs, loaded, key, column), "aligned")
    counted, _ = cut(work.where(F.col("a").isNotNull()).groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    commonest = counted.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of one vocabulary at most
    pairs = counted.join(F.broadcast(commonest), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = pairs.where(F.col("n") >= max(1, -(-total // frequent))).select(((F.col("a").cast("long") * F.lit(1 << 32)) + F.col("b")).alias("k"), "n", "best").toArrow().sort_by("k")
    table = Frequent(often["k"].to_numpy(), often["n"].to_numpy(), often["best"].to_numpy())
    stats = work.where(F.col("row").isNotNull())
    found = looked_up(stats.select("row", "ids_a", "ids_b"), loaded, table)
    joined = found.join(pairs.select("a", "b", "n", "best"), ["a", "b"], "left")
    linked = F.coalesce(F.col("times") * F.col("n"), F.lit(0))
    sums = joined.groupBy("row").agg(F.sum(F.col("count_sum") + linked).alias("count_sum"), F.sum(F.col("n_best") + F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    result = stats.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row")
    return result.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), pairs


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
