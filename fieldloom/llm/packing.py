"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import contextlib
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.names import fresh
from fieldloom.llm.ranking import buckets_for, running
from fieldloom.sessions import cut

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers; those met first, which the common words are among.
REMEMBERED_WORDS = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: What this class expects of the tokenizer's file; with another one, words are encoded by the tokenizer alone.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Printable ASCII and Latin-1 without white space: composed already, and lower-cased by one character each.
PLAIN = re.compile(r"[!-~\u00a1-\u00ac\u00ae-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves, the others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


class PieceIds(dict):
    """Ids of lower-cased pre-tokens, as little-endian unsigned 32-bit bytes."""

    def __init__(self, model: object, letters: dict[int, str]) -> None:
        super().__init__()
        self.model, self.letters = model, letters

    def encoded(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        found = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(found)}I", *found)

    def __missing__(self, piece: str) -> bytes:
        out = self.encoded(piece)
        if len(self) < REMEMBERED_WORDS:
            self[piece] = out
        return out


class WordIds(dict):
    """Ids of words between white space, as little-endian unsigned 32-bit bytes.

    The tokenizer never joins what white space separates, so a text's ids are those of its words one after the other.
    Words met early are remembered, and so are pre-tokens, which differ less: case and punctuation are off.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pattern = None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        with contextlib.suppress(KeyError, TypeError, IndexError):
            cut, level = file["pre_tokenizer"]["pretokenizers"]
            known = [x["type"] for x in file["normalizer"]["normalizers"]] == NORMALIZERS and cut["invert"] and cut["behavior"] == "Removed" and level["type"] == "ByteLevel" and not level["use_regex"] and not level["add_prefix_space"]
            if known:
                self.pattern = regex.compile(cut["pattern"]["Regex"])
        self.pieces = PieceIds(self.tokenizer.model, byte_letters())

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.pattern is not None and PLAIN.fullmatch(text):
            text = text.lower()
            if text.isascii() and text.isalpha():  # remembered as a word, not once more as a piece
                out = self.pieces.get(text) or self.pieces.encoded(text)
            else:
                out = b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        else:
            out = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) < REMEMBERED_WORDS and len(word) < 64:
            self[word] = out
        return out

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode().split()))  # bytes split at ASCII white space only


def token_pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    A document is its text's ids (null: none) and ``end_id``; one longer than ``capacity`` is cut there, its last
    piece may be shorter. So an empty document is one piece of one id. Rows with one doc_id are documents of their own.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                at, piece, start, length, ids = [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    whole = words.ids(text.as_py()) + end
                    n = len(whole) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        at.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(min(capacity, n - s))
                        ids.append(whole[4 * s : 4 * (s + capacity)])
                columns = [part.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, piece int, start long, length long, ids binary")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins) that hold ``counts`` (length: pieces) exactly.

    A bin opens with the longest length left and takes the longest that fits until none does; then its shortest is
    replaced by the two unpacked lengths that fill the gap it leaves most tightly, if they leave less. The same bin is
    made as often as the counts allow, so the work depends on the number of lengths, not of pieces.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(capacity + 1)
    plans: list[tuple[list[int], int]] = []

    def fitting() -> np.ndarray:
        """At g, the longest length of at most g that is left; 0 if none."""
        return np.maximum.accumulate(np.where(left > 0, lengths, 0))

    while True:
        longest = int(fitting()[capacity])
        if not longest:
            return plans
        held, gap = [], capacity
        fit = longest
        while fit:
            held.append(fit)
            left[fit] -= 1
            gap -= fit
            fit = int(fitting()[gap]) if gap else 0
        while gap and len(held) > 1:
            shortest = held[-1]
            room = gap + shortest
            best = fitting()
            first = lengths[1:room][left[1:room] > 0]
            second = best[room - first]
            again = (second == first) & (left[first] < 2)  # the only piece of a length can't be both
            if again.any():
                second = np.where(again, best[np.minimum(first - 1, room - first)], second)
            total = np.where(second > 0, first + second, 0)
            k = int(np.argmax(total)) if len(total) else 0
            if not len(total) or total[k] <= shortest:
                break
            a, b = int(first[k]), int(second[k])
            left[shortest] += 1
            left[a] -= 1
            left[b] -= 1
            held = sorted([*held[:-1], a, b], reverse=True)
            gap = room - a - b
        kinds, uses = np.unique(held, return_counts=True)
        more = int((left[kinds] // uses).min())
        left[kinds] -= more * uses
        plans.append((held, 1 + more))


def slot_table(plans: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the r-th piece of each length goes: runs of ranks, sorted by (length, first rank)."""
    taken: dict[int, int] = {}
    rows, offsets, base = [], [], 0
    for held, n in plans:
        places: dict[int, list[int]] = {}
        at = 0
        for length in held:
            places.setdefault(length, []).append(at)
            at += length
        for length, own in places.items():
            rows.append((length << 44 | taken.get(length, 0), taken.get(length, 0), base, len(own), len(offsets)))
            taken[length] = taken.get(length, 0) + n * len(own)
            offsets += own
        base += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"key": table[:, 0], "first": table[:, 1], "base": table[:, 2], "uses": table[:, 3], "at": table[:, 4], "offsets": np.array(offsets, dtype=np.int64)}


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length from 1 to capacity, more) with sequence_id and offset.

    The driver sees one count per length, at most ``capacity`` of them, and plans bins by length; pieces of one length
    are alike and are dealt to the planned places by their number among them. ``pieces`` is read three times, so cut
    what is costly to make before it. Other columns stay; sequence_id and offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    name = fresh(pieces, "rank")["rank"]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if bad := [x for x in counts if x is None or not 1 <= x <= capacity]:
        raise ValueError(f"lengths outside 1 to {capacity}: {bad[:5]}")
    table = pieces.sparkSession.sparkContext.broadcast(slot_table(plan_bins(counts, capacity)))
    spread = F.lpad(F.hex(F.xxhash64(F.lit(4), "doc_id", "piece")), 16, "0")
    ranked = running(pieces, F.col("length"), spread, buckets_for(sum(counts.values())), out=name, tie=F.struct("doc_id", "piece"))
    length_at = pieces.columns.index("length")
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            length = batch.column(length_at).to_numpy().astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy().astype(np.int64)
            run = np.searchsorted(t["key"], (length << 44) + rank, side="right") - 1
            step = rank - t["first"][run]
            sequence = t["base"][run] + step // t["uses"][run]
            offset = t["offsets"][t["at"][run] + step % t["uses"][run]]
            yield pa.record_batch([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, name).mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` with the checksum of their ids, their places and, unless off, the ids themselves.

    Places are planned without the ids, which join them by the number of their row: rows may share a doc_id.
    """
    slim = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = token_pieces(docs).withColumn("ids_crc32", F.crc32("ids"))
    if not ids:
        return pack(cut(pieces.select(*slim), "pieces")[0])
    whole, _ = cut(pieces.withColumn("_pk_row", F.monotonically_increasing_id()), "pieces")
    placed = pack(whole.select("_pk_row", *slim))
    return placed.join(whole.select("_pk_row", "ids"), "_pk_row").select(*slim, "sequence_id", "offset", "ids")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
