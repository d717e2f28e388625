"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
#: The classifier is fitted on so many documents of a language at most, and on so many characters of each.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 500
#: Texts are parsed in blocks of so many symbols side by side, and then across the blocks' borders as if there were none.
BLOCK = 256
#: Characters parsed side by side.
AT_ONCE = 3_000_000

SPACE, OTHER = 0, 1


@functools.cache
def letter_table() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


#: Places of a transition table for each transition, at least.
ROOM = 4
#: Odd, for spreading keys by their product's high bits.
SPREAD = 0x9E3779B1
FREE = 0xFFFFFFFF


@dataclass
class Steps:
    """Transitions of an automaton in an open hash table: the key state * width + symbol lies at its hashed place or, if
    that was taken, at the first free one after it. So its size follows the transitions, not the number of letters."""

    width: int
    shift: int
    #: Next state in the low half, key in the high half; free places have all bits of the key set.
    table: np.ndarray
    #: Next state from the start by each symbol.
    first: np.ndarray

    def take(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states; 0 for none (no transition leads to the start)."""
        key = state * np.uint32(self.width)
        key += symbol
        at = (key * np.uint32(SPREAD)) >> np.uint32(self.shift)
        found = self.table.take(at).view(np.uint32).reshape(-1, 2)
        hit = found[:, 1] == key
        out = found[:, 0] * hit
        left = np.flatnonzero(~hit & (found[:, 1] != FREE))
        while len(left):
            at[left] += np.uint32(1)
            found = self.table.take(at[left]).view(np.uint32).reshape(-1, 2)
            hit = found[:, 1] == key[left]
            out[left[hit]] = found[hit, 0]
            left = left[~hit & (found[:, 1] != FREE)]
        return out


@dataclass
class Model:
    languages: list[str]
    letters: list[str]
    steps: list[Steps]
    #: Bits that a phrase costs: log2 of the sample's length.
    bits: np.ndarray

    @functools.cached_property
    def symbols(self) -> np.ndarray:
        """Symbol of each code point: known letters by lower case, other letters, and all else as a space."""
        out = np.where(letter_table(), OTHER, SPACE).astype(np.uint32)
        for k, letter in enumerate(self.letters):
            for form in {letter, letter.upper()}:
                if len(form) == 1:
                    out[ord(form)] = k + 2
        return out


def hashed_steps(step: list[dict[int, int]], width: int) -> Steps:
    """``step`` (by state: next state by symbol, all symbols below ``width``) as a table."""
    if len(step) * width >= FREE:
        raise ValueError("so large a sample of so many letters needs a smaller SAMPLE_DOCS or SAMPLE_CHARS")
    key = np.array([s * width + c for s, own in enumerate(step) for c in own], dtype=np.uint32)
    to = np.array([t for own in step for t in own.values()], dtype=np.uint32)
    bits = max(1, int(ROOM * len(key)).bit_length())
    keys, targets = np.full((1 << bits) + len(key) + 1, FREE, dtype=np.uint32), np.zeros((1 << bits) + len(key) + 1, dtype=np.uint32)
    at = (key * np.uint32(SPREAD)) >> np.uint32(32 - bits)
    left = np.arange(len(key))
    while len(left):
        free = left[keys[at[left]] == FREE]
        _, one = np.unique(at[free], return_index=True)
        keys[at[free[one]]], targets[at[free[one]]] = key[free[one]], to[free[one]]
        left = left[keys[at[left]] != key[left]]
        at[left] += np.uint32(1)
    first = np.zeros(width, dtype=np.uint32)
    for c, t in step[0].items():
        first[c] = t
    return Steps(width, 32 - bits, np.stack([targets, keys], axis=1).reshape(-1).view(np.uint64), first)


def suffix_automaton(symbols: list[int], width: int) -> Steps:
    """Transitions of the automaton that accepts just the substrings' walks from the start, state 0."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at != -1 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at != -1:
            to = step[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at != -1 and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return hashed_steps(step, width)


def squeezed(texts: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, each with a space before and after, runs of spaces as one; and where each ends."""
    joined = "".join(f" {t} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    own = symbols[codes]
    keep = np.ones(len(own), dtype=bool)
    keep[1:] = (own[1:] != SPACE) | (own[:-1] != SPACE)
    ends = np.cumsum([len(t) + 2 for t in texts])
    keep[ends[:-1]] = True  # each text keeps its own first space
    return own[keep], np.cumsum(keep)[ends - 1]


def train(samples: dict[str, list[str]]) -> Model:
    """A model of sample texts by language. Languages without a letter are left out."""
    letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
    model = Model([], letters, [], np.zeros(0))
    bits = []
    for language in sorted(samples):
        row, _ = squeezed(samples[language], model.symbols)
        if (row != SPACE).any():
            model.languages.append(language)
            model.steps.append(suffix_automaton(row.tolist(), len(letters) + 2))
            bits.append(np.log2(len(row) + 1))
    model.bits = np.array(bits)
    return model


def phrases(model: Model, row: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns).

    From the start of its automaton each language follows the text as long as some substring of its sample does; where
    none goes on, the next phrase begins with that symbol. A symbol that the sample lacks is a phrase and counts twice,
    as an escape and the symbol itself.

    Blocks of all texts step at once, each as if it began a text, longest first, so that those still going are a prefix.
    Then each block but a text's first starts once more in the state that the block before ended in, until it meets the
    walk it has; a block whose end changes that way sends the next one through again. What is counted is one walk over
    the whole text.
    """
    begins = np.concatenate([[0], ends[:-1]])
    n_blocks = -(-(ends - begins) // BLOCK)
    owner = np.repeat(np.arange(len(ends)), n_blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    start = begins[owner] + nth * BLOCK
    size = np.minimum(BLOCK, ends[owner] - start)
    order = np.argsort(-size, kind="stable")
    by_size, sizes = start[order], size[order]
    going = np.searchsorted(-sizes, -np.arange(BLOCK), side="left")  # at t: blocks with more than t symbols
    out = np.zeros((len(ends), len(model.languages)))
    walk, begun = np.zeros(len(row), dtype=np.uint32), np.zeros(len(row), dtype=np.int8)
    for k, steps in enumerate(model.steps):
        state = np.zeros(len(start), dtype=np.uint32)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            at = by_size[: going[t]] + t
            state = moved(steps, state[: len(at)], row[at], at, walk, begun)
        again = np.nonzero(nth > 0)[0]
        while len(again):
            blocks, state, changed = again, walk[start[again] - 1], []
            for t in range(BLOCK):
                at = start[blocks] + t
                had = walk[at]
                state = moved(steps, state, row[at], at, walk, begun)
                apart = state != had
                changed.append(blocks[apart & (size[blocks] == t + 1)])
                on = apart & (size[blocks] > t + 1)
                blocks, state = blocks[on], state[on]
                if not len(blocks):
                    break
            after = np.concatenate(changed) + 1
            after = after[after < len(start)]
            again = after[nth[after] > 0]
        out[:, k] = np.add.reduceat(begun, begins, dtype=np.int64) if len(begins) else 0
    return out


def moved(steps: Steps, state: np.ndarray, symbol: np.ndarray, at: np.ndarray, walk: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """States after ``symbol``, written to ``walk`` at the places ``at``; ``begun`` there gets the phrases that begin."""
    to = steps.take(state, symbol)
    new = np.flatnonzero(to == 0)
    once = np.zeros(len(to), dtype=np.int8)
    if len(new):
        to[new] = steps.first[symbol[new]]
        once[new] = 1 + (to[new] == 0)
    once[(state == 0) & (once == 0)] = 1
    walk[at], begun[at] = to, once
    return to


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. Null, letterless, or nothing learned: ``und`` and 0. Ties: first by name."""
    whole = [t or "" for t in texts]
    names, scores = [UNKNOWN] * len(whole), np.zeros(len(whole))
    if not whole or not model.languages:
        return names, scores
    row, ends = squeezed(whole, model.symbols)
    lettered = np.add.reduceat(row != SPACE, np.concatenate([[0], ends[:-1]])) > 0
    n = np.diff(ends, prepend=0)
    cost = phrases(model, row, ends) * model.bits / n[:, None]
    best = cost.argmin(axis=1)
    # as if each of up to 100 symbols bore a quarter of its bits as evidence
    ahead = (cost - cost.min(axis=1, keepdims=True)) * np.minimum(n, 100)[:, None] / 4
    share = 1 / np.exp2(-ahead).sum(axis=1)
    for i in np.nonzero(lettered)[0]:
        names[i], scores[i] = model.languages[best[i]], share[i]
    return names, scores


def fit(labelled: DataFrame, *, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """A model of ``labelled`` (text, lang): at most ``docs`` distinct texts of each language, ``chars`` characters of each.

    The driver gets no more than that. Texts are picked by the order of their hashes, first within small parts of a
    language and then among the picks, so that no task holds a language; copies of a text count once. A longer text
    gives the characters from a hashed place on. Null texts and labels are left out.
    """
    kept = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", F.xxhash64("text").alias("h"), "text")
    part = kept.select("lang", "h").distinct().withColumn("part", F.xxhash64(F.lit(5), "h") % 64)
    for keys in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("h")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs)
    spare = F.greatest(F.char_length("text") - chars, F.lit(0))
    span = F.col("text").substr((F.pmod(F.xxhash64(F.lit(6), "h"), spare + 1) + 1).cast("int"), F.lit(chars))
    picked = kept.join(F.broadcast(part.select("lang", "h", "rank")), ["lang", "h"]).groupBy("lang", "rank").agg(F.min(span).alias("text"))
    samples: dict[str, list[tuple[int, str]]] = {}
    for r in picked.collect():
        samples.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    return train({k: [t for _, t in sorted(v)] for k, v in samples.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text, more) with lang_pred and score, from the whole text alone. Columns of these names are replaced."""
    plain = docs.drop("lang_pred", "score")
    place = plain.columns.index("text")
    names = [*plain.columns, "lang_pred", "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            langs: list[str] = []
            scores: list[np.ndarray] = []
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (size < AT_ONCE):
                    size += len(texts[high] or "") + 2
                    high += 1
                found, score = predict(shared.value, texts[low:high])
                langs += found
                scores.append(score)
                low = high
            yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(label, f"{schema}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for a fifth of the documents, which nothing is learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
