"""URL filter: host and path rules, and for the rest a ratio of two character language models that the rules' URLs train.

Both models are variable-order Markov models over the bytes of a URL, with a mark before and after. A context is as long
as the corpus supports it: a run of up to seven symbols is kept if it makes up a fixed share of all symbols of its class,
whatever the size of the corpus, so that the number of runs has a bound. Probabilities are smoothed by interpolation
from the shortest context on (Witten and Bell); what fell below the share escapes to the shorter context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.alignment import sliced
from fieldloom.llm.names import fresh
from fieldloom.sessions import cut, discard

#: Longest context in symbols.
ORDER = 6
#: A run is kept if it is a single symbol, or its share of its class's symbols is at least one in so many: that many runs
#: of each length at most.
RUNS = 100_000
#: One in so many of the URLs that rules judge is kept from training, to set the threshold; by the URL's checksum.
FOLDS = 5
#: Bins of the score (nats a symbol) among which the threshold is chosen.
BINS_A_NAT, MOST_NATS = 256, 8
SLICE_BYTES = 1 << 20
BEGIN, END = 257, 258
ALLOW, BLOCK = "allow", "block"
RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))


def lowered(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, and from there to the next ``?`` or ``#``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return tuple(F.coalesce(c, F.lit("")) for c in (lowered(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)))


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of rules that say both, block wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == BLOCK)):  # the last one checks first
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit(f".{own_host}"))) & F.startswith(path, F.lit(slash + own_path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(own)).otherwise(verdict)
    return rule, verdict


def symbols(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The URLs' bytes as 1 to 256, each URL with its marks, and where each begins."""
    packed = pc.cast(pc.fill_null(urls, ""), pa.binary())
    lengths = pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 2)])
    out = np.zeros(starts[-1], dtype=np.int64)
    inner = np.ones(len(out), dtype=bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    out[inner] = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).astype(np.int64) + 1
    out[starts[:-1]], out[starts[1:] - 1] = BEGIN, END
    return out, starts


def runs(found: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 on: the run that ends at each symbol, 9 bits a symbol, and whether it lies in one URL."""
    within = np.arange(len(found)) - np.repeat(starts[:-1], np.diff(starts))
    key = found.copy()
    for k in range(ORDER + 1):
        if k:
            key[k:] += found[:-k] << (9 * k)
        yield key, within >= max(k, 1)  # the first mark isn't predicted


def counted_runs(urls: DataFrame) -> DataFrame:
    """(label, run, n) over (label, url)."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        n = np.zeros(len(keys), dtype=np.int64)
        np.add.at(n, at, np.concatenate([c for _, c in parts]))
        return keys, n

    def given(label: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([label] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["label", "run", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for low, high in sliced(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), SLICE_BYTES):
                labels = batch.column(0).slice(low, high - low)
                for label in pc.unique(labels).to_pylist():
                    found, starts = symbols(batch.column(1).slice(low, high - low).filter(pc.equal(labels, label)))
                    parts = held.setdefault(label, [])
                    parts += [np.unique(key[ok], return_counts=True) for key, ok in runs(found, starts)]
                    held[label] = [merged(parts)]
                    if len(held[label][0][0]) > 1_000_000:
                        yield given(label, *held.pop(label)[0])
        for label, parts in held.items():
            yield given(label, *parts[0])

    return urls.mapInArrow(count, "label string, run long, n long").groupBy("label", "run").agg(F.sum("n").alias("n"))


@dataclass
class Models:
    """Both models over one sorted list of runs. By run and class: its count (0 if not kept), and as a context how many
    symbols follow it, how many kept ones, and how many different ones of these. The empty run is the last row."""

    keys: np.ndarray
    counts: np.ndarray
    follows: np.ndarray
    kept: np.ndarray
    kinds: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, int, int]]) -> Models:
        """From (class, run, n); a class without runs is uniform over all bytes."""
        keys = np.unique(np.array([BEGIN, *(run for _, run, _ in rows)], dtype=np.int64))
        counts = np.zeros((len(keys) + 1, 2), dtype=np.int64)
        own = np.array(rows, dtype=np.int64).reshape(-1, 3)
        counts[np.searchsorted(keys, own[:, 1]), own[:, 0]] = own[:, 2]
        counts[-1] = counts[:-1][keys <= END].sum(axis=0)
        counts[np.searchsorted(keys, BEGIN)] = counts[np.searchsorted(keys, END)] if END in keys else 0  # a URL has one of each
        # runs of one context stand together: same length, same symbols but the last
        context = np.searchsorted(keys, keys >> 9)
        context = np.where(keys >> 9 == 0, len(keys), context)
        kept, kinds = np.zeros_like(counts), np.zeros_like(counts)
        real = keys != BEGIN
        np.add.at(kept, context[real], counts[:-1][real])
        np.add.at(kinds, context[real], (counts[:-1][real] > 0).astype(np.int64))
        return Models(keys, counts, counts.copy(), kept, kinds)

    def scores(self, urls: pa.Array) -> np.ndarray:
        """Mean log-likelihood a symbol under class 0 less that under class 1."""
        found, starts = symbols(urls)
        p = np.full((len(found), 2), 1 / 257)
        context = np.full(len(found), len(self.keys))
        for key, ok in runs(found, starts):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            n = np.where((known & ok)[:, None], self.counts[at], 0)
            follows, kept, kinds = self.follows[context], self.kept[context], self.kinds[context]
            usable = (ok & (context >= 0))[:, None] & (kinds > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                longer = (n + (follows - kept + kinds) * p) / (follows + kinds)
            p = np.where(usable, longer, p)
            # the run that ends one symbol earlier is the next length's context
            context = np.concatenate([[-1], np.where(known, at, -1)[:-1]])
        logs = np.log(p)
        logs[starts[:-1]] = 0
        sums = np.add.reduceat(logs[:, 0] - logs[:, 1], starts[:-1]) if len(starts) > 1 else np.zeros(0)
        return sums / (np.diff(starts) - 1)


def fit(labelled: DataFrame, *, share: int = RUNS) -> Models:
    """Models of (label, url), label 'allow' or 'block', over all rows; rare runs are left out, see the module."""
    counts, path = cut(counted_runs(labelled), "runs")
    totals = counts.where(F.col("run") <= END).groupBy("label").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), "label").where((F.col("n") * share >= F.col("total")) | (F.col("run") <= END))
    rows = kept.select((F.col("label") == BLOCK).cast("int"), "run", "n").toArrow()
    discard(labelled.sparkSession, path)
    return Models.of(list(zip(*(c.to_pylist() for c in rows.columns), strict=True)))


def scored(urls: DataFrame, models: Models, url: str, out: str) -> DataFrame:
    """``urls`` with ``out``, the score of its column ``url``."""
    shared = urls.sparkSession.sparkContext.broadcast(models)
    at = urls.columns.index(url)
    names = [*urls.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in sliced(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), SLICE_BYTES):
                part = batch.slice(low, high - low)
                yield pa.record_batch([*part.columns, pa.array(shared.value.scores(part.column(at)))], names=names)

    return urls.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields) + f", `{out}` double")


def threshold(held: DataFrame) -> float:
    """The score that tells (label, score) apart best: the mean of the shares told right in each label is highest; of
    several such, the middle one. 0 if a label is missing."""
    binned = F.floor(F.least(F.greatest(F.col("score"), F.lit(-float(MOST_NATS))), F.lit(MOST_NATS - 1 / BINS_A_NAT)) * BINS_A_NAT).cast("int")
    bins = np.zeros((2, 2 * MOST_NATS * BINS_A_NAT + 1), dtype=np.int64)
    for r in held.groupBy("label", binned.alias("bin")).agg(F.count("*").alias("n")).collect():
        bins[int(r["label"] == BLOCK), r["bin"] + MOST_NATS * BINS_A_NAT] += r["n"]
    if not bins.sum(axis=1).all():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), bins.cumsum(axis=1)], axis=1) / bins.sum(axis=1, keepdims=True)
    right = below[1] - below[0]
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return (float(best[len(best) // 2]) - MOST_NATS * BINS_A_NAT) / BINS_A_NAT


def judge(pages: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url", order_share: int = RUNS) -> DataFrame:
    """``pages`` with host, path, rule, verdict, score (calibrated: 0 and above allows) in place of columns of these names.

    The longest rule that fits decides; where none does, the models, trained on the URLs that rules allow and block. A
    null URL and one without ``://`` have an empty host and path, and are judged as the text they are (null: empty).
    Repeated rows count as often as they are there. Where rules leave one class or both without a URL, that class's
    model is uniform and the threshold 0. An empty table gives none.
    """
    added = ["host", "path", "rule", "verdict", "score"]
    c = fresh(pages, "url", "host", "path", "rule", "label", "score")
    host, path = host_and_path(F.col(url).cast("string"))
    own = pages.withColumns({c["host"]: host, c["path"]: path})
    rule, verdict = ruled(F.col(c["host"]), F.col(c["path"]), rules)
    scheme = F.regexp_extract(F.col(url).cast("string"), "(?s)^(.*?://)", 1)
    plain = F.coalesce(F.col(url).cast("string"), F.lit(""))
    # the URL with its host as the rules see it
    plain = F.when(F.length(scheme) > 0, F.concat(scheme, F.col(c["host"]), F.substr(plain, F.length(scheme) + F.length(c["host"]) + 1))).otherwise(plain)
    own = own.withColumns({c["rule"]: rule, c["label"]: verdict, c["url"]: plain})
    labelled = own.where(F.col(c["label"]).isNotNull()).select(F.col(c["label"]).alias("label"), F.col(c["url"]).alias("url"))
    held = F.crc32("url") % FOLDS == 0
    models = fit(labelled.where(~held), share=order_share)
    at = threshold(scored(labelled.where(held), models, "url", "score").select("label", "score"))
    found = scored(own, models, c["url"], c["score"])
    calibrated = F.col(c["score"]) - at
    decided = F.coalesce(F.col(c["label"]), F.when(calibrated >= 0, ALLOW).otherwise(BLOCK))
    kept = [x for x in pages.columns if x.lower() not in added]
    return found.select(*kept, F.col(c["host"]).alias("host"), F.col(c["path"]).alias("path"), F.col(c["rule"]).alias("rule"), decided.alias("verdict"), calibrated.alias("score"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages``: page_id, host, path, rule, verdict, score."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")
