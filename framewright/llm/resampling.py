"""Documents drawn in proportion to how much they look like a target table.

A document's features are its runs of words, dealt into hash buckets. Each
bucket has a gain, the logarithm of its share in the target over its share in
the documents, held in one array that every task indexes. A document's weight
is the sum of its features' gains; with a Gumbel draw of its own added, the
highest scores are a sample without replacement.

The lowest score that still gets in is found by weighted medians of medians.
The keys (score, id, row) stay where they were written. In each round every
chunk of keys reports the median of those still possible and how many these
are; the weighted median of the medians is the pivot, and one pass counts the
keys before it. A quarter of the keys at least lies on either side of it, so
the side that cannot hold the cutoff goes for good. Keys are distinct, so the
cutoff is exact. When few are left of what a round reads, they are written
anew, so all rounds together read a small multiple of the keys. Only the
winners are sorted.

Nulls and empty texts have no features, weight 0. A null id is drawn as an
empty one and comes after all others among equal scores; rows with equal
scores and ids come in the order of the stored rows. Texts of the target are
counted like documents; nulls there count nothing. Empty tables give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framewright.llm.blobs import pieces
from framewright.operators.indexing import dense_index
from framewright.session import materialize

_APART = bytes(32 if b < 48 or 57 < b < 97 or 122 < b < 128 else b for b in range(256))
_APART = bytes(_APART[b + 32] if 65 <= b <= 90 else _APART[b] for b in range(256))
_LAST_ID = (1 << 63) - 1
_STRETCH = 1 << 20
_REMEMBERED = 500_000
#: keys of which one median is reported
CHUNK = 1 << 20


class Buckets(dict):
    """The bucket of a feature; the first ones seen are remembered."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.n
        if len(self) < _REMEMBERED:
            self[feature] = bucket
        return bucket


@lru_cache(maxsize=4)
def _buckets(n: int) -> Buckets:
    return Buckets(n)


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a stretch of about a megabyte at a time."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_APART)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _STRETCH)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def feature_buckets(text: str | None, lo: int, hi: int, known: Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """By stretch: how many words it has, and the buckets of the features that end in it."""
    before: list[bytes] = []
    for words in words_of(text):
        run, found = before + words, []
        for size in range(lo, hi + 1):
            first = max(0, len(before) - size + 1)
            runs = run if size == 1 else [b" ".join(run[k : k + size]) for k in range(first, len(run) - size + 1)]
            found.extend(map(known.__getitem__, runs[len(before) :] if size == 1 else runs))
        yield len(words), np.array(found, np.int64)
        before = run[len(run) - hi + 1 :] if hi > 1 else []


def bucket_counts(texts: DataFrame, text: str, sizes: tuple[int, int], n: int) -> np.ndarray:
    """Features of all texts in each bucket; every task sends at most one count a bucket."""

    def run(batches):
        counts, known = np.zeros(n, np.int64), _buckets(n)
        for batch in pieces(batches, "_text", 4 << 20):
            for value in batch.column(0).to_pylist():
                for _, found in feature_buckets(value, *sizes, known):
                    counts += np.bincount(found, minlength=n)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["bucket", "n"])

    found = texts.select(F.col(text).alias("_text")).mapInArrow(run, "bucket long, n long")
    total = np.zeros(n, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most n rows
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to source, rounded down."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratios = [(t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw from the id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _scored(docs: DataFrame, doc_id: str, text: str, sizes: tuple[int, int], gains: np.ndarray, seed: int) -> DataFrame:
    kind, n = docs.schema[doc_id].dataType.simpleString(), len(gains)

    def run(batches):
        known = _buckets(n)
        for batch in pieces(batches, "_text", 4 << 20):
            rows = []
            for value in batch.column(0).to_pylist():
                n_words = features = weight = 0
                for words, found in feature_buckets(value, *sizes, known):
                    n_words, features, weight = n_words + words, features + len(found), weight + int(gains[found].sum())
                rows.append((n_words, features, weight))
            numbers = [pa.array(list(c), pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(numbers or [pa.array([], pa.int64())] * 3)], names=["_id", "n_words", "n_features", "weight"])

    source = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("_id"))
    done = source.mapInArrow(run, f"_id {kind}, n_words long, n_features long, weight long")
    return done.withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed)).withColumn("_nth", F.monotonically_increasing_id())


def _before(keys: np.ndarray, key: tuple[int, int, int]) -> np.ndarray:
    """Which keys come before this one; keys are columns of numbers."""
    a, b, c = keys
    return (a < key[0]) | ((a == key[0]) & ((b < key[1]) | ((b == key[1]) & (c < key[2]))))


def _medians(keys: DataFrame, low, pivot, high, chunk: int) -> list[tuple[bool, int, int, int, int, int]]:
    """Of every chunk: how many keys between low and pivot, or pivot and high, it has, and their median.

    One row a chunk and side comes to the driver, whatever the chunk holds.
    """

    def report(held):
        block = np.concatenate(held, axis=1)
        inside = np.ones(block.shape[1], bool)
        for key in (low, pivot):
            if key is not None:
                inside &= (block != np.array(key)[:, None]).any(0)
        if low is not None:
            inside &= ~_before(block, low)
        if high is not None:
            inside &= _before(block, high)
        block = block[:, inside]
        left = _before(block, pivot) if pivot is not None else np.zeros(block.shape[1], bool)
        for side in (True, False):
            part = block[:, left == side]
            if part.shape[1]:
                order = np.lexsort(part[::-1])
                yield side, part.shape[1], *part[:, order[(part.shape[1] - 1) // 2]].tolist()

    def run(batches):
        held, rows, out = [], 0, []
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]))
            rows += batch.num_rows
            if rows >= chunk:
                out.extend(report(held))
                held, rows = [], 0
        if rows:
            out.extend(report(held))
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.bool_(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["before", "n", "a", "b", "c"])

    return [tuple(r) for r in keys.mapInArrow(run, "before boolean, n long, a long, b long, c long").collect()]


def weighted_median(medians: list[tuple[int, tuple[int, int, int]]]) -> tuple[int, int, int]:
    """Of (weight, key): the first key at which half of the weight is reached."""
    medians = sorted(medians, key=lambda m: m[1])
    half, reached = (sum(n for n, _ in medians) + 1) // 2, 0
    for n, key in medians:
        reached += n
        if reached >= half:
            return key
    raise ValueError("no keys")


def cutoff_key(keys: DataFrame, wanted: int, chunk: int = CHUNK) -> tuple[int, int, int]:
    """The key at place ``wanted``, from 1, of a stored table of three distinct-keyed numbers a, b, c."""

    def within(low, high) -> Column:
        def past(key) -> Column:
            a, b, c = F.col("a"), F.col("b"), F.col("c")
            return (a > key[0]) | ((a == key[0]) & ((b > key[1]) | ((b == key[1]) & (c > key[2]))))

        kept = F.lit(True) if low is None else past(low)
        return kept if high is None else kept & ~past((*high[:2], high[2] - 1))

    low = high = None
    known = _medians(keys, None, None, None, chunk)
    left = stored = sum(r[1] for r in known)
    if not 1 <= wanted <= left:
        raise ValueError(f"no key at place {wanted} of {left}")
    while True:
        pivot = weighted_median([(r[1], r[2:]) for r in known])
        sides = _medians(keys, low, pivot, high, chunk)
        before = sum(r[1] for r in sides if r[0])
        if wanted == before + 1:
            return pivot
        if wanted <= before:
            high, known = pivot, [r for r in sides if r[0]]
        else:
            low, known, wanted = pivot, [r for r in sides if not r[0]], wanted - before - 1
        left = sum(r[1] for r in known)
        if left * 8 <= stored and stored > chunk:
            keys, stored = materialize(keys.where(within(low, high)), "keys"), left


def draw_documents(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    sizes: tuple[int, int] = (1, 1),
    n_buckets: int = 10_000,
    seed: int = 2024,
    least_words: int = 20,
    percent: int = 10,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row a document: the id, n_features, weight, score, rank.

    ``percent`` of the documents with ``least_words`` words or more are drawn,
    rounded down; ``rank`` is 1 for the highest score and null if not drawn.
    """
    gains = bucket_gains(bucket_counts(docs, text, sizes, n_buckets), bucket_counts(target, target_text, sizes, n_buckets))
    scored = materialize(_scored(docs, doc_id, text, sizes, gains, seed), "scores")
    order = F.coalesce(F.col("_id").cast("long"), F.lit(_LAST_ID))
    able = F.col("n_words") >= least_words
    keys = scored.where(able).select((-F.col("score")).alias("a"), order.alias("b"), F.col("_nth").alias("c"))
    wanted = percent * keys.count() // 100
    columns = [F.col("_id").alias(doc_id), "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select(*columns, undrawn)
    a, b, c = cutoff_key(keys, wanted, chunk)
    score = -F.col("score")
    drawn = able & ((score < a) | ((score == a) & ((order < b) | ((order == b) & (F.col("_nth") <= c)))))
    winners = dense_index(scored.where(drawn).withColumn("_a", score).withColumn("_b", order), ["_a", "_b", "_nth"], name="_place")
    return winners.select(*columns, (F.col("_place") + 1).alias("rank")).unionByName(scored.where(~drawn).select(*columns, undrawn))
