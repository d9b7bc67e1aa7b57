"""Near duplicates by SimHash fingerprints, found with pigeonring filtering.

A fingerprint is cut into ``SEGMENTS`` segments on a ring. If two fingerprints
differ in at most ``distance`` bits, then for some start every chain of
``l`` consecutive segments from there differs in at most ``l * distance /
SEGMENTS`` bits. As long as that quota is below one, the chain is equal, so its
segments are a join key; the quotas of the longer chains then prune the pairs
that share a key before the full distance is taken.

Equal fingerprints are put together before anything is shuffled by key, so
groups of copies cost one row. Within a key, small groups take the chains pair
by pair. In a large one the longest chain whose quota is one bit is a key too: a
fingerprint meets those with the same chain and with each of its one-bit
variants that are not linked yet, and the chains, then the full distance, decide
again. That finds the same components without all pairs. Links are between
different fingerprints; nothing is capped.

Nulls and texts without words have fingerprint zero and link like any other.
A null id never is the smallest of its component unless it is alone there.
Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from framewright.llm.blobs import buckets, pack, pieces, split_by, unpack_all
from framewright.llm.components import connected_components
from framewright.session import materialize

SEGMENTS = 16
WIDTH = 64 // SEGMENTS
_SMALL = 64
_SEED = 42
_LANES = np.array([sum((b >> i & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
_WORDS_AT_ONCE = 1 << 17


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), _SEED)] if words else []
    runs = zip(*(words[i:] for i in range(size)))
    return [xxhash.xxh64_intdigest(b" ".join(run), _SEED) for run in runs]


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set from each start to the next."""
    cut = np.unique(np.r_[starts, np.arange(0, len(hashes), 255)])  # lanes of eight bits hold 255
    lanes = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], cut, axis=0)
    counts = lanes.view(np.uint8).reshape(len(cut), 64).astype(np.int64)
    return np.add.reduceat(counts, np.searchsorted(cut, starts), axis=0)


def fingerprints(texts: list[str | None], size: int) -> np.ndarray:
    totals, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    owner: list[int] = []
    starts: list[int] = []
    hashes: list[int] = []

    def flush():
        if hashes:
            counts = bit_counts(np.array(hashes, np.uint64), np.array(starts))
            np.add.at(totals, owner, counts)
            np.add.at(n, owner, np.diff([*starts, len(hashes)]))
            owner.clear(), starts.clear(), hashes.clear()

    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        step = _WORDS_AT_ONCE
        for lo in range(0, max(1, len(words) - size + 1), step):
            found = shingle_hashes(words[lo : lo + step + size - 1], size)
            if found:
                owner.append(k), starts.append(len(hashes)), hashes.extend(found)
            if len(hashes) >= step:
                flush()
    flush()
    bits = (totals * 2 > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def add_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``_id`` and ``_fp``, the fingerprint as a signed long, of every row."""

    def run(batches):
        for batch in pieces(batches, "_text", 8 << 20):
            fp = fingerprints(batch.column(0).to_pylist(), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(fp)], names=["_id", "_fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("_id")).mapInArrow(run, f"_id {kind}, _fp long")


def equal_segments(distance: int) -> int:
    """The longest chain whose quota of differences is below one."""
    return segments_within(distance, 0)


def segments_within(distance: int, bits: int) -> int:
    """The longest chain in which at most ``bits`` differences are within the quota."""
    return min(SEGMENTS, -(-SEGMENTS * (bits + 1) // distance) - 1 if distance else SEGMENTS)


def rotated(fp: np.ndarray, start: int | np.ndarray) -> np.ndarray:
    """The ring turned so that segment ``start`` is lowest."""
    s = np.asarray(start, np.uint64) * np.uint64(WIDTH)
    return (fp >> s) | (fp << ((np.uint64(64) - s) & np.uint64(63)))


def chain_passes(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Whether every chain from the lowest segment of the turned rings is within its quota."""
    diff, ok, total = a ^ b, np.ones(len(a), bool), np.zeros(len(a), np.int64)
    mask = np.uint64((1 << WIDTH) - 1)
    for length in range(1, SEGMENTS + 1):
        total = total + np.bitwise_count((diff >> np.uint64(WIDTH * (length - 1))) & mask)
        ok &= total * SEGMENTS <= length * distance
    return ok


def _links_by_longer_chains(ring: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of links among turned rings, which agree in their lowest segments, enough to connect all that pass."""
    low, high = WIDTH * equal_segments(distance), WIDTH * segments_within(distance, 1)
    flips = [0, *(1 << bit for bit in range(low, high))]
    chain = ring & np.uint64((1 << high) - 1)
    order = np.argsort(chain, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(chain[order]) != 0])
    waiting = dict(zip(chain[order][cut].tolist(), np.split(order, cut[1:])))
    values = chain.tolist()
    linked = np.zeros(len(ring), bool)
    for first in range(len(ring)):
        if linked[first]:
            continue
        linked[first], queue = True, [first]
        while queue:
            now = queue.pop()
            for flip in flips:
                value = values[now] ^ flip
                others = waiting.get(value)
                if others is None:
                    continue
                others = others[~linked[others]]
                near = chain_passes(ring[others], ring[now], distance)
                near[near] = np.bitwise_count(ring[others[near]] ^ ring[now]) <= distance
                found, rest = others[near], others[~near]
                if len(rest):
                    waiting[value] = rest
                else:
                    del waiting[value]
                if len(found):
                    linked[found] = True
                    queue.extend(found.tolist())
                    yield np.full(len(found), now), found


def links_in(start: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints that agree on the key of their start."""
    ring = rotated(fp, start)
    key = ring & np.uint64((1 << (WIDTH * equal_segments(distance))) - 1)
    order = np.lexsort((fp, key, start))
    start, fp, ring, key = start[order], fp[order], ring[order], key[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (start[1:] != start[:-1])]
    head = np.flatnonzero(new)
    size = np.diff(np.r_[head, len(fp)])
    group, left, right = np.repeat(np.arange(len(head)), size), [], []
    small = np.flatnonzero((size <= _SMALL)[group] & (size > 1)[group])
    for step in range(1, _SMALL):
        small = small[small + step < len(fp)]
        small = small[group[small] == group[small + step]]
        if not len(small):
            break
        near = small[chain_passes(ring[small], ring[small + step], distance)]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= distance]
        left.append(fp[near]), right.append(fp[near + step])
    for g in np.flatnonzero(size > _SMALL):
        here = slice(head[g], head[g] + size[g])
        for u, v in _links_by_longer_chains(ring[here], distance):
            left.append(fp[here][u]), right.append(fp[here][v])
    if not left:
        return fp[:0], fp[:0]
    return np.concatenate(left), np.concatenate(right)


def near_links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Links ``u``, ``v`` between distinct values of ``_fp`` within the distance, enough to connect all that link."""
    n = buckets(prints.sparkSession)

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            start = np.repeat(np.arange(SEGMENTS, dtype=np.uint8), len(fp))
            fp = np.tile(fp, SEGMENTS)
            key = rotated(fp, start) & np.uint64((1 << (WIDTH * equal_segments(distance))) - 1)
            mixed = (key * np.uint64(SEGMENTS) + start) * np.uint64(0x9E3779B97F4A7C15)
            where = (mixed >> np.uint64(33)) % np.uint64(n)
            rows = [(b, pack(s, f)) for b, s, f in split_by(where, start, fp)]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "body": pa.array([r[1] for r in rows], pa.binary())})

    def compare(rows):
        start, fp = unpack_all(rows.column("body").to_pylist())
        u, v = links_in(start, fp, distance)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = prints.select("_fp").mapInArrow(deal, "bucket int, body binary")
    return dealt.groupBy("bucket").applyInArrow(compare, "u long, v long").distinct()


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, distance: int = 3) -> DataFrame:
    """One row a document: its id, fingerprint as 16 hex digits, and the smallest id it is linked to."""
    prints = materialize(add_fingerprints(docs, doc_id, text, size), "prints")
    nodes = prints.groupBy("_fp").agg(F.min("_id").alias("_first"))
    roots = connected_components(near_links(nodes, distance))
    rooted = nodes.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", "_first", F.coalesce("root", "_fp").alias("_root"))
    rooted = materialize(rooted, "roots")
    least = rooted.groupBy("_root").agg(F.min("_first").alias("_least"))
    named = rooted.join(least, "_root").select("_fp", "_least")
    return prints.join(named, "_fp").select(
        F.col("_id").alias(doc_id),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_least").alias("component_id"),
    )


def keep_first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, distance: int = 3) -> DataFrame:
    """The documents without those whose component of fingerprints holds a smaller id.

    No text is compared: texts that share a frequent line can have near
    fingerprints. ``near.keep_first_of_near_copies`` compares the shingles.
    Rows that repeat the smallest id itself all stay: they are one document.
    """
    found = simhash_components(docs, doc_id, text, size, distance)
    dropped = found.where(~F.col(doc_id).eqNullSafe(F.col("component_id"))).select(F.col(doc_id).alias("_gone")).distinct()
    return docs.join(dropped, docs[doc_id].eqNullSafe(dropped["_gone"]), "left_anti")
