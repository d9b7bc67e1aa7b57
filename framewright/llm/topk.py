"""Exact top-k inner products with a uniform threshold in three phases.

The components are dealt into ``lists``; each gives a partial score. (1) In
every pair of a block of queries and a block of candidates, each list gives its
k best partial scores; the k-th best of the whole scores of these few is a safe
cutoff for the query. (2) A score at or above the cutoff needs a partial score of
at least the cutoff divided by the number of lists, so only such entries are
collected. A list is read in the order of its candidates' lengths, and only as
far as a product of lengths can reach that share. (3) The missing parts of the
entries are resolved exactly, and those at or above the cutoff compete, at most
k for each query and block.

A task holds one block of either side and the partial scores of one strip of
queries.

Components are floor(``scale`` * x). Sums are taken in doubles where those are
exact, that is if the product of two lengths is below 2**53, else in integers;
the bounds then have room for the rounding of doubles. A result beyond 64 bits
fails the job. The cutoffs travel inside the query blocks by a join.

Rows with a null id or vector, or with null or non-finite components, take no
part; shorter vectors count as filled with zeros. With fewer than k candidates
all are returned. Rows that repeat an id count once, or, with ``repeats``, each
by itself: a query's candidates are then the rows of all other ids, and the rows
of one query id compete for its k places. Of rows equal in id and vector, no
more than k can have a place, and no more are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from framewright.llm.blobs import pack, unpack
from framewright.llm.vectors import at_most, best_first, cells, packed_blocks, spread, usable
from framewright.session import materialize


_EXACT = 2.0**53  # doubles hold all integers below
_LARGEST = (1 << 63) - 1

#: numbers in the largest array of a strip, 16 MB of doubles
_STRIP = 1 << 21


def _parts(width: int, lists: int) -> list[slice]:
    edges = [width * k // lists for k in range(lists + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _floored(m: np.ndarray, scale: int) -> np.ndarray:
    m = np.floor(scale * m)
    return m.astype(np.int32) if np.abs(m).max(initial=0) < 1 << 31 else m


def collected(q: np.ndarray, c: np.ndarray, share: np.ndarray, length: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Entries of one list, as row * candidates + column, whose partial score reaches their query's share.

    ``order`` sorts the candidates by falling length; those behind the last one
    whose length times a query's can reach its share are not multiplied.
    """
    reach = np.linalg.norm(q, axis=1) * (1 + 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = np.where(share > 0, share / reach, 0.0).min(initial=np.inf)
    read = order[: np.searchsorted(-length[order], -needed, side="right")]
    room = 0.0
    if length.max(initial=0) * reach.max(initial=0) >= _EXACT:
        room = (reach * length.max(initial=0) + np.abs(np.where(np.isfinite(share), share, 0))) * (q.shape[1] + 4) * 2.0**-52
    row, col = np.nonzero(q @ c[read].T >= (share - room)[:, None])
    return row * len(c) + read[col]


def completed(q: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Whole scores of the entries."""
    step = max(1, _STRIP // max(1, q.shape[1]))
    scores = [_products(q[row[lo : lo + step]], c[col[lo : lo + step]]) for lo in range(0, len(row), step)]
    return np.concatenate(scores) if scores else np.empty(0, np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, exact; those beyond 64 bits are the largest or smallest number."""
    with np.errstate(over="ignore"):
        most = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    out = np.zeros(len(a), np.int64)
    short, long = most < _EXACT, ~(most < 2.0**62)
    out[short] = np.einsum("ij,ij->i", a[short], b[short]).astype(np.int64)
    middle = np.flatnonzero(~short & ~long)
    fits = (np.abs(a[middle]).max(axis=1, initial=0) < 2.0**63) & (np.abs(b[middle]).max(axis=1, initial=0) < 2.0**63)
    out[middle[fits]] = np.einsum("ij,ij->i", a[middle[fits]].astype(np.int64), b[middle[fits]].astype(np.int64))
    for k in [*np.flatnonzero(long), *middle[~fits]]:
        whole = sum(int(x) * int(y) for x, y in zip(a[k], b[k]) if x and y)
        out[k] = min(max(whole, -_LARGEST - 1), _LARGEST)
    return out


def _table(query, vec, score) -> pa.Table:
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())})


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    lists: int = 2,
    query_block: int = 4096,
    vector_block: int = 8192,
    repeats: bool = False,
) -> DataFrame:
    """query_id, rank, vec_id, score for each query and its k highest scores, ties to the smaller id."""
    rows, asked = usable(vectors, vec_id, vector), usable(queries, vec_id, vector)
    n, width = rows.agg(F.count("*"), F.max(F.size("_v"))).first()
    n_asked, asked_width = asked.agg(F.count("*"), F.max(F.size("_v"))).first()
    width = max(width or 1, asked_width or 1)
    if repeats:
        rows, asked = at_most(rows, k), at_most(asked, k)
    by = ("_id", "_v", "_copy") if repeats else ("_id",)
    parts = _parts(width, lists)
    n_v, by_v = spread(n, vector_block, by)
    n_q, by_q = spread(n_asked, query_block, by)
    candidates = materialize(packed_blocks(rows, by_v, width, lambda m: _floored(m, scale), repeats), "vectors")
    blocks = materialize(packed_blocks(asked, by_q, width, lambda m: _floored(m, scale), repeats), "queries")
    schema = "query_id long, vec_id long, score long"

    def strips(q):
        step = max(1, _STRIP // max(1, vector_block))
        return (slice(lo, lo + step) for lo in range(0, len(q), step))

    def gather(query, cand):
        (q_ids, q), (ids, c) = query, cand
        c, found = c.astype(np.float64), []
        for strip in strips(q):
            some, own = q[strip].astype(np.float64), q_ids[strip, None] == ids
            best = []
            for p in parts:
                row, col = best_first(np.where(own, -np.inf, some[:, p] @ c[:, p].T), ids, k)
                best.append(row * len(ids) + col)
            row, col = np.divmod(np.unique(np.concatenate(best)), len(ids))
            row, col = row[~own[row, col]], col[~own[row, col]]
            found.append(_table(q_ids[strip][row], ids[col], completed(some, c, row, col)))
        return pa.concat_tables(found)

    gathered = cells(blocks, n_q, candidates, n_v, gather, schema)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = gathered.withColumn("rank", F.row_number().over(best))
    cutoff = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("_cut"))
    places = asked.select(by_q.cast("long").alias("_block"), "_id").distinct()
    cut_blocks = cutoff.join(places, "_id").groupBy("_block").applyInArrow(
        lambda key, t: pa.table({"_block": pa.array([key[0].as_py()], pa.int64()), "cuts": pa.array([pack(t.column("_id").to_numpy(), t.column("_cut").to_numpy())], pa.binary())}),
        "_block long, cuts binary",
    )

    def with_cuts(batches):
        for batch in batches:
            bodies = []
            for body, cuts in zip(batch.column("body").to_pylist(), batch.column("cuts").to_pylist()):
                ids, m = unpack(body)
                cut = np.full(len(ids), -np.inf)  # a query with fewer than k candidates takes all
                if cuts is not None:
                    known, values = unpack(cuts)
                    order = np.argsort(known)
                    at = order[np.searchsorted(known[order], ids).clip(max=len(known) - 1)]
                    least = values.astype(np.float64)
                    least = np.where(np.abs(least) < _EXACT, least, np.nextafter(least, -np.inf))
                    cut = np.where(known[at] == ids, least[at], cut)
                bodies.append(pack(ids, m, cut))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(bodies, pa.binary())], names=["block", "body"])

    told = blocks.join(cut_blocks, F.col("block") == F.col("_block"), "left").select("block", "body", "cuts").mapInArrow(with_cuts, "block long, body binary")

    def resolve(query, cand):
        (q_ids, q, cut), (ids, c) = query, cand
        c, found = c.astype(np.float64), []
        long = [np.linalg.norm(c[:, p], axis=1) for p in parts]
        order = [np.argsort(-n, kind="stable") for n in long]
        for strip in strips(q):
            some, least = q[strip].astype(np.float64), cut[strip]
            entries = [collected(some[:, p], c[:, p], least / lists, n, o) for p, n, o in zip(parts, long, order)]
            row, col = np.divmod(np.unique(np.concatenate(entries)), len(ids))
            other = q_ids[strip][row] != ids[col]
            row, col = row[other], col[other]
            score = completed(some, c, row, col)
            good = score >= least[row]
            row, col, score = row[good], col[good], score[good]
            first = np.lexsort((ids[col], -score, row))
            row, col, score = row[first], col[first], score[first]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append(_table(q_ids[strip][row[kept]], ids[col[kept]], score[kept]))
        return pa.concat_tables(found)

    resolved = cells(told, n_q, candidates, n_v, resolve, schema)
    held = F.when(F.col("score").isin(_LARGEST, -_LARGEST - 1), F.raise_error("a score beyond 64 bits").cast("long")).otherwise(F.col("score"))
    first = resolved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return first.select("query_id", "rank", "vec_id", held.alias("score"))
