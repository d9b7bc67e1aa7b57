"""Blocks of vectors, and all pairs of a block of queries and a block of candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framewright.llm.blobs import pack, unpack


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``_id`` and ``_v`` as doubles, of rows with an id and only finite components."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where("_id IS NOT NULL AND _v IS NOT NULL").where(finite)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, shorter vectors filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(offsets)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat
    return out


def packed_blocks(rows: DataFrame, block: Column, width: int, change, repeats: bool = False) -> DataFrame:
    """One row a block: ``block`` and the packed ids and matrix, after ``change`` of the matrix.

    Without ``repeats`` a row that repeats an id counts once: the one whose vector sorts first.
    """

    def run(key, table):
        ids, m = table.column("_id").to_numpy(), matrix(table.column("_v"), width)
        order = np.lexsort((*m.T[::-1], ids))
        if not repeats:
            order = order[np.r_[True, np.diff(ids[order]) != 0]]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "body": pa.array([pack(ids[order], change(m[order]))], pa.binary())})

    return rows.select(block.cast("long").alias("_block"), "_id", "_v").groupBy("_block").applyInArrow(run, "block long, body binary")


def cells(queries: DataFrame, n_queries: int, candidates: DataFrame, n_candidates: int, run, schema: str) -> DataFrame:
    """``run(ids, matrix, ids, matrix)`` for every block of queries with every block of candidates.

    Each task holds one block of either side; nothing is broadcast.
    """

    kinds = {"long": pa.int64(), "double": pa.float64()}
    empty = pa.table({n: pa.array([], kinds[k]) for n, k in (part.split() for part in schema.split(", "))})

    def both(key, q, c):
        if not q.num_rows or not c.num_rows:
            return empty
        sides = []
        for side in (q, c):
            ids, flat, *more = unpack(side.column("body")[0].as_py())
            sides.append((ids, flat.reshape(len(ids), -1), *more))
        return run(*sides)

    across = lambda df, name, other, n: df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumnRenamed("block", name)
    left = across(queries, "q", "c", n_candidates).groupBy("q", "c")
    right = across(candidates, "c", "q", n_queries).groupBy("q", "c")
    return left.cogroup(right).applyInArrow(both, schema)


def at_most(rows: DataFrame, k: int) -> DataFrame:
    """The rows, those that are equal in id and vector no more than ``k`` times."""
    copies = rows.groupBy("_id", "_v").agg(F.least(F.count("*"), F.lit(k)).alias("_n"))
    return copies.select("_id", "_v", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"))


def spread(n_rows: int, per_block: int, by: tuple[str, ...] = ("_id",)) -> tuple[int, Column]:
    """How many blocks, and the column that deals rows to them, by their ids or more."""
    n = max(1, -(-n_rows // per_block))
    return n, F.pmod(F.xxhash64(*by), F.lit(n))


def best_first(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of every row, ties to the smaller id; ids ascend with the columns."""
    if score.shape[1] > k:
        cut = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    else:
        cut = np.full(len(score), -np.inf)
    row, col = np.nonzero(score >= cut[:, None])
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]
