"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample of rows and is the only thing sent to
every task; every row is then put into its leaf. A query walks the tree best
bin first: a priority queue holds the nodes seen so far, and the most promising
one is opened next. How many leaves a query visits is calibrated: for a bounded
set of trial queries the exact neighbours are found in all rows, and the visits
are widened until the mean recall over the trials reaches ``recall``.

Leaves with many rows are dealt into chunks, and queries into parts, so that
one task never holds more than a chunk and a part; copies of a frequent vector
do not make a large task. Scores are taken in doubles on the original vectors.

Rows with a null id or vector, with null or non-finite components, or of zero
length take no part; shorter vectors count as filled with zeros; rows that
repeat an id count once, with the best score of their vectors. A query goes on
to further leaves until those hold more than k ids; with fewer than k
candidates all are returned.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from framewright.llm.blobs import pack, unpack_all
from framewright.llm.vectors import matrix, usable
from framewright.session import materialize


class Tree:
    """Centres of the nodes, level by level; the children of a node are next to each other."""

    def __init__(self, sample: np.ndarray, branches: int, leaf_rows: int, rounds: int = 12):
        self.centre: list[np.ndarray] = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        waiting, leaves = [(0, sample)], 0
        while waiting:
            node, rows = waiting.pop(0)
            parts = _k_means(rows, branches, rounds) if len(rows) > leaf_rows else []
            if len(parts) < 2:
                self.leaf[node], leaves = leaves, leaves + 1
                continue
            for centre, part in parts:
                self.children[node].append(len(self.centre))
                waiting.append((len(self.centre), part))
                self.centre.append(centre), self.children.append([]), self.leaf.append(-1)
        self.leaves = leaves
        self.centres = np.array(self.centre)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row: at each node the nearest centre."""
        node = np.zeros(len(rows), np.int64)
        leaf = np.array(self.leaf)
        open_ = np.flatnonzero(leaf[node] < 0)
        while len(open_):
            for parent in np.unique(node[open_]):
                here, kids = open_[node[open_] == parent], np.array(self.children[parent])
                c = self.centres[kids]
                node[here] = kids[np.argmin((c * c).sum(1) - 2 * rows[here] @ c.T, axis=1)]
            open_ = open_[leaf[node[open_]] < 0]
        return leaf[node]

    def best_bins(self, query: np.ndarray, visits: int, sizes: np.ndarray | None = None, enough: int = 0) -> list[int]:
        """The leaves to visit, the most promising first, and more while they hold fewer rows than ``enough``."""
        promise = self.centres @ query
        queue, out, held = [(-promise[0], 0)], [], 0
        while queue and (len(out) < visits or held < enough):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                held += int(sizes[self.leaf[node]]) if sizes is not None else 0
            for kid in self.children[node]:
                heapq.heappush(queue, (-promise[kid], kid))
        return out


def _k_means(rows: np.ndarray, k: int, rounds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centres and their rows. The sample is in the order of a hash, so its first rows are a fair start."""
    centres = np.unique(rows[:k], axis=0)
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * rows @ centres.T, axis=1)
        used = np.unique(near)
        centres = np.stack([rows[near == c].mean(0) for c in used])
    near = np.argmin((centres * centres).sum(1) - 2 * rows @ centres.T, axis=1)
    return [(centres[c], rows[near == c]) for c in np.unique(near)]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row; equal vectors give equal scores wherever they are."""
    return (a * b).sum(1)


def _best_pairs(q_ids, q, ids, c, k: int):
    """Query row, candidate row and score of each query's k best candidates other than itself."""
    rough = np.where(q_ids[:, None] == ids, -np.inf, q @ c.T)
    if len(ids) > k:
        cut = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
        row, col = np.nonzero(rough >= (cut - 1e-9 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0))))[:, None])
    else:
        row, col = np.nonzero(np.isfinite(rough))
    keep = np.isfinite(rough[row, col])
    row, col = row[keep], col[keep]
    score = exact_scores(q[row], c[col])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k], score[place < k]


def best_of_task(batches, k: int, held_rows: int = 1 << 20):
    """The k best distinct ids of each query among a task's pairs, before they are shuffled.

    About ``held_rows`` pairs are held at a time; what cannot be made fewer is sent on.
    """
    held, n = [], 0

    def best() -> pa.RecordBatch:
        query, vec, score = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3))
        for by_id in (True, False):  # each id once, with its best score; then the best ids
            order = np.lexsort((-score, vec, query) if by_id else (vec, -score, query))
            query, vec, score = query[order], vec[order], score[order]
            if by_id:
                keep = np.r_[True, (np.diff(query) != 0) | (np.diff(vec) != 0)][: len(query)]
            else:
                keep = np.arange(len(query)) - np.searchsorted(query, query) < k
            query, vec, score = query[keep], vec[keep], score[keep]
        return pa.RecordBatch.from_pydict(_scored(query, vec, score))

    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= held_rows:
            held = [best()]
            n = held[0].num_rows
            if n > held_rows // 2:
                yield held[0]
                held, n = [], 0
    if held:
        yield best()


def _scored(query, vec, score, **more) -> dict:
    return {"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())} | more


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    recall: float = 0.96,
    sample_rows: int = 20_000,
    trials: int = 256,
    branches: int = 16,
    leaf_rows: int = 100,
    chunk_rows: int = 2048,
    part_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest found. ``sample_rows`` and ``trials`` bound what the driver holds."""
    directed = lambda df: df.where(F.exists("_v", lambda x: x != 0))
    rows, asked = directed(usable(vectors, vec_id, vector)), directed(usable(queries, vec_id, vector))
    width = max(df.agg(F.max(F.size("_v"))).first()[0] or 1 for df in (rows, asked))

    def drawn(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        found = rows.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(n).collect()
        m = np.zeros((len(found), width))
        for out, r in zip(m, found):
            out[: len(r["_v"])] = r["_v"]
        return np.array([r["_id"] for r in found], np.int64), m

    tree = Tree(drawn(1, sample_rows)[1], branches, leaf_rows)
    trial_ids, trial = drawn(2, trials)

    def place(batches):
        for batch in batches:
            leaf = tree.assign(matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["_id", "_v", "leaf"])

    placed = materialize(rows.mapInArrow(place, "_id long, _v array<double>, leaf int"), "placed")
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.countDistinct("_id").alias("n")).collect()}  # one row a leaf
    rows_in = np.array([sizes.get(leaf, 0) for leaf in range(tree.leaves)])
    chunks = -(-rows_in // chunk_rows)

    def try_out(batches):
        for batch in batches:
            ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            row, col, score = _best_pairs(trial_ids, trial, ids, matrix(batch.column(1), width), k)
            yield pa.RecordBatch.from_pydict(_scored(trial_ids[row], ids[col], score, leaf=pa.array(leaf[col], pa.int32())))

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    tried = placed.mapInArrow(try_out, "query_id long, vec_id long, score double, leaf int")
    true = tried.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "leaf").collect()
    visits = calibrated_visits(tree, dict(zip(trial_ids.tolist(), trial)), [(r[0], r[1]) for r in true], recall)

    n_parts = max(1, -(-asked.count() // part_rows))

    def visit(batches):
        for batch in batches:
            ids, m = batch.column(0).to_numpy(), matrix(batch.column(1), width)
            to: dict[tuple[int, int], list[int]] = {}
            for r, q in enumerate(m):
                for leaf in tree.best_bins(q, visits, rows_in, k + 1):
                    to.setdefault((leaf, int(ids[r]) % n_parts), []).append(r)
            out = [(leaf, chunk, part, pack(ids[r], m[r])) for (leaf, part), r in to.items() for chunk in range(chunks[leaf])]
            yield pa.RecordBatch.from_pydict({"leaf": pa.array([o[0] for o in out], pa.int32()), "chunk": pa.array([o[1] for o in out], pa.int32()), "part": pa.array([o[2] for o in out], pa.int32()), "body": pa.array([o[3] for o in out], pa.binary())})

    def keep(batches):
        for batch in batches:
            ids, leaf, m = batch.column(0).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(1), width)
            chunk = ids % np.maximum(chunks[leaf], 1)
            out = []
            for key in np.unique(leaf.astype(np.int64) << 32 | chunk):
                r = np.flatnonzero((leaf == key >> 32) & (chunk == (key & 0xFFFFFFFF)))
                out.append((int(key >> 32), int(key & 0xFFFFFFFF), pack(ids[r], m[r])))
            yield pa.RecordBatch.from_pydict({"leaf": pa.array([o[0] for o in out], pa.int32()), "chunk": pa.array([o[1] for o in out], pa.int32()), "body": pa.array([o[2] for o in out], pa.binary())})

    def compare(key, q, c):
        if not q.num_rows or not c.num_rows:
            return pa.table(_scored([], [], []))
        (q_ids, q), (ids, c) = _once(q), _once(c)
        row, col, score = _best_pairs(q_ids, q, ids, c, k)
        return pa.table(_scored(q_ids[row], ids[col], score))

    def _once(table):
        ids, flat = unpack_all(table.column("body").to_pylist())
        m = flat.reshape(len(ids), width)
        order = np.lexsort((*m.T[::-1], ids))
        order = order[np.r_[True, np.diff(ids[order]) != 0]]
        return ids[order], m[order]

    asked_cells = asked.select("_id", "_v").mapInArrow(visit, "leaf int, chunk int, part int, body binary")
    kept_cells = placed.mapInArrow(keep, "leaf int, chunk int, body binary").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    keys = ("leaf", "chunk", "part")
    found = asked_cells.groupBy(*keys).cogroup(kept_cells.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    found = found.mapInArrow(lambda batches: best_of_task(batches, k), found.schema)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrated_visits(tree: Tree, trial: dict[int, np.ndarray], true: list[tuple[int, int]], recall: float) -> int:
    """The fewest visits with which the trials find that share of their true neighbours' leaves."""
    place = {i: {leaf: n for n, leaf in enumerate(tree.best_bins(q, tree.leaves))} for i, q in trial.items()}
    needed = np.sort([place[i][leaf] for i, leaf in true]) if true else np.zeros(0)
    visits = 1
    while visits < tree.leaves and (needed < visits).mean() < recall if len(needed) else False:
        visits += max(1, visits // 16)
    return min(visits, tree.leaves)
