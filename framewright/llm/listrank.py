"""Prefix sums along a linked list that only Spark holds.

An element names the next one and has weights. Each round contracts the list
twice. Elements lie in blocks of bounded size by their place; in a block,
every chain of elements that follow each other becomes its head, with the
chain's weights. Of the heads, every one drawn by a hash whose predecessor is
not drawn is joined to that predecessor: a quarter of them on average,
however the list is laid out, so the number of rounds grows with the
logarithm of its length and each round's work shrinks. At ``limit`` elements
one task walks the rest. Going back, each element adds what its head has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framewright.operators.indexing import dense_index
from framewright.session import materialize

#: elements of a block, and those that one task may walk in the end
BLOCK, LIMIT = 1 << 16, 1 << 17


def chains_of(ids: np.ndarray, following: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Head of each element's chain, the weights from there to it, and the last element of the chain that it heads (-1: none).

    A chain goes on while the next element is among ``ids``; ``following`` is -1 at the list's end.
    """
    order = np.argsort(ids)
    at = np.searchsorted(ids[order], following).clip(max=len(ids) - 1)
    here = np.where(ids[order][at] == following, order[at], -1)
    inner = np.zeros(len(ids), bool)
    inner[here[here >= 0]] = True
    head, last, before = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64), np.zeros_like(weights)
    step, own = here.tolist(), weights.tolist()
    for first in np.flatnonzero(~inner).tolist():
        now, sums, members = first, [0] * weights.shape[1], []
        reached = []
        while now >= 0:
            members.append(now), reached.append(sums)
            sums = [a + b for a, b in zip(sums, own[now])]
            end, now = now, step[now]
        head[members], before[members], last[first] = ids[first], reached, end
    return head, before, last


def _columns(rows: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy() for c in names], axis=1)


def list_sums(elements: DataFrame, weights: list[str], block: int = BLOCK, limit: int = LIMIT, level: int = 0) -> DataFrame:
    """``id`` and, under the names of the weights, the sums over all elements before it.

    ``elements`` is a stored table of ``id``, ``next`` (null at the end) and
    weights, numbers that are not null. At the first level ids are dense.
    """
    kinds = ", ".join(f"{w} long" for w in weights)

    def contract(rows: pa.Table) -> pa.Table:
        ids, following = rows.column("id").to_numpy(), rows.column("next").fill_null(-1).to_numpy()
        own = _columns(rows, weights)
        head, before, last = chains_of(ids, following, own)
        first = last >= 0
        out = {"id": pa.array(ids), "head": pa.array(head)} | {w: pa.array(before[:, k]) for k, w in enumerate(weights)}
        ahead = np.where(first, following[last], -1)
        out["next"] = pa.array(ahead, mask=ahead < 0)
        total = np.where(first[:, None], before[last] + own[last], 0)
        return pa.table(out | {f"all_{w}": pa.array(total[:, k]) for k, w in enumerate(weights)})

    schema = f"id long, head long, {kinds}, next long, " + ", ".join(f"all_{w} long" for w in weights)
    if elements.count() <= limit:
        return elements.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(contract, schema).select("id", *weights)

    placed = elements.withColumn("_at", F.col("id")) if level == 0 else dense_index(elements, ["id"], name="_at")
    chains = materialize(placed.groupBy(F.floor(F.col("_at") / block)).applyInArrow(contract, schema), "chains")
    heads = chains.where("id = head").select("id", "next", *[F.col(f"all_{w}").alias(w) for w in weights])

    drawn = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2)) == 0
    joined = heads.where(drawn).select(F.col("id").alias("gone"), F.col("next").alias("gone_next"), *[F.col(w).alias(f"gone_{w}") for w in weights])
    pairs = heads.join(joined, (heads["next"] == joined["gone"]) & ~drawn, "left")
    pairs = materialize(pairs, "pairs")
    gone = pairs.where("gone IS NOT NULL")
    left = pairs.join(gone.select(F.col("gone").alias("id")), "id", "left_anti").select(
        "id",
        F.when(F.col("gone").isNotNull(), F.col("gone_next")).otherwise(F.col("next")).alias("next"),
        *[(F.col(w) + F.coalesce(f"gone_{w}", F.lit(0))).alias(w) for w in weights],
    )
    known = materialize(list_sums(materialize(left, "list"), weights, block, limit, level + 1), "sums")
    again = gone.select("id", "gone", *[F.col(w).alias(f"own_{w}") for w in weights]).join(known, "id")
    known = known.unionByName(again.select(F.col("gone").alias("id"), *[(F.col(w) + F.col(f"own_{w}")).alias(w) for w in weights]))
    known = known.select(F.col("id").alias("head"), *[F.col(w).alias(f"to_{w}") for w in weights])
    return chains.join(known, "head").select("id", *[(F.col(w) + F.col(f"to_{w}")).alias(w) for w in weights])
