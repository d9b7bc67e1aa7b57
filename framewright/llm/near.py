"""Near copies by the Jaccard similarity of their word shingles.

Candidates come from two searches. One is that of ``simhash``: fingerprints
within ``distance`` bits, found with pigeonring; texts of one fingerprint meet
the first of them, and the first ones meet along the links. Pairs at 0.8 mostly
differ in more bits than pigeonring can use as a key, so MinHash signatures add
those that agree on all ``ROWS`` values of one of ``BANDS`` bands. No candidate
is believed: only an exact similarity of the shingle sets of at least ``least``
is a link. At a similarity of 0.8 a pair shares no band with a probability of
about 5 in a million, above it with less; such a pair is missed if the
fingerprints do not bring it either.

Equal texts are one node, told by their SHA-256. A node's number is a 64-bit
hash of that; texts that share a number with another are given new ones until
none does. Each node is first compared with the smallest node
of its bands, which links most groups of copies at a linear cost. Bands whose
nodes are not all connected by then are compared in full, until they are.
Large bands are cut into blocks, and every two blocks meet in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framewright.llm.blobs import pieces
from framewright.llm.components import connected_components
from framewright.llm.simhash import fingerprints, near_links, shingle_hashes
from framewright.session import materialize

BANDS, ROWS = 40, 6
BLOCK = 500_000  # shingles of a block
FINGERPRINT_SIZE, DISTANCE = 3, 3  # words of a shingle, and bits, of the SimHash search
_WORDS_AT_ONCE = 1 << 17
_ROUNDING = 1e-9


def _mixed(n: int, seed: int) -> np.ndarray:
    """Fixed 64-bit constants from a counter."""
    x = np.arange(1 + seed * n, 1 + (seed + 1) * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_XOR, _TIMES = _mixed(BANDS * ROWS, 0), _mixed(BANDS * ROWS, 1) | np.uint64(1)


def shingles(text: str | None, size: int):
    """Shingle hashes of the text, some at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    for lo in range(0, max(1, len(words) - size + 1), _WORDS_AT_ONCE):
        found = shingle_hashes(words[lo : lo + _WORDS_AT_ONCE + size - 1], size)
        if found:
            yield np.array(found, np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(text, size)]))


def band_keys(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The keys of the bands of each text; none without a word."""
    least = np.full((len(texts), BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64)
    seen = np.zeros(len(texts), bool)
    owner: list[int] = []
    parts: list[np.ndarray] = []

    def flush():
        if parts:
            hashes = np.concatenate(parts)
            starts = np.cumsum([0, *map(len, parts[:-1])])
            for k in range(BANDS * ROWS):
                np.minimum.at(least[:, k], owner, np.minimum.reduceat((hashes ^ _XOR[k]) * _TIMES[k], starts))
            seen[owner] = True
            owner.clear(), parts.clear()

    held = 0
    for k, text in enumerate(texts):
        for found in shingles(text, size):
            owner.append(k), parts.append(found)
            held += len(found)
            if held >= _WORDS_AT_ONCE:
                flush()
                held = 0
    flush()
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(texts), 1))
    for row in range(ROWS):
        key = (key ^ least[:, row::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return [k.view(np.int64) if s else key[:0, 0].view(np.int64) for k, s in zip(key, seen)]


def links_among(label: np.ndarray, values: np.ndarray, n: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of sets that link, enough to connect all that do; sets of the same label are connected already."""
    ids = np.unique(values, return_inverse=True)[1]
    ends = np.cumsum(n)
    mark = np.zeros(len(ids) and int(ids.max()) + 1, np.int32)
    waiting, held, queue, left, right = np.arange(len(n)), ids, [], [], []
    while len(waiting):
        now = queue.pop() if queue else waiting[0]
        own = ids[ends[now] - n[now] : ends[now]]
        mark[own] = 1
        both = np.add.reduceat(mark[held], np.cumsum(n[waiting]) - n[waiting])
        mark[own] = 0
        same = label[waiting] == label[now]
        near = ~same & (both >= least * (n[now] + n[waiting] - both) - _ROUNDING)
        right.append(waiting[near]), left.append(np.full(near.sum(), now))
        found = near | same
        if found.any():
            queue.extend(k for k in waiting[found] if k != now)
            held = held[np.repeat(~found, n[waiting])]
            waiting = waiting[~found]
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "uv")
    both = F.size(F.array_intersect("of_u", "of_v"))
    return pairs.join(a, "u").join(b, "v").where(both >= least * (F.size("of_u") + F.size("of_v") - both) - _ROUNDING).select("u", "v")


def _roots(nodes: DataFrame, links: DataFrame, node: str, root: str) -> DataFrame:
    """``nodes`` with ``root``: the smallest node connected to ``node``, or the node itself."""
    found = connected_components(links).select(F.col("node").alias("_linked"), F.col("root").alias("_to"))
    return nodes.join(found, nodes[node] == found["_linked"], "left").withColumn(root, F.coalesce("_to", node)).drop("_linked", "_to")


def _digest(text: str):
    return F.coalesce(F.sha2(F.col(text), 256), F.lit(""))


def _number(digest: str, attempt: int):
    return F.xxhash64(F.lit(attempt), digest)


def _numbered(prints: DataFrame, label: str) -> DataFrame:
    """``prints`` with ``_node``, a number that only rows of the same ``_sha`` share; stored."""
    prints, attempt = prints.withColumn("_node", _number("_sha", 0)), 0
    while True:
        prints, attempt = materialize(prints, label), attempt + 1
        clash = prints.groupBy("_node").agg(F.min("_sha").alias("_low"), F.max("_sha").alias("_high")).where("_low <> _high")
        if clash.isEmpty():
            return prints
        anew = F.when(F.col("_low") < F.col("_sha"), _number("_sha", attempt)).otherwise(F.col("_node"))
        prints = prints.join(clash.select("_node", "_low"), "_node", "left").withColumn("_node", anew).drop("_low")


def fingerprint_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs ``u``, ``v`` of ``_node`` whose ``_fp`` are equal or within the distance, enough to connect all that are."""
    first = nodes.groupBy("_fp").agg(F.min("_node").alias("_low"))
    equal = nodes.join(first, "_fp").where("_node <> _low").select(F.col("_low").alias("u"), F.col("_node").alias("v"))
    a, b = (first.select(F.col("_fp").alias(f"_fp_{x}"), F.col("_low").alias(x)) for x in "uv")
    links = near_links(first, distance).select(F.col("u").alias("_fp_u"), F.col("v").alias("_fp_v"))
    near = links.join(a, "_fp_u").join(b, "_fp_v")
    return equal.union(near.select(F.least("u", "v"), F.greatest("u", "v"))).distinct()


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """``_sha``, ``_id``, ``_least`` of every row: its text's digest, its id, and the smallest id it is connected to."""

    def key(batches):
        for batch in pieces(batches, "_text", 8 << 20):
            texts = batch.column(0).to_pylist()
            keys, prints = band_keys(texts, size), fingerprints(texts, FINGERPRINT_SIZE).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(keys, pa.list_(pa.int64())), pa.array(prints)], names=["_id", "_sha", "_keys", "_fp"]
            )

    def cut(batches):
        for batch in pieces(batches, "_text", 8 << 20):
            sets = [shingle_set(t, size).view(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    def compare(rows):
        node, sets = rows.column("node").to_numpy(), rows.column("shingles").combine_chunks()
        n = np.diff(sets.offsets.to_numpy())
        u, v = links_among(rows.column("label").to_numpy(), sets.flatten().to_numpy(), n, least)
        label = rows.column("label").to_numpy()
        return pa.table({"u": label[u], "v": label[v]}) if len(node) else pa.table({"u": node, "v": node})

    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("_id"), _digest(text).alias("_sha"))
    prints = _numbered(source.mapInArrow(key, f"_id {kind}, _sha string, _keys array<long>, _fp long"), "bands")
    nodes = prints.groupBy("_node").agg(F.min("_id").alias("_first"), F.first("_keys").alias("_keys"), F.first("_fp").alias("_fp"))
    worded = nodes.where(F.size("_keys") > 0).select("_node", "_fp")  # texts without words are linked to equal ones only
    alike = materialize(fingerprint_pairs(worded, DISTANCE), "alike")
    keyed = nodes.select(F.col("_node").alias("node"), F.explode("_keys").alias("key"))
    many = keyed.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    shared = materialize(keyed.join(many, "key"), "shared")

    meeting = shared.select("node").union(alike.select("u")).union(alike.select("v"))
    involved = meeting.select(F.col("node").alias("_node")).distinct().join(prints, "_node").groupBy("_node").agg(F.min("_id").alias("_first"), F.first("_sha").alias("_key"))
    one = source.join(involved, (source["_sha"] == involved["_key"]) & source["_id"].eqNullSafe(involved["_first"])).select("_text", "_node")
    sets = materialize(one.mapInArrow(cut, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    pairs = shared.where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v")).union(alike).distinct()
    labels = materialize(_roots(sets.select("node", F.size("shingles").alias("n")), _verified(pairs, sets, least), "node", "label"), "labels")

    told = shared.select("key", "node").join(labels, "node")
    open_keys = told.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.sum("n").alias("all")).where("a <> b")
    blocks = open_keys.select("key", F.ceil(F.col("all") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node", "key"), "blocks").cast("int")
    met = told.join(blocks, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "label")
    more = met.join(sets, "node").groupBy("key", "lo", "hi").applyInArrow(compare, "u long, v long")
    rooted = _roots(labels, more, "label", "root").select(F.col("node").alias("_node"), F.col("root").alias("_root"))

    firsts = prints.groupBy("_node").agg(F.min("_id").alias("_first")).join(rooted, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    firsts = materialize(firsts, "roots")
    known = firsts.join(firsts.groupBy("_root").agg(F.min("_first").alias("_least")), "_root").select("_node", "_least")
    return prints.select("_node", "_sha", "_id").join(known, "_node").drop("_node")


def keep_first_of_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """The documents without those connected to one with a smaller id.

    Documents are linked if the sets of their runs of ``size`` words have a
    Jaccard similarity of ``least`` or more; fewer words are one run. Texts
    without words, and nulls, are linked to equal ones only. A null id is
    larger than any other. Rows that repeat the smallest id itself all stay.
    """
    found = near_copies(docs, doc_id, text, size, least)
    gone = found.where(~F.col("_id").eqNullSafe(F.col("_least"))).select("_sha", "_id").distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["_id"]) & (_digest(text) == gone["_sha"]), "left_anti")
