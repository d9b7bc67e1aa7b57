"""The prefix trie of conversations, and what sharing its prefixes saves.

Conversations are rebuilt first: the opening turns of the conversation at the
head of each group of ids, then the own turns after as many. A node is a
distinct sequence of first turns; conversations that begin with it are its
members.

1. A turn becomes two 60-bit numbers of its SHA-256 and a count of words; no
   text travels any further. The turns are range-sorted, so a conversation of
   any length is spread, and one pass per partition gives each turn its place
   and the key of the turns up to it: two polynomials in the turns' numbers
   modulo 2^61 - 1. Only what the last conversation of a partition has so far
   goes to the driver, one row a partition, for the partitions that follow.
2. A rebuilt conversation has the group's opening key, then its own keys moved
   by a difference that is the same for all its turns.
3. Equal keys of the same depth are a node, named by its smallest member and
   its depth. Nodes of the same name form a path, so only the top of each path
   has to look up its parent. Keys with over a thousandth of the rows, of
   which there are a thousand at most, are joined by broadcast.
4. Children are numbered next to each other. Every node has an arc in and an
   arc out; an arc's successor follows from the numbers: the first child, the
   next sibling, or the parent. ``listrank`` ranks this tour, with prefix sums
   of leaves and savings, and a node's subtree is what its arcs enclose.

The digest of the conversations that end in a node needs them in order. They
are range-sorted and joined to strings of ``_RUN`` ids; one stream a node
then hashes the strings, holding none of them.

Nulls: a null role or text is empty, a null turn comes first; rows with a null
conversation id belong to none and are left out. Turns of equal number come in
the order of role and digest; repeated rows are repeated turns. Remainders of
negative ids are SQL's, rounded to zero. An empty table has no conversation
and no root: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from framewright.llm.listrank import BLOCK, LIMIT, list_sums
from framewright.operators.indexing import dense_index
from framewright.session import materialize

_PRIME = (1 << 61) - 1
_BASES = (0x1B873593CC9E2D51, 0x05EBCA6B85EBCA77)
_BACK = tuple(pow(b, -1, _PRIME) for b in _BASES)
_RUN = 1024
#: keys with more than this share of the rows are joined by broadcast: at most 1 / share
_SHARE = 0.001


def _words(text):
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _turn_numbers(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    number = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    read = turns.where(F.col(conv_id).isNotNull())
    return read.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), role.alias("role"), number(1).alias("x1"), number(16).alias("x2"), _words(text).alias("words"))


_PREFIX = ["conv", "part", "nth", "s1", "s2", "p1", "p2", "words", "edge"]
_PREFIX_SCHEMA = "conv long, part int, nth long, s1 long, s2 long, p1 long, p2 long, words long, edge boolean"


def _batch(rows: list[tuple], names: list[str], kinds) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


_PREFIX_KINDS = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.bool_()]


def _prefixes(batches):
    """Place and key of each turn within its partition; a last row tells where the partition's last conversation stands."""
    part, conv = TaskContext.get().partitionId(), None
    nth = s1 = s2 = 0
    for batch in batches:
        rows = []
        for c, x1, x2, words in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if c != conv:
                conv, nth, s1, s2, b1, b2 = c, 0, 0, 0, *_BASES
            nth, p1, p2 = nth + 1, s1, s2
            s1, s2 = (s1 + x1 * b1) % _PRIME, (s2 + x2 * b2) % _PRIME
            b1, b2 = b1 * _BASES[0] % _PRIME, b2 * _BASES[1] % _PRIME
            rows.append((c, part, nth, s1, s2, p1, p2, words, False))
        yield _batch(rows, _PREFIX, _PREFIX_KINDS)
    if conv is not None:
        yield _batch([(conv, part, nth, s1, s2, 0, 0, 0, True)], _PREFIX, _PREFIX_KINDS)


def _carried(edges: list[tuple]) -> dict[int, tuple[int, int, int, int]]:
    """For each partition, the conversation that it may go on with: id, turns and key so far."""
    out, so_far = {}, None
    for part, conv, nth, s1, s2 in sorted(edges):
        if so_far is not None:
            out[part] = so_far
        if so_far is not None and so_far[0] == conv:
            _, n, a1, a2 = so_far
            so_far = (conv, n + nth, (a1 + s1 * pow(_BASES[0], n, _PRIME)) % _PRIME, (a2 + s2 * pow(_BASES[1], n, _PRIME)) % _PRIME)
        else:
            so_far = (conv, nth, s1, s2)
    return out


def _placed_turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, nth, key and the key before it, words of every turn."""
    spark = turns.sparkSession
    order = ["conv", "turn", "role", "x1", "x2"]
    sorted_ = _turn_numbers(turns, conv_id, turn, role, text)
    sorted_ = sorted_.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    stored = materialize(sorted_.select("conv", "x1", "x2", "words").mapInArrow(_prefixes, _PREFIX_SCHEMA), "prefixes")
    edges = stored.where("edge").select("part", "conv", "nth", "s1", "s2").collect()  # one row a partition
    carried = _carried([tuple(e) for e in edges])

    def carry(batches):
        for batch in batches:
            columns = {n: batch.column(k).to_numpy(zero_copy_only=False).copy() for k, n in enumerate(names)}
            for part in np.unique(columns["part"]).tolist():
                conv, n, *so_far = carried.get(part, (0, 0, 0, 0))
                if not n:
                    continue
                for k in np.flatnonzero((columns["part"] == part) & (columns["conv"] == conv)).tolist():
                    for name, base, a in (("s1", 0, 0), ("s2", 1, 1), ("p1", 0, 0), ("p2", 1, 1)):
                        columns[name][k] = (so_far[a] + int(columns[name][k]) * pow(_BASES[base], n, _PRIME)) % _PRIME
                    columns["nth"][k] += n
            yield pa.RecordBatch.from_arrays([pa.array(columns[n]) for n in names if n != "part"], names=[n for n in names if n != "part"])

    names = ["conv", "part", "nth", "s1", "s2", "p1", "p2", "words"]
    return stored.where("NOT edge").select(*names).mapInArrow(carry, "conv long, nth long, s1 long, s2 long, p1 long, p2 long, words long")


def _spread_join(rows: DataFrame, one: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """``rows`` joined with the only row of ``one`` for their keys, however many rows a key has.

    ``counts`` holds the keys and ``n``, their rows. Those with more than
    ``_SHARE`` of all rows, at most 1 / ``_SHARE`` keys, are broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = materialize(one.join(F.broadcast(counts.where(F.col("n") > _SHARE * total).select(*keys)), keys), "heavy")
    often = rows.join(F.broadcast(heavy), keys)
    others = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(one, keys)
    return often.unionByName(others)


_REBUILT = ["conv", "depth", "k1", "k2", "p1", "p2", "words", "ends"]


def rebuilt_turns(turns: DataFrame, group: int, most: int, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one included: conv, depth, its key, the key before, words of its last turn, ends."""
    placed = materialize(_placed_turns(turns, conv_id, turn, role, text), "turns")
    opening = F.when(F.col("nth") < most, F.struct("nth", "s1", "s2", "p1", "p2", "words"))
    convs = placed.groupBy("conv").agg(F.max("nth").alias("n"), F.sort_array(F.collect_list(opening)).alias("own"))
    convs = convs.withColumn("head", F.col("conv") - F.col("conv") % group)
    heads = convs.select(F.col("conv").alias("head"), F.col("own").alias("lent"))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    plan = convs.join(heads, "head", "left").withColumn("h", taken)
    plan = plan.withColumn("lent", F.filter("lent", lambda t: t["nth"] <= F.col("h"))).withColumn("a", F.greatest(F.size("lent"), F.lit(0)).cast("long"))
    last, mine = F.get("lent", F.col("a").cast("int") - 1), F.get("own", F.col("h").cast("int") - 1)
    key = lambda of, name: F.coalesce(of[name], F.lit(0).cast("long"))
    plan = plan.select(
        "conv", "n", "h", "a", "lent", (F.col("a") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("total"),
        *[key(last, f"s{k}").alias(f"g{k}") for k in (1, 2)], *[key(mine, f"s{k}").alias(f"o{k}") for k in (1, 2)],
    )
    plan = materialize(plan, "plan")

    def moved(batches):
        for batch in batches:
            rows = []
            for conv, nth, s1, s2, p1, p2, words, h, a, total, g1, g2, o1, o2 in zip(*(c.to_pylist() for c in batch.columns)):
                f1, f2 = (pow(b, h - a, _PRIME) for b in _BACK) if h != a else (1, 1)
                keys = ((g1 + (s1 - o1) * f1) % _PRIME, (g2 + (s2 - o2) * f2) % _PRIME, (g1 + (p1 - o1) * f1) % _PRIME, (g2 + (p2 - o2) * f2) % _PRIME)
                rows.append((conv, nth - h + a, *keys, words, nth - h + a == total))
            yield _batch(rows, _REBUILT, [*[pa.int64()] * 7, pa.bool_()])

    constants = plan.where("n > h").select("conv", "h", "a", "total", "g1", "g2", "o1", "o2")
    own = _spread_join(placed, constants, ["conv"], plan.select("conv", "n")).where("nth > h")
    own = own.select("conv", "nth", "s1", "s2", "p1", "p2", "words", "h", "a", "total", "g1", "g2", "o1", "o2")
    own = own.mapInArrow(moved, "conv long, depth long, k1 long, k2 long, p1 long, p2 long, words long, ends boolean")
    lent = plan.select("conv", "total", F.explode("lent").alias("t")).select("conv", F.col("t.nth").alias("depth"), F.col("t.s1").alias("k1"), F.col("t.s2").alias("k2"), "t.p1", "t.p2", "t.words", (F.col("t.nth") == F.col("total")).alias("ends"))
    zero = F.lit(0).cast("long")
    empty = plan.select("conv", *[zero.alias(c) for c in _REBUILT[1:-1]], (F.col("total") == 0).alias("ends"))
    return own.unionByName(lent).unionByName(empty)


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with ``parent_conv_id``; the parent of all but the top of a path has the node's own name."""
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth"), F.min_by(F.struct("p1", "p2"), "depth").alias("p")).where("depth > 0")
    keys = ["d", "k1", "k2"]
    tops = materialize(tops.select("conv_id", "depth", (F.col("depth") - 1).alias("d"), F.col("p.p1").alias("k1"), F.col("p.p2").alias("k2")), "tops")
    parents = nodes.select(F.col("depth").alias("d"), "k1", "k2", F.col("conv_id").alias("_parent"))
    found = _spread_join(tops, parents, keys, tops.groupBy(*keys).agg(F.count("*").alias("n"))).select("conv_id", "depth", "_parent")
    parent = F.when(F.col("depth") > 0, F.coalesce("_parent", "conv_id"))
    return nodes.join(found, ["conv_id", "depth"], "left").withColumn("parent_conv_id", parent).drop("_parent", "p1", "p2")


def _tour(nodes: DataFrame) -> DataFrame:
    """Nodes with a number, their children's first and last number and count, and ``up``, the parent's number if they are its last child."""
    placed = dense_index(nodes, ["parent_conv_id", "depth", "conv_id"], name="g")
    kids = placed.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    kids = kids.agg(F.count("*").alias("n_children"), F.min("g").alias("first"), F.max("g").alias("last"))
    tour = placed.join(kids, ["conv_id", "depth"], "left")
    up = tour.where("last IS NOT NULL").select(F.col("last").alias("g"), F.col("g").alias("up"))
    return tour.join(up, "g", "left")


def _arcs(tour: DataFrame) -> DataFrame:
    g, zero = F.col("g"), F.lit(0).cast("long")
    into = F.struct(
        (2 * g).alias("id"), F.coalesce(2 * F.col("first"), 2 * g + 1).alias("next"),
        F.when(F.col("first").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    beyond = F.when(F.col("depth") > 0, F.coalesce(2 * F.col("up") + 1, 2 * (g + 1)))
    out = F.struct((2 * g + 1).alias("id"), beyond.alias("next"), zero.alias("leaves"), zero.alias("saved"))
    return tour.select(F.inline(F.array(into, out))).withColumn("place", F.lit(1).cast("long"))


def _end_digests(rebuilt: DataFrame) -> DataFrame:
    """Digest of the ids that end in each node that has some."""
    keys = ["depth", "k1", "k2"]
    n = int(rebuilt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = [*keys, "first", "ids"], [*[pa.int64()] * 4, pa.string()]

    def runs(batches):
        node, held = None, []
        for batch in batches:
            rows = []
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node or len(held) == _RUN:
                    if held:
                        rows.append((*node, held[0], ",".join(map(str, held))))
                    node, held = key, []
                held.append(conv)
            yield _batch(rows, names, kinds)
        if held:
            yield _batch([(*node, held[0], ",".join(map(str, held)))], names, kinds)

    def digests(batches):
        node, digest = None, None
        for batch in batches:
            rows = []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node:
                    if digest is not None:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield _batch(rows, [*keys, "ends"], [*kinds[:3], pa.string()])
        if digest is not None:
            yield _batch([(*node, digest.hexdigest())], [*keys, "ends"], [*kinds[:3], pa.string()])

    ends = rebuilt.where("ends").select(*keys, "conv").repartitionByRange(n, *keys, "conv").sortWithinPartitions(*keys, "conv")
    joined = ends.mapInArrow(runs, "depth long, k1 long, k2 long, first long, ids string")
    dealt = joined.repartition(n, *keys).sortWithinPartitions(*keys, "first").select(*keys, "ids")
    return dealt.mapInArrow(digests, "depth long, k1 long, k2 long, ends string")


def prefix_trie(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    group: int = 20,
    most: int = 4,
    block: int = BLOCK,
    limit: int = LIMIT,
) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the tour's enter and exit places.

    Conversation c takes its first turns, fewer than ``most``, from the one at
    the head of its ``group`` ids.
    """
    rebuilt = materialize(rebuilt_turns(turns, group, most, conv_id, turn, role, text), "rebuilt")
    nodes = rebuilt.groupBy("depth", "k1", "k2").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words")
    )
    tour = materialize(_tour(_with_parents(materialize(nodes, "nodes"))), "tour")
    sums = list_sums(materialize(_arcs(tour), "arcs"), ["leaves", "saved", "place"], block, limit)
    side = F.when(F.col("id") % 2 == 0, -1).otherwise(1)
    spans = sums.groupBy(F.floor(F.col("id") / 2).alias("g")).agg(
        F.sum(side * F.col("leaves")).alias("n_leaves"), F.sum(side * F.col("saved")).alias("saved_tokens"), F.min("place").alias("enter"), F.max("place").alias("exit")
    )
    none = hashlib.sha256().hexdigest()
    done = tour.join(spans, "g").join(_end_digests(rebuilt), ["depth", "k1", "k2"], "left")
    return done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(none)).alias("ends_sha256"), "enter", "exit",
    )
