"""Removal of byte strings that earlier documents already hold.

A byte goes if a string of ``window`` bytes that covers it also starts in a
document with a smaller id. Every window has one anchor: the leftmost of its
``gram`` byte strings with the smallest hash. Equal windows have equal anchors,
so only suffixes at anchors need sorting, about one in seventeen.

1. Each piece of the corpus sends the hashes of its anchors to buckets, once
   for each hash and document; a hash that repeats inside the piece is sent
   once, so a passage that a third of the corpus shares stays small.
2. A bucket reports the anchors that two documents share.
3. Those anchors go to their buckets again, with the bytes that their windows
   cover. A stretch that an earlier document of the same shard has in full is
   decided there and not sent.
4. In a bucket, equal stretches become one. The suffixes to the right of the
   anchors, and the reversed ones to the left, are sorted by mergesort. Two
   suffixes are compared by the longest common extension, found by binary
   search over prefix polynomial hashes. The order is then verified on the bytes; a collision restarts the
   sort with other coefficients. Two windows at the same distance from their
   anchor are equal if nothing shorter lies between them in either order.
5. The removed ranges meet their documents.

Tables that cross the network: one hash an anchor, the bytes around shared
anchors, and the documents once, dealt into shards for steps 3 and 5.

Nulls: a null text is empty; a null id counts as larger than all others. Rows
with the same id do not remove from each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framewright.llm.blobs import buckets, delta, encoded, pack, pieces, split_by, unpack, unpack_all

WINDOW, GRAM = 50, 16
_LAST_ID = (1 << 63) - 1
_TABLE = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_TABLE = (_TABLE ^ (_TABLE >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
_TABLE = (_TABLE ^ (_TABLE >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
_FOLDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_AT_ONCE = 1 << 17
_PIECE = 16 << 20
_SHARD_PRIME = 1_000_003
#: bytes of the stretches that are sorted at once
_STRIP = 1 << 20
#: bytes of text for which a bucket and a shard are worth while: every bucket may write a row for every shard
_BUCKET_BYTES = 8 << 20


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes at every position that has them."""
    h, size = _TABLE[data], 1
    for factor in _FOLDS:
        h = h[:-size] * factor + h[size:]
        h ^= h >> np.uint64(32)
        size *= 2
    return h * _FOLDS[0]


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Position, first and last window, and hash of the anchors of the documents that end at ``ends``."""
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    long = ends - starts >= WINDOW
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[long]] += 1
    edge[ends[long] - WINDOW + 1] -= 1
    valid = np.cumsum(edge, dtype=np.int8)
    found, span = [], WINDOW - GRAM + 1
    for lo in range(0, len(data) - WINDOW + 1, _AT_ONCE):
        part = data[lo : lo + _AT_ONCE + WINDOW - 1]
        h = _gram_hashes(part)
        low = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            low, size = np.minimum(low[:-size], low[size:]), size * 2
        if size < span:
            low = np.minimum(low[: size - span], low[span - size :])
        window = np.flatnonzero(valid[lo : lo + len(low)])
        at = (low[window] & np.uint64((1 << 20) - 1)).astype(np.int64)
        if not len(at):
            continue
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[new[1:], len(at)] - 1
        found.append((at[new] + lo, window[new] + lo, window[last] + lo, h[at[new]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def suffix_order(data: np.ndarray, start: np.ndarray, limit: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by group and bytes, and the common prefix of each with the one before it, -1 at a new group."""
    for seed in range(3):
        order = _merge_sort(data, start, limit, group, seed)
        common, sorted_ = _neighbours(data, start, limit, group, order)
        if sorted_:
            return order, common
    rank = sorted(range(len(start)), key=lambda i: (group[i], data[start[i] : start[i] + limit[i]].tobytes()))
    order = np.array(rank, np.int64)
    return order, _neighbours(data, start, limit, group, order)[0]


def _neighbours(data, start, limit, group, order) -> tuple[np.ndarray, bool]:
    """Common prefixes by comparing the bytes themselves, and whether the order is right."""
    s, m, g = start[order], limit[order], group[order]
    widest = int(m.max(initial=0))
    padded = np.r_[data, np.zeros(widest, np.uint8)]
    common, good = np.full(len(s), -1, np.int64), True
    step = np.arange(widest)
    for lo in range(1, len(s), 1 << 14):
        hi = min(lo + (1 << 14), len(s))
        both = np.minimum(m[lo - 1 : hi - 1], m[lo:hi])
        a, b = padded[s[lo - 1 : hi - 1, None] + step], padded[s[lo:hi, None] + step]
        differ = (a != b) | (step >= both[:, None])
        n = np.where(differ.any(1), differ.argmax(1), both) if widest else both
        at = np.minimum(n, max(widest - 1, 0))[:, None]
        if widest:
            below = np.take_along_axis(a, at, 1)[:, 0] < np.take_along_axis(b, at, 1)[:, 0]
            right = np.where(n < both, below, m[lo - 1 : hi - 1] <= m[lo:hi])
        else:
            right = np.ones(hi - lo, bool)
        same = g[lo:hi] == g[lo - 1 : hi - 1]
        good = good and bool((right | ~same).all())
        common[lo:hi] = np.where(same, n, -1)
    return common, good


def _merge_sort(data, start, limit, group, seed) -> np.ndarray:
    base = np.uint64(0x2545F4914F6CDD1D + 2 * seed)
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(data), base, np.uint64)])
    prefix = np.r_[np.uint64(0), np.cumsum(_TABLE[data] * power[: len(data)])]
    reach = 1 << int(limit.max(initial=1)).bit_length()

    def compare(x, y):
        """Sign of suffix x against suffix y, by their longest common extension."""
        a, b = start[x], start[y]
        most, n, step = np.minimum(limit[x], limit[y]), np.zeros(len(x), np.int64), reach
        base_a, base_b, power_a, power_b = prefix[a], prefix[b], power[a], power[b]
        while step:
            trial = np.minimum(n + step, most)
            equal = (prefix[a + trial] - base_a) * power_b == (prefix[b + trial] - base_b) * power_a
            n = np.where(equal, trial, n)
            step >>= 1
        at = np.minimum(n, most - 1).clip(0)
        byte = data[(a + at).clip(max=len(data) - 1)].astype(np.int16) - data[(b + at).clip(max=len(data) - 1)]
        return np.where(n < most, byte, limit[x] - limit[y])

    order = np.argsort(group, kind="stable")
    head = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(order) else order
    size = np.diff(np.r_[head, len(order)])
    first, size = np.repeat(head, size), np.repeat(size, size)
    width = 1
    while width < size.max(initial=0):
        here = np.flatnonzero(size > width)
        begin, end = first[here], first[here] + size[here]
        place = here - begin
        run = place // width
        other = begin + (run ^ 1) * width
        lo, hi = np.minimum(other, end), np.minimum(other + width, end)
        base_lo, mine, right = lo, order[here], (run & 1) == 1
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            sign = compare(order[mid], mine[open_])
            after = (sign < 0) | ((sign == 0) & right[open_])
            lo, hi = lo.copy(), hi.copy()
            lo[open_] = np.where(after, mid + 1, lo[open_])
            hi[open_] = np.where(after, hi[open_], mid)
        merged = order.copy()
        merged[begin + (run >> 1) * 2 * width + place % width + (lo - base_lo)] = mine
        order, width = merged, width * 2
    return order


def repeated_windows(data, begin, count, offset, group, ids) -> np.ndarray:
    """For each stretch and window in it, whether a smaller id has the same window.

    A stretch starts at ``begin`` and has ``count`` windows; its anchor lies
    ``offset`` bytes after the start.
    """
    n, widest = len(begin), WINDOW - GRAM
    anchor = begin + offset
    right, after = suffix_order(data, anchor, count + WINDOW - 1 - offset, group)
    left, before = suffix_order(data[::-1].copy(), len(data) - anchor, offset, group)
    right_rank, left_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    right_rank[right], left_rank[left] = np.arange(n), np.arange(n)
    repeated = np.zeros((n, widest + 1), bool)
    for o in range(widest + 1):  # the anchor lies o bytes after the window's start
        x = np.flatnonzero((offset - count < o) & (o <= offset))
        if not len(x):
            continue
        same_right = np.cumsum(after < WINDOW - o)[right_rank[x]]
        same_left = np.cumsum(before < o)[left_rank[x]]
        key = same_right * (n + 1) + same_left
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        least = np.minimum.reduceat(ids[x[order]], head)
        x, least = x[order], np.repeat(least, np.diff(np.r_[head, len(x)]))
        x = x[ids[x] > least]
        repeated[x, offset[x] - o] = True
    return repeated


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and length of the runs of true values in each row."""
    change = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(change == 1)
    return row, first, np.nonzero(change == -1)[1] - first


def _rows(name: str, rows: list[tuple[int, bytes]]) -> dict:
    return {name: pa.array([r[0] for r in rows], pa.int32()), "body": pa.array([r[1] for r in rows], pa.binary())}


def _shard(ids: np.ndarray, n: int) -> np.ndarray:
    return np.mod(ids, _SHARD_PRIME) % n


def _shard_column(doc_id: Column, n: int) -> Column:
    return (F.pmod(doc_id, F.lit(_SHARD_PRIME)) % n).cast("int")


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _ids(table) -> np.ndarray:
    column = table.column("_order")
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _send_hashes(batches, n: int):
    for batch in pieces(batches, "_text", _PIECE):
        data, ends = encoded(batch.column(1))
        at, _, _, h = anchors(data, ends)
        if not len(at):
            continue
        row = np.searchsorted(ends, at, side="right")
        ids, at = _ids(batch)[row], (at - np.r_[0, ends][row]).astype(np.uint32)
        order = np.lexsort((ids, h))
        head = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
        size = np.diff(np.r_[head, len(order)])
        shared = np.repeat(ids[order[head]] != ids[order[head + size - 1]], size)
        first = np.zeros(len(order), bool)
        first[head] = True
        here = order[shared]
        rows = [(n + s, pack(delta(i), p)) for s, i, p in split_by(_shard(ids[here], n), ids[here], at[here])]
        sent = np.sort(order[~shared | first])
        known = np.zeros(len(at), np.uint8)
        known[order[shared]] = 1
        for b, key, i, p, k in split_by(_bucket(h[sent], n), h[sent].astype(np.uint32), ids[sent], at[sent], known[sent]):
            rows.append((b, pack(key, delta(i), p, k)))
        yield pa.RecordBatch.from_pydict(_rows("bucket", rows))


def _shared_anchors(key, rows: pa.Table, n: int) -> pa.Table:
    bodies = rows.column("body").to_pylist()
    if key[0].as_py() >= n:
        parts = [unpack(b) for b in bodies]
        ids, at = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(ids, kind="stable")
        return pa.table(_rows("shard", [(key[0].as_py() - n, pack(delta(ids[order]), at[order]))]))
    parts = [unpack(b) for b in bodies]
    h, at, known = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3))
    ids = np.concatenate([np.cumsum(p[1]) for p in parts])
    order = np.lexsort((ids, h))
    h, ids, at, known = h[order], ids[order], at[order], known[order] > 0
    head = np.flatnonzero(np.r_[True, np.diff(h) != 0])
    size = np.diff(np.r_[head, len(h)])
    shared = (ids[head] != ids[head + size - 1]) | np.logical_or.reduceat(known, head)
    found = np.repeat(shared, size) & ~known
    found = np.flatnonzero(found)[np.argsort(ids[found], kind="stable")]
    return pa.table(_rows("shard", [(s, pack(delta(i), p)) for s, i, p in split_by(_shard(ids[found], n), ids[found], at[found])]))


def _send_stretches(docs: pa.Table, marks: pa.Table, n: int) -> pa.Table:
    if not docs.num_rows or not marks.num_rows:
        return pa.table(_rows("bucket", []))
    parts = [unpack(b) for b in marks.column("body").to_pylist()]
    marked, marked_at = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
    ids, shard = _ids(docs), docs.column("_shard")[0].as_py()
    data, ends = encoded(docs.column("_text"))
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    at, first, last, h = anchors(data, ends)
    row = np.searchsorted(ends, at, side="right")
    known = np.unique(ids)
    code = lambda i, p: (np.searchsorted(known, i) << 40) | p.astype(np.int64)
    hit = np.isin(code(ids[row], at - starts[row]), code(marked, marked_at))
    at, first, last, h, row = at[hit], first[hit], last[hit], h[hit], row[hit]
    check = np.zeros(len(ids), np.uint32)
    for r in np.unique(row):
        check[r] = zlib.crc32(data[starts[r] : ends[r]])
    whole, local = data.tobytes(), np.zeros(len(at), bool)
    order = np.lexsort((ids[row], h))  # equal stretches have equal hashes: one hash's stretches are held at a time
    now, seen = None, {}
    for k, key, i, f, stop, off in zip(order.tolist(), h[order].tolist(), ids[row][order].tolist(), first[order].tolist(), (last[order] + WINDOW).tolist(), (at - first)[order].tolist()):
        if key != now:
            now, seen = key, {}
        local[k] = seen.setdefault((whole[f:stop], off), i) < i
    out = []
    count = last - first + 1
    if local.any():
        r = row[local]
        out.append((n + shard, pack(ids[r], check[r], (first[local] - starts[r]).astype(np.uint32), count[local].astype(np.uint32))))
    sent = np.flatnonzero(~local)
    for b, k in split_by(_bucket(h[sent], n), sent):
        r = row[k]
        text = np.frombuffer(b"".join([whole[f:e] for f, e in zip(first[k].tolist(), (last[k] + WINDOW).tolist())]), np.uint8)
        out.append((b, pack(ids[r], check[r], (first[k] - starts[r]).astype(np.uint32), count[k].astype(np.uint8), (at[k] - first[k]).astype(np.uint8), h[k].astype(np.uint32), text)))
    return pa.table(_rows("bucket", out))


def _strips(h: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Places of the stretches in strips of about ``_STRIP`` bytes; those of one hash are in one strip."""
    order = np.argsort(h, kind="stable")
    head = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0]) if len(h) else order
    bytes_of = np.add.reduceat(size[order], head) if len(h) else size
    strip = (np.cumsum(bytes_of) - bytes_of) // _STRIP
    cuts = head[np.flatnonzero(np.diff(strip) != 0) + 1] if len(h) else head
    return [x for x in np.split(order, cuts) if len(x)]


def _repeated_in(data: np.ndarray, begin, count, offset, h, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, first window and number of windows of the runs that a smaller id has too."""
    size = count + WINDOW - 1
    shift = np.cumsum(size) - size
    data = data[np.repeat(begin - shift, size) + np.arange(int(size.sum()))]
    # stretches that are equal throughout are sorted once, under their smallest id
    whole, places = data.tobytes(), {}
    bounds = zip(shift.tolist(), (shift + size).tolist(), offset.tolist())
    kind = np.array([places.setdefault((whole[a:b], o), len(places)) for a, b, o in bounds], np.int64)
    n = len(places)
    del whole, places
    one = np.full(n, -1, np.int64)
    one[kind[::-1]] = np.arange(len(kind))[::-1]
    least = np.full(n, _LAST_ID, np.int64)
    np.minimum.at(least, kind, ids)
    own = size[one]
    new = np.cumsum(own) - own
    flags = repeated_windows(data[np.repeat(shift[one] - new, own) + np.arange(int(own.sum()))], new, count[one], offset[one], h[one], least)
    later = ids > least[kind]
    row, at, length = _runs(flags)
    runs = [(np.zeros(0, np.int64),) * 3]
    if len(row):
        # of each stretch that is not the first of its kind all windows are repeated, of the others those found
        first = np.flatnonzero(~later)
        lo, hi = np.searchsorted(row, kind[first]), np.searchsorted(row, kind[first], side="right")
        n_runs = hi - lo
        pick = np.repeat(lo - (np.cumsum(n_runs) - n_runs), n_runs) + np.arange(int(n_runs.sum()))
        runs.append((np.repeat(first, n_runs), at[pick], length[pick]))
    all_ = np.flatnonzero(later)
    runs.append((all_, np.zeros(len(all_), np.int64), count[all_]))
    return tuple(np.concatenate(x) for x in zip(*runs))


def _repeated(key, rows: pa.Table, n: int) -> pa.Table:
    """Repeated ranges of a bucket's stretches, a strip of complete groups of hashes at a time."""
    bodies = rows.column("body").to_pylist()
    if key[0].as_py() >= n:
        return pa.table(_rows("shard", [(key[0].as_py() - n, b) for b in bodies]))
    ids, check, first, count, offset, h, data = unpack_all(bodies)
    del bodies, rows
    count, offset, h = count.astype(np.int64), offset.astype(np.int64), h.astype(np.int64)
    begin = np.cumsum(count + WINDOW - 1) - (count + WINDOW - 1)
    found = [(np.zeros(0, np.int64),) * 3]
    for x in _strips(h, count + WINDOW - 1):
        row, at, length = _repeated_in(data, begin[x], count[x], offset[x], h[x], ids[x])
        found.append((x[row], at, length))
    row, at, length = (np.concatenate(x) for x in zip(*found))
    ids, check, first = ids[row], check[row], (first[row] + at).astype(np.uint32)
    out = [(s, pack(*x)) for s, *x in split_by(_shard(ids, n), ids, check, first, length.astype(np.uint32))]
    pa.default_memory_pool().release_unused()
    return pa.table(_rows("shard", out))


def _without_ranges(docs: pa.Table, ranges: pa.Table, names: list[str]) -> pa.Table:
    data, ends = encoded(docs.column("_text"))
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    ids = _ids(docs)
    cut: dict[tuple[int, int], list[np.ndarray]] = {}
    if ranges.num_rows:
        i, check, first, count = unpack_all(ranges.column("body").to_pylist())
        order = np.lexsort((check, i))
        i, check, first, stop = i[order], check[order], first[order].astype(np.int64), (first[order].astype(np.int64) + count[order] + WINDOW - 1)
        head = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (check[1:] != check[:-1])])
        for lo, hi in zip(head, np.r_[head[1:], len(i)]):
            cut[int(i[lo]), int(check[lo])] = [first[lo:hi], stop[lo:hi]]
    cut_ids = {k[0] for k in cut}
    removed, spans, digest, text = [], [], [], []
    for r, (lo, hi) in enumerate(zip(starts, ends)):
        body, n_removed, n_spans = data[lo:hi], 0, 0
        span = cut.get((int(ids[r]), zlib.crc32(body))) if int(ids[r]) in cut_ids else None
        if span:
            edge = np.bincount(span[0], minlength=len(body) + 1) - np.bincount(span[1], minlength=len(body) + 1)
            gone = np.cumsum(edge)[:-1] > 0
            n_removed, n_spans = int(gone.sum()), int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum())
            body = body[~gone]
        removed.append(n_removed), spans.append(n_spans)
        raw = body.tobytes()
        digest.append(hashlib.sha256(raw).hexdigest())
        if "kept_text" in names:
            text.append(raw.decode("utf-8", "ignore"))
    out = {c: docs.column(c) for c in names if c.startswith("_keep_")}
    out |= {"n_bytes": pa.array(ends - starts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept_text": pa.array(text, pa.string()) if text else None}
    return pa.table({c: out[c] if out[c] is not None else pa.array([], pa.string()) for c in names})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, kept_text: bool = True) -> DataFrame:
    """One row a document: the id, the columns in ``keep``, n_bytes, n_removed, n_spans, kept_sha256, and kept_text if asked for.

    ``kept_text`` leaves out the bytes of characters of which only a part remains.
    """
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    n = max(1, min(buckets(docs.sparkSession), -(-size // _BUCKET_BYTES)))
    columns = [doc_id, *(keep or [])]
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST_ID))
    source = docs.select(order.alias("_order"), F.col(text).alias("_text"), *[F.col(c).alias(f"_keep_{k}") for k, c in enumerate(columns)])
    dealt = source.withColumn("_shard", _shard_column(F.col("_order"), n))
    hashes = source.select("_order", "_text").mapInArrow(lambda b: _send_hashes(b, n), "bucket int, body binary")
    marks = hashes.groupBy("bucket").applyInArrow(lambda k, t: _shared_anchors(k, t, n), "shard int, body binary")
    by_shard = dealt.groupBy("_shard")
    stretches = by_shard.cogroup(marks.groupBy("shard")).applyInArrow(lambda a, b: _send_stretches(a, b, n), "bucket int, body binary")
    ranges = stretches.groupBy("bucket").applyInArrow(lambda k, t: _repeated(k, t, n), "shard int, body binary")
    kept = [f"_keep_{k}" for k in range(len(columns))]
    names = [*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if kept_text else [])]
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields if f.name in kept}
    kinds |= {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept_text": "string"}
    done = by_shard.cogroup(ranges.groupBy("shard")).applyInArrow(lambda a, b: _without_ranges(a, b, names), ", ".join(f"{c} {kinds[c]}" for c in names))
    return done.select(*[F.col(k).alias(c) for k, c in zip(kept, columns)], *names[len(kept) :])
