"""Byte-level byte-pair encoding with a two-tier lookup, and its inverse.

A text is split by the vocabulary's pattern. The first tier looks whole
pre-tokens up in a minimal perfect hash of the vocabulary: all pre-tokens of a
piece at once, as arrays. Their hashes come from prefix sums over the bytes; a
level of the hash holds a bit for every key that has a place to itself there,
and the number of bits before it is the key's number. The found token's bytes
are compared with the pre-token's, so a foreign pre-token never passes.

The second tier takes the misses: a linked list of bytes and a heap of
adjacent pairs by rank and place; the lowest pair is joined, its neighbours'
new pairs enter the heap, and pairs that no longer stand are passed over. A
miss that occurs again is remembered, in a bounded table.

Decoding joins the tokens' bytes. Long texts are split a stretch at a time:
a match that ends well before a stretch does is final, and the next stretch
begins after the last of them, so memory follows the stretch, its longest
pre-token and the text itself.

Nulls and empty texts have no ids; their digests are those of nothing. Rows
are independent: no shuffle, and an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from framewright.llm.blobs import pieces

_REMEMBERED = 500_000
_LONGEST = 100
_STRETCH = 1 << 20
#: no alternative of a splitting pattern may look further than this past its end
LOOKAHEAD = 8
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


class SpanHash:
    """64-bit hashes of spans of a byte string, from prefix sums."""

    BASE = 0x9E3779B97F4A7C15
    BACK = pow(BASE, -1, 1 << 64)
    BYTES = (np.arange(1, 257, dtype=np.uint64) * _MIX) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(29))

    def __init__(self):
        self.up, self.down = _powers(1 << 12, np.uint64(self.BASE)), _powers(1 << 12, np.uint64(self.BACK))

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            size = 1 << len(data).bit_length()
            self.up, self.down = _powers(size, np.uint64(self.BASE)), _powers(size, np.uint64(self.BACK))
        prefix = np.r_[np.uint64(0), np.cumsum(self.BYTES[data] * self.up[: len(data)])]
        h = (prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


class PerfectHash:
    """Numbers 0..n-1 for n distinct 64-bit keys, by levels of bit sets and the bits before each place."""

    ROOM = 2  # places a key

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.uint64, np.ndarray, int]] = []
        self.number = np.full(len(keys), -1, np.int64)
        left, first = np.arange(len(keys)), 0
        while len(left):
            size = self.ROOM * len(left) + 1
            seed = np.uint64((2 * len(self.levels) + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            at = self._place(keys[left], seed, size)
            alone = np.bincount(at, minlength=size) == 1
            before = np.r_[0, np.cumsum(alone)]
            mine = alone[at]
            self.number[left[mine]] = first + before[at[mine]]
            self.levels.append((seed, np.where(alone, before[:-1] + first, -1), size))
            first, left = first + int(before[-1]), left[~mine]
            if len(self.levels) > 64:
                raise ValueError("keys are not distinct")

    @staticmethod
    def _place(keys: np.ndarray, seed: np.uint64, size: int) -> np.ndarray:
        h = (keys ^ (keys >> np.uint64(32))) * seed
        return ((h >> np.uint64(20)) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; any number, or -1, for a key that is not in the set."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, number, size in self.levels:
            if not len(left):
                break
            found = number[self._place(keys[left], seed, size)]
            out[left] = found
            left = left[found < 0]
        return out


class Merges(dict):
    """Ids of pre-tokens that are not tokens; the first ones seen are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.pairs = [[ranks.get(bytes((a, b))) for b in range(256)] for a in range(256)]

    def __missing__(self, word: bytes) -> list[int]:
        found = self.merged(word)
        if len(word) < _LONGEST and len(self) < _REMEMBERED:
            self[word] = found
        return found

    def merged(self, word: bytes) -> list[int]:
        """Linked bytes, and a heap of adjacent pairs by rank and place."""
        n, get, pairs = len(word), self.ranks.get, self.pairs
        # the part that begins at k, if one does, ends at end[k]; the part that ends at k begins at begin[k]
        end, begin = list(range(1, n + 1)), list(range(-1, n))
        heap = [(rank, k, k + 2) for k, (a, b) in enumerate(zip(word, word[1:])) if (rank := pairs[a][b]) is not None]
        heapify(heap)
        while heap:
            _, left, stop = heappop(heap)
            right = end[left]
            if not right or right == n or end[right] != stop:
                continue  # one of the two parts has been joined since
            end[right], end[left], begin[stop] = 0, stop, left
            if stop < n and (rank := get(word[left : end[stop]])) is not None:
                heappush(heap, (rank, left, end[stop]))
            if left and (rank := get(word[begin[left] : stop])) is not None:
                heappush(heap, (rank, begin[left], stop))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[word[at : end[at]]])
            at = end[at]
        return out


class ByteTokenizer:
    """The ranks of a file, looked up in two tiers."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        tokens = list(self.ranks)
        ids = np.array(list(self.ranks.values()), np.int64)
        sizes = np.array(list(map(len, tokens)), np.int64)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        self.hashes = SpanHash()
        ends = np.cumsum(sizes)
        index = PerfectHash(self.hashes.of(data, ends - sizes, ends))
        place = np.argsort(index.number)  # the token with each number
        self.index, self.id_of, self.size_of = index, ids[place], sizes[place]
        self.start_of, self.data = (ends - sizes)[place], data
        self.bytes_of = [b""] * (int(ids.max()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.missed = Merges(self.ranks)

    def whole(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The id of each span that is a token, -1 for the others."""
        number = self.index.find(self.hashes.of(data, start, end))
        size = end - start
        fits = np.flatnonzero((number >= 0) & (self.size_of[number] == size))
        size, start, token = size[fits], start[fits], number[fits]
        shift = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(shift, size)
        same = data[np.repeat(start, size) + step] == self.data[np.repeat(self.start_of[token], size) + step]
        good = np.add.reduceat(same, shift) == size if len(size) else np.zeros(0, bool)
        out = np.full(len(end), -1, np.int64)
        out[fits[good]] = self.id_of[token[good]]
        return out

    def stretches(self, text: str) -> Iterator[tuple[str, list[str]]]:
        """Parts of the text with their pre-tokens."""
        at, size = 0, _STRETCH
        while at < len(text):
            part = text[at : at + size]
            found = self.pattern.findall(part)
            if at + size < len(text):
                end = len(part)
                while found and end > len(part) - LOOKAHEAD:
                    end -= len(found.pop())
                if not found:
                    size *= 2
                    continue
                part = part[:end]
            yield part, found
            at, size = at + len(part), _STRETCH

    def encode_spans(self, parts: list[tuple[str, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts end to end, and where each part's ids end."""
        raw = "".join(p for p, _ in parts).encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        per_part = np.array([len(f) for _, f in parts], np.int64)
        sizes = np.fromiter(map(len, chain.from_iterable(f for _, f in parts)), np.int64, int(per_part.sum()))
        end = np.cumsum(sizes)
        head = np.flatnonzero((data & 0xC0) != 0x80)  # the bytes at which characters begin
        end = np.r_[head, len(data)][end]
        start = np.r_[0, end[:-1]].astype(np.int64) if len(end) else end
        ids = self.whole(data, start, end)
        miss = np.flatnonzero(ids < 0)
        n = np.ones(len(ids), np.int64)
        found = [self.missed[raw[a:b]] for a, b in zip(start[miss].tolist(), end[miss].tolist())]
        n[miss] = list(map(len, found))
        out = np.repeat(ids, n).astype("<u4")
        if found:
            first = (np.cumsum(n) - n)[miss]
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(n[miss].sum()))
            shift = np.cumsum(n[miss]) - n[miss]
            out[np.repeat(first - shift, n[miss]) + np.arange(len(flat))] = flat
        return out, np.r_[0, np.cumsum(n)][np.cumsum(per_part)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_spans(list(self.stretches(text)))[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(path, pattern)


class _Row:
    def __init__(self, keep: bool):
        self.n, self.ids, self.decoded, self.kept = 0, hashlib.sha256(), hashlib.sha256(), [] if keep else None

    def add(self, t: ByteTokenizer, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.ids.update(ids.tobytes())
        self.decoded.update(t.decode(ids))
        if self.kept is not None:
            self.kept.extend(ids.tolist())


def encode_decode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row a document: the id, n_tokens, digests of the ids and of the decoded bytes, and the ids if asked for."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def flush(t, parts, owners, rows):
        out, ends = t.encode_spans(parts)
        for owner, lo, hi in zip(owners, [0, *ends[:-1].tolist()], ends.tolist()):
            rows[owner].add(t, out[lo:hi])

    def run(batches):
        t = tokenizer(path, pattern)
        for batch in pieces(batches, "_text", 1 << 20):
            rows = [_Row(ids) for _ in range(batch.num_rows)]
            parts, owners, held = [], [], 0
            for k, value in enumerate(batch.column(0).to_pylist()):
                for part in t.stretches(value or ""):
                    parts.append(part), owners.append(k)
                    held += len(part[0])
                    if held >= _STRETCH:
                        flush(t, parts, owners, rows)
                        parts, owners, held = [], [], 0
            if parts:
                flush(t, parts, owners, rows)
            out = [batch.column(1), pa.array([r.n for r in rows], pa.int64())]
            out += [pa.array([r.ids.hexdigest() for r in rows], pa.string()), pa.array([r.decoded.hexdigest() for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array([r.kept for r in rows], pa.list_(pa.int32()))] if ids else []), names=names)

    names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    done = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("_id")).mapInArrow(run, schema)
    return done.select(F.col("_id").alias(doc_id), *names[1:])
