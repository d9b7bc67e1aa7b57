"""JSON lists too large for one task, read by byte ranges.

Spark's text source already cuts a file into byte ranges, for any store it can
read, if it is told a separator; a closing brace ends every record and many
places that are none. So a range is read as pieces that each end in a brace.
Whether a brace stands in a text, and at what depth, depends on all that comes
before, but only through one bit and one number:

1. Each range is scanned for both cases, beginning outside of a text and
   inside of one. That gives a small map: how it ends, and by how much the
   depth changes. The driver composes the maps, one row a range, and so knows
   how every range begins.
2. The ranges are scanned again from there. Records that lie in one range are
   cut out at once; of others, the parts of each range are put together by a
   small join. Records are numbered by a count per range.

No record goes through a shuffle unless it crosses a range's end, and a task
holds one record at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from framewright.session import materialize

_TEXT = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_REST_OF_TEXT = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_BEFORE = {0: re.compile(r"\s*\[\s*(?=\{)"), 1: re.compile(r"\s*,\s*(?=\{)")}
_END = re.compile(r"\s*(?:\[\s*)?\]\s*\}\Z")
_WHOLE, _HEAD, _MIDDLE, _TAIL = range(4)


def scan_piece(inside: bool, piece: str) -> tuple[bool, int]:
    """State and change of depth after ``piece``, which ends in a brace; ``inside`` a text or not before it."""
    if inside:
        rest = _REST_OF_TEXT.match(piece)
        if not rest:
            return True, 0
        piece = piece[rest.end() :]
    bare = _TEXT.sub("", piece)
    open_ = bare.find('"')
    if open_ >= 0:
        bare = bare[:open_]
    return open_ >= 0, bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """Range and piece; the separator that the source took away is put back, also where the file ended without one."""
    for batch in batches:
        for file, start, value in zip(*(c.to_pylist() for c in batch.columns)):
            yield (file, start), value + "}"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


_MAP = pa.schema([("file", pa.string()), ("start", pa.int64()), *[(n, pa.int64()) for n in ("end0", "depth0", "end1", "depth1")]])
_CUT = pa.schema([("file", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])


def _state_maps(batches):
    now, ends, depths, rows = None, [False, True], [0, 0], []
    for place, piece in _pieces(batches):
        if place != now:
            if now is not None:
                rows.append((*now, int(ends[0]), depths[0], int(ends[1]), depths[1]))
            now, ends, depths = place, [False, True], [0, 0]
        for k in (0, 1):
            ends[k], change = scan_piece(ends[k], piece)
            depths[k] += change
    if now is not None:
        rows.append((*now, int(ends[0]), depths[0], int(ends[1]), depths[1]))
    yield _batch(rows, _MAP)


def compose(maps: list[tuple]) -> dict[tuple[str, int], tuple[bool, int]]:
    """How each range begins, from all ranges' maps; an error if a file is not one list."""
    begin, before = {}, None
    state = (False, -1)
    for file, start, end0, depth0, end1, depth1 in sorted(maps):
        if file != before:
            if state != (False, -1):
                raise ValueError(f"{before} is not one JSON list")
            before, state = file, (False, 0)
        begin[file, start] = state
        inside, depth = state
        state = (bool(end1), depth + depth1) if inside else (bool(end0), depth + depth0)
    if state != (False, -1):  # the brace after the file's end was never there
        raise ValueError(f"{before} is not one JSON list")
    return begin


class _Cutter:
    """Records and parts of records of one range."""

    def __init__(self, place: tuple[str, int], inside: bool, depth: int):
        self.place, self.inside, self.depth = place, inside, depth
        self.nth, self.held, self.base = 0, [], depth
        self.mine = depth <= 1 and not inside  # whether the record at hand began in this range

    def _row(self, kind: int) -> tuple:
        text = "".join(self.held)
        if kind in (_WHOLE, _TAIL):
            before = _BEFORE[self.base].match(text)
            if not before:
                raise ValueError(f"no record after {text[:80]!r} in {self.place[0]}")
            text, self.nth = text[before.end() :], self.nth + 1
        return *self.place, self.nth - 1, kind, text

    def add(self, piece: str) -> Iterator[tuple]:
        self.inside, change = scan_piece(self.inside, piece)
        self.depth += change
        self.held.append(piece)
        if self.depth == 1 and not self.inside:
            yield self._row(_WHOLE if self.mine else _HEAD)
            self.held, self.base, self.mine = [], 1, True

    def end(self) -> Iterator[tuple]:
        if self.depth > 1 or self.inside:
            yield self._row(_TAIL if self.mine else _MIDDLE)
        elif self.held and not _END.match("".join(self.held)):
            raise ValueError(f"no record in {''.join(self.held)[:80]!r} at the end of {self.place[0]}")


def _cut(begin: dict[tuple[str, int], tuple[bool, int]]):
    def run(batches):
        cutter, rows, size = None, [], 0
        for place, piece in _pieces(batches):
            if cutter is None or place != cutter.place:
                if cutter is not None:
                    rows.extend(cutter.end())
                cutter = _Cutter(place, *begin[place])
            for row in cutter.add(piece):
                rows.append(row)
                size += len(row[-1])
            if size > 1 << 22:
                yield _batch(rows, _CUT)
                rows, size = [], 0
        if cutter is not None:
            rows.extend(cutter.end())
        yield _batch(rows, _CUT)

    return run


def _owners(parts: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """For each part of a record, file, range and kind, the range in which the record began."""
    out, owner = [], None
    for file, start, kind in sorted(parts):
        if kind == _TAIL:
            owner = start
        out.append((file, start, kind, owner))
    return out


def read_json_lists(spark: SparkSession, paths: str | list[str], schema: T.StructType, name: str = "position") -> DataFrame:
    """The records of files that hold one JSON list each, with their position over all files.

    Files count in the order of their paths. A file that is no list of objects
    fails the job, as does a record that does not fit the schema.
    """
    pieces = spark.read.option("lineSep", "}").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    maps = pieces.mapInArrow(_state_maps, "file string, start long, end0 long, depth0 long, end1 long, depth1 long").collect()
    begin = compose([tuple(m) for m in maps])  # one row a range
    cut = materialize(pieces.mapInArrow(_cut(begin), "file string, start long, nth long, kind int, text string"), "records")

    starts = cut.where(F.col("kind").isin(_WHOLE, _TAIL)).groupBy("file", "start").agg(F.count("*").alias("n"))
    before = W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = starts.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    parts = cut.where(F.col("kind") != _WHOLE)
    owners = _owners([tuple(p) for p in parts.select("file", "start", "kind").collect()])  # two rows a range
    owned = spark.createDataFrame(owners, "file string, start long, kind int, owner long")
    joined = parts.join(F.broadcast(owned), ["file", "start", "kind"]).groupBy("file", F.col("owner").alias("start")).agg(
        F.max(F.when(F.col("kind") == _TAIL, F.col("nth"))).alias("nth"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("start").alias("at"), "text"))), lambda p: p["text"]), "").alias("text"),
    )
    records = cut.where(F.col("kind") == _WHOLE).select("file", "start", "nth", "text").unionByName(joined)
    record = F.from_json("text", schema, {"mode": "FAILFAST"})
    return (
        records.join(F.broadcast(starts), ["file", "start"])
        .select((F.col("first") + F.col("nth")).alias(name), record.alias("record"))
        .select(name, "record.*")
    )


def write_json_lists(records: DataFrame, path: str) -> None:
    """Every task writes its rows, in their order, as one JSON list in one file."""

    def lines(batches):
        begun = False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                texts = [("," if begun or k else "[") + t for k, t in enumerate(texts)]
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"])], names=["value"])

    whole = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    records.select(F.to_json(whole).alias("value")).mapInArrow(lines, "value string").write.text(path)
