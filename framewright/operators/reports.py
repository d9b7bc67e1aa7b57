"""Per-layer quality tables out of HTML reports.

Input is a table of documents: key columns (default ``path``) and ``html``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import partial, reduce
from html.parser import HTMLParser
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from framewright.functions import html as H
from framewright.functions.cells import cells_of_documents

# The layer name pattern, the layer literals and the headings
LAYER_PATTERN = r"^(.*_layers_)(\d+)(_attentions_0)(.*)"
LAYER_LITERAL = "layers_{i}_attentions_0"
LAYER_TAG = "layer_{i}_attention_0"
LAYERS = (0, 1, 2, 3, 4)
METRIC_CELLS = {"Cosine Similarity": 3, "SQNR": 4, "MSE": 5}
COMMON_NAME = "Common Layer Name"

# make Java's digits and line ends mean what they mean in the pattern's dialect
_DIALECT = "(?d)(?U)"


# -- rows and cells ---------------------------------------------------------


def extract_table_rows(
    docs: DataFrame, keys: Sequence[str] = ("path",), html: str = "html", row_tag: str = "tr"
) -> DataFrame:
    """One row per table row of a document: keys, ``row_no``, ``row_html``.

    Documents with nested or unclosed rows take the tag stack instead of the
    pattern, so no row is lost.
    """
    docs = docs.select(*keys, F.col(html).alias("_html"), H.visible_markup(F.col(html)).alias("_plain"))
    odd = ~H.well_formed(F.col("_plain"), row_tag)
    return _rows_of_documents(docs, keys, odd, H.element_bodies(F.col("_plain"), row_tag), "row_html", _row_markup(row_tag))


def extract_row_cells(rows: DataFrame, cell_tag: str = "td", unescape: bool = True) -> DataFrame:
    """Replace ``row_html`` by ``cells``, the stripped text of every cell.

    A row without such cells, a header, gets an empty array. Turn
    ``unescape`` off if the reports hold no character references.
    """
    others = [F.col(f"`{c}`") for c in rows.columns if c != "row_html"]
    rows = rows.withColumn("_plain", H.plain_markup(F.col("row_html"), cell_tag))
    odd = F.when(~H.well_formed(F.col("_plain"), cell_tag), F.col("row_html"))
    rows = rows.select(*others, "_plain", _row_cells(cell_tag)(odd).alias("_nested"))
    cells = F.coalesce("_nested", H.cell_texts(F.col("_plain"), cell_tag))
    rows = rows.select(*others, cells.alias("cells"), F.col("_nested").isNotNull().alias("_done"))
    return (decode_cells(rows) if unescape else rows).drop("_done")


def decode_cells(rows: DataFrame) -> DataFrame:
    """Decode the cells but those of rows that are ``_done``."""
    return rows.withColumn("cells", H.decode_references(F.col("cells"), F.col("_done")))


def extract_cells_tolerant(
    docs: DataFrame,
    keys: Sequence[str] = ("path",),
    html: str = "html",
    row_tag: str = "tr",
    cell_tag: str = "td",
) -> DataFrame:
    """Rows and cells of documents with nested or unclosed tags.

    Nested rows and cells count again inside the outer ones. Spark spreads
    the documents over the tasks; each is read once by a small tag stack.
    """
    fields = [docs.schema[k] for k in keys] + [
        T.StructField("row_no", T.IntegerType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
    ]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (i, row_no, cells)
                for i, text in enumerate(batch.column(len(keys)).to_pylist())
                for row_no, cells in enumerate(_nested_cells(text or "", row_tag, cell_tag))
            ]
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(at) for k in range(len(keys))]
                + [
                    pa.array([f[1] for f in found], pa.int32()),
                    pa.array([f[2] for f in found], pa.list_(pa.string())),
                ],
                names=[f.name for f in fields],
            )

    return docs.select(*keys, html).mapInArrow(parse, T.StructType(fields))


class _CellReader(HTMLParser):
    VOID = frozenset(
        "area base br col embed hr img input link meta param source track wbr".split()
    )

    def __init__(self, row_tag: str, cell_tag: str) -> None:
        super().__init__(convert_charrefs=True)
        self.row_tag, self.cell_tag = row_tag, cell_tag
        self.rows: list[tuple[list[int], list[list[int]]]] = []  # span of markup, spans of text
        self.open: list[tuple[str, tuple | list | None]] = []
        self.texts: list[str] = []
        self.size = 0

    def read(self, html: str) -> None:
        self.lines = [0, *(i + 1 for i, c in enumerate(html) if c == "\n")]
        self.feed(html)
        self.close()
        self._end(0, len(html))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _end(self, depth: int, at: int) -> None:
        for name, target in self.open[depth:]:
            if name == self.row_tag:
                target[0].append(at)
            elif name == self.cell_tag:
                target.append(self.size)
        del self.open[depth:]

    def cells(self) -> list[list[str]]:
        text = "".join(self.texts)
        return [[text[slice(*cell)].replace("\0", "").strip() for cell in row] for _, row in self.rows]

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        target = None
        if tag == self.row_tag:
            target = ([self._at() + len(self.get_starttag_text())], [])
            self.rows.append(target)
        elif tag == self.cell_tag:
            target = [self.size]
            for name, row in self.open:
                if name == self.row_tag:
                    row[1].append(target)
        self.open.append((tag, target))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                return self._end(i, self._at())

    def handle_data(self, data):
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.texts.append(data)
        self.size += len(data)


# tags that mean the same to every reader: with quoted attributes or none, of no element whose text is read in another way
_SIMPLE_TAG = re.compile(r'<(/[a-zA-Z][a-zA-Z0-9]*+|[a-zA-Z][a-zA-Z0-9]*+(?: [a-zA-Z]++="[^"<>&]*+")*+)>')
_OTHER_TEXT = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext svg math".split())


def _simple_cells(text: str, row_tag: str, cell_tag: str) -> list[list[str]] | None:
    """What ``_CellReader`` finds, if there are only simple tags and no references; else None."""
    parts = _SIMPLE_TAG.split(text)
    whole = "".join(parts[::2])
    if "<" in whole or "&" in whole or "\0" in whole:
        return None
    size = len(parts[0])
    rows: list[list[list[int]]] = []
    names: list[str] = []
    targets: list[list] = []
    for k in range(1, len(parts), 2):
        name = parts[k].partition(" ")[0].lower()
        if name[0] == "/":
            name, i = name[1:], len(names) - 1
            while i >= 0 and names[i] != name:
                i -= 1
            if i >= 0:
                for target in targets[i:]:
                    target.append(size)
                del names[i:], targets[i:]
        elif name in _OTHER_TEXT:
            return None
        elif name not in _CellReader.VOID:
            target = []
            if name == row_tag:
                rows.append([])
                target = [rows[-1]]
            elif name == cell_tag:
                target = [size]
                for outer, row in zip(names, targets):
                    if outer == row_tag:
                        row[0].append(target)
            names.append(name)
            targets.append(target)
        size += len(parts[k + 1])
    for target in targets:
        target.append(size)
    return [[whole[cell[0] : cell[1]].strip() for cell in row] for row in rows]


def _nested_cells(text: str, row_tag: str, cell_tag: str) -> list[list[str]]:
    cells = _simple_cells(text, row_tag, cell_tag)
    if cells is not None:
        return cells
    reader = _CellReader(row_tag, cell_tag)
    reader.read(text)
    return reader.cells()


def _of_irregular(parse, kind: T.DataType):
    """``parse`` of the texts that are not null: regular documents reach Python as nulls."""

    @F.arrow_udf(kind)
    def parsed(texts: pa.Array) -> pa.Array:
        found = [None if t is None else parse(t) for t in texts.to_pylist()]
        return pa.array(found, to_arrow_type(kind))

    return parsed.asNondeterministic()


def _rows_of_documents(docs: DataFrame, keys: Sequence[str], odd: Column, bodies: Column, name: str, parse) -> DataFrame:
    """Keys, ``row_no`` and the elements of ``bodies``; of ``odd`` documents, what ``parse`` makes of ``_html``.

    Rows stream through Python and back: a column function would hold those of
    regular documents in a queue, on disk when memory is short, for as long as
    the next steps are slower than Python.
    """
    kind = T.StringType() if name == "row_html" else T.ArrayType(T.StringType())
    docs = docs.select(*keys, "_plain", F.when(odd, F.col("_html")).alias("_odd"))
    regular = F.when(F.col("_odd").isNull(), bodies)
    # an irregular document is one row without a number, as is one without rows
    rows = docs.select(*keys, "_odd", F.posexplode_outer(regular).alias("row_no", name)).select(*keys, "row_no", name, "_odd")
    fields = [docs.schema[k] for k in keys] + [T.StructField("row_no", T.IntegerType()), T.StructField(name, kind)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered, texts, n = batch.column(len(keys)).is_valid(), batch.column(len(keys) + 2), len(keys) + 2
            rest = pa.RecordBatch.from_arrays(batch.columns[:n], names=batch.schema.names[:n])
            yield rest.filter(numbered) if batch.column(len(keys)).null_count else rest
            if texts.null_count == len(texts):
                continue
            at = pc.indices_nonzero(texts.is_valid())
            found = [parse(t) for t in texts.take(at).to_pylist()]
            row = pa.array([i for i, f in zip(at.to_pylist(), found) for _ in f], pa.int64())
            columns = [
                pa.array([k for f in found for k in range(len(f))], pa.int32()),
                pa.array([x for f in found for x in f], to_arrow_type(kind)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(row) for k in range(len(keys))] + columns, names=rest.schema.names)

    return rows.mapInArrow(read, T.StructType(fields))


def _row_cells(cell_tag: str):
    # the row's own tags are gone, so all of the markup is one row
    return _of_irregular(lambda t: _nested_cells(f"<tr>{t}", "tr", cell_tag)[0], T.ArrayType(T.StringType()))


def _row_markup(row_tag: str):
    def parse(text: str) -> list[str]:
        reader = _CellReader(row_tag, "")
        reader.read(text)
        return [text[slice(*span)] for span, _ in reader.rows]

    return parse


def filter_nonempty_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("cells") > 0)


def optional_cell(k: int, cells: str = "cells") -> Column:
    """The k-th cell, null if the row is short."""
    return F.get(cells, F.lit(k))


def required_cell(k: int, cells: str = "cells") -> Column:
    """The k-th cell; a short row fails the job."""
    return F.when(F.size(cells) > k, F.get(cells, F.lit(k))).otherwise(
        F.raise_error(F.concat(F.lit(f"no cell {k} in row: "), F.array_join(cells, " | ")))
    )


def metric_cells(on_short: str = "null") -> list[Column]:
    if on_short not in ("null", "error"):
        raise ValueError(f"on_short must be 'null' or 'error', not {on_short!r}")
    cell = optional_cell if on_short == "null" else required_cell
    return [cell(k).alias(name) for name, k in METRIC_CELLS.items()]


# -- layer names ------------------------------------------------------------


def layer_name() -> Column:
    return optional_cell(0)


def filter_layer_rows(rows: DataFrame, pattern: str = LAYER_PATTERN) -> DataFrame:
    """Rows whose first cell has the shape of a layer name."""
    return rows.where(layer_name().rlike(_DIALECT + pattern))


def filter_layer_contains(rows: DataFrame, literal: str) -> DataFrame:
    """Rows whose first cell contains the literal."""
    return rows.where(layer_name().contains(literal))


_NAME_PARTS = ("prefix", "layer", "suffix", "rest")
_APART = "\0"  # cut out of every cell, so no name holds it


def _name_parts(pattern: str) -> Column:
    """Prefix, layer, suffix and rest of the first cell after an empty text, from one run of the pattern; else one text."""
    whole = rf"{_DIALECT}{pattern}(?s:.*)\z"
    return F.split(F.regexp_replace(layer_name(), whole, "".join(f"{_APART}${k}" for k in range(1, 5))), _APART)


def _with_name_parts(rows: DataFrame, pattern: str) -> DataFrame:
    # a generator's output is computed once, whatever is then taken from it
    return rows.select("*", F.explode(F.array(_name_parts(pattern))).alias("_parts"))


def _part(k: int) -> Column:
    return F.get("_parts", F.lit(k + 1))


def parse_layer_name(rows: DataFrame, pattern: str = LAYER_PATTERN) -> DataFrame:
    """Add ``prefix``, ``layer``, ``suffix`` and ``rest`` of the first cell, empty if it is no layer name."""
    parts = [F.when(layer_name().isNotNull(), F.coalesce(_part(k), F.lit(""))).alias(n) for k, n in enumerate(_NAME_PARTS)]
    return _with_name_parts(rows, pattern).select(*[F.col(f"`{c}`") for c in rows.columns], *parts)


def common_layer_name() -> Column:
    """The name without its layer number: the same for all layers."""
    return F.concat("prefix", "suffix", "rest")


def full_layer_name() -> Column:
    return F.concat("prefix", "layer", "suffix", "rest")


def layer_name_prefix(literal: str) -> Column:
    """The part of the first cell before the first occurrence of the literal."""
    return F.substring_index(layer_name(), literal, 1)


def layer_columns(layers: Sequence[int] = LAYERS) -> list[str]:
    """The fixed order of the report columns: four per layer."""
    return [f"Layer {i} {part}" for i in layers for part in ("Name", *METRIC_CELLS)]


def ordered_columns(
    report: DataFrame, layers: Sequence[int] = LAYERS, first: Sequence[str] = (COMMON_NAME,)
) -> DataFrame:
    """Project to the fixed columns; others are dropped, missing ones null."""
    have = set(report.columns)
    return report.select(
        *first,
        *[
            F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c)
            for c in layer_columns(layers)
        ],
    )


# -- report tables ----------------------------------------------------------


def layer_rows(
    docs: DataFrame,
    keys: Sequence[str] = ("path",),
    on_short: str = "null",
    tolerant: bool = False,
    unescape: bool = True,
) -> DataFrame:
    """Rows with a layer name, parsed, with their three metrics."""
    rows = _with_name_parts(filter_nonempty_rows(table_cells(docs, keys, tolerant, unescape)), LAYER_PATTERN)
    return rows.where(F.size("_parts") == 1 + len(_NAME_PARTS)).select(
        "*", *[_part(k).alias(n) for k, n in enumerate(_NAME_PARTS)]
    ).select(
        *keys,
        "row_no",
        "layer",
        common_layer_name().alias(COMMON_NAME),
        full_layer_name().alias("Name"),
        *metric_cells(on_short),
    )


def table_cells(
    docs: DataFrame,
    keys: Sequence[str] = ("path",),
    tolerant: bool = False,
    unescape: bool = True,
    row_tag: str = "tr",
    cell_tag: str = "td",
) -> DataFrame:
    """Keys, ``row_no`` and ``cells`` of every table row, in one step.

    Documents go through Python as Arrow batches, where the cells of many are
    cut and decoded at once; Catalyst cannot repeat that work for later filters.
    Only documents with nested or unclosed tags, or with uncommon character
    references, are read by the tag stack; ``tolerant`` reads all of them that
    way. Those that it reads are always decoded.
    """
    if tolerant:
        return extract_cells_tolerant(docs, keys, "html", row_tag, cell_tag)
    docs = docs.select(*keys, F.col("html").cast("string"))
    fields = [docs.schema[k] for k in keys] + [
        T.StructField("row_no", T.IntegerType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
    ]
    parse = partial(_nested_cells, row_tag=row_tag, cell_tag=cell_tag)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row_no, cells in cells_of_documents(batch.column(len(keys)), row_tag, cell_tag, unescape, parse):
                columns = [batch.column(k).take(at) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, row_no, cells], names=[f.name for f in fields])

    return docs.mapInArrow(read, T.StructType(fields))


# what stands for a null, and before the place of the layer number in a name that differs from the common one by that only;
# in texts, the two characters that are used are written as two
_NULL, _PLACE = "\x01n", "\x01p"
_ESCAPES = {"\x01": "\x01b", _APART: "\x01a"}


def _packed_values() -> Column:
    """Name and metrics as one short text."""

    def escaped(part: str) -> Column:
        text = F.col(f"`{part}`")
        for plain, two in _ESCAPES.items():
            text = F.replace(text, F.lit(plain), F.lit(two))
        return F.coalesce(text, F.lit(_NULL))

    mark = LAYER_LITERAL.split("{i}")
    before = F.instr("Name", F.concat(F.lit(mark[0]), "layer", F.lit(mark[1]))) + (len(mark[0]) - 1)
    derived = F.concat(F.substring(COMMON_NAME, F.lit(1), before), F.col("layer"), F.substr(COMMON_NAME, before + 1)) == F.col("Name")
    name = F.when(derived & (before >= len(mark[0])), F.concat(F.lit(_PLACE), before.cast("string"))).otherwise(escaped("Name"))
    return F.concat_ws(_APART, name, *map(escaped, METRIC_CELLS))


def _unpacked_value(parts: str, k: int, layer: str) -> Column:
    text = part = F.get(parts, F.lit(k))
    for plain, two in reversed(_ESCAPES.items()):
        text = F.replace(text, F.lit(two), F.lit(plain))
    text = F.when(part != _NULL, text)
    if k:
        return text
    before = F.substr(part, F.lit(len(_PLACE) + 1)).try_cast("int")
    name = F.concat(F.substring(COMMON_NAME, F.lit(1), before), F.lit(layer), F.substr(COMMON_NAME, before + 1))
    return F.when(part.startswith(_PLACE), name).otherwise(text)


def _rows_put_together(rows: DataFrame, have: Sequence[str]) -> DataFrame:
    """Rows of keys, the number of a column (from 1, or null) and a value with its order, one row for equal keys of a batch.

    Of several values the last in order stays. Keys and orders that Python
    does not compare as Spark does are left apart.
    """
    *keys, _, row = rows.schema.fields
    fields = [*keys, *(T.StructField(h, row.dataType) for h in have)]

    def codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
        if pa.types.is_nested(column.type):
            column = pa.array([*map(repr, column.to_pylist())], pa.string())
        found = column.dictionary_encode(null_encoding="encode")
        return found.indices.to_numpy(), found.dictionary

    def ranks(column: pa.Array) -> np.ndarray | None:
        if pa.types.is_nested(column.type):
            return None
        code, values = codes(column)
        ranked = [(0, 0) if v is None else (2, 0) if v != v else (1, v) for v in values.to_pylist()]
        place = {v: k for k, v in enumerate(sorted(set(ranked)))}
        return np.array([place[v] for v in ranked], np.int64)[code]

    def joint(columns: list[np.ndarray]) -> np.ndarray:
        """Dense numbers of the rows of ``columns``, in their order."""
        number = columns[0].astype(np.int64)
        for column in columns[1:]:
            number = np.unique(number * (int(column.max()) + 1) + column, return_inverse=True)[1]
        return number

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            columns, layers, values = batch.columns[: len(keys)], batch.column(len(keys)), batch.column(len(keys) + 1)
            orders = [ranks(c) for c in values.field(0).flatten()]
            every = np.arange(len(batch))
            if any(o is None for o in orders):
                named, order = every, every
            else:
                named, order = joint([codes(c)[0] for c in columns]), np.argsort(joint(orders), kind="stable")
            first = np.empty(int(named.max()) + 1, np.int64)
            first[named[::-1]] = every[::-1]
            layer = pc.fill_null(layers, 0).to_numpy()[order]
            last = []
            for k in range(1, len(have) + 1):
                rows_of, held = order[layer == k], np.full(len(first), -1)
                held[named[rows_of]] = rows_of  # the last of several stays
                last.append(pa.array(held, mask=held < 0))
            found = [c.take(pa.array(first)) for c in columns] + [values.take(c) for c in last]
            yield pa.RecordBatch.from_arrays(found, names=[f.name for f in fields])

    return rows.mapInArrow(read, T.StructType(fields))


def layer_wide_report(
    rows: DataFrame,
    group: Sequence[str] = ("path",),
    order: Sequence[str] = ("row_no",),
    layers: Sequence[int] = LAYERS,
) -> DataFrame:
    """One row per common name with four columns per layer.

    Of several rows for one name and layer the last in ``order`` counts as a
    whole, its nulls included. ``group=()`` merges all documents into one
    table; give ``order=('path', 'row_no')`` then. The values are combined
    before the shuffle, so a name that fills the table costs one row per task,
    and in every Arrow batch before Spark sorts them.
    """
    names = [str(i) for i in layers]
    have, kinds = [f"_have{k}" for k in range(len(names))], {rows.schema[c].dataType for c in ("Name", *METRIC_CELLS)}
    packed = kinds == {T.StringType()}
    rows = rows.select(
        *group,
        COMMON_NAME,
        F.array_position(F.array(*map(F.lit, names)), F.col("layer").cast("string")).cast("int").alias("_layer"),
        F.struct(F.struct(*order).alias("order"), (_packed_values() if packed else F.struct("Name", *METRIC_CELLS)).alias("values")).alias("_row"),
    )
    latest = [F.max_by(f"{h}.values", f"{h}.order").alias(h) for h in have]
    wide = _rows_put_together(rows, have).groupBy(*group, COMMON_NAME).agg(*latest)
    if packed:
        wide = wide.select(*group, COMMON_NAME, *[F.split(h, _APART).alias(h) for h in have])
    flat = wide.select(
        *group,
        COMMON_NAME,
        *[
            (_unpacked_value(h, k, i) if packed else F.col(h)[part]).alias(f"Layer {i} {part}")
            for h, i in zip(have, names)
            for k, part in enumerate(("Name", *METRIC_CELLS))
        ],
    )
    return ordered_columns(flat, layers, (*group, COMMON_NAME))


def layer_sparse_report(
    rows: DataFrame, keep: Sequence[str] = ("path", "row_no"), layers: Sequence[int] = LAYERS
) -> DataFrame:
    """One row per table row; only the columns of its own layer are filled."""
    return rows.select(
        *keep,
        COMMON_NAME,
        *[
            F.when(F.col("layer") == str(i), F.col(part)).alias(f"Layer {i} {part}")
            for i in layers
            for part in ("Name", *METRIC_CELLS)
        ],
    )


def layer_long_report(
    rows: DataFrame,
    keep: Sequence[str] = ("path", "row_no"),
    layers: Sequence[int] = LAYERS,
    on_short: str = "null",
) -> DataFrame:
    """A row per table row and layer named in it, tagged with the layer.

    One pass over the rows, whatever the number of layers.
    """
    named = [layer_name().contains(LAYER_LITERAL.format(i=i)) for i in layers]
    tags = [
        F.when(is_named, F.array(F.lit(LAYER_TAG.format(i=i)))).otherwise(F.array().cast("array<string>"))
        for i, is_named in zip(layers, named)
    ]
    return filter_nonempty_rows(rows).where(reduce(or_, named)).select("*", F.explode(F.concat(*tags)).alias("_tag")).select(
        *keep,
        layer_name().alias("Layer Name"),
        *metric_cells(on_short),
        F.col("_tag").alias("Attention Layer"),
    )


def layer_prefix_report(
    rows: DataFrame,
    layer: int = 0,
    keep: Sequence[str] = ("path", "row_no"),
    on_short: str = "null",
) -> DataFrame:
    """Name prefix and metrics of the rows of one layer."""
    literal = LAYER_LITERAL.format(i=layer)
    return filter_layer_contains(filter_nonempty_rows(rows), literal).select(
        *keep, layer_name_prefix(literal).alias("Layer Name"), *metric_cells(on_short)
    )


def union_layers(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts, duplicates kept; columns are matched by name."""
    if not parts:
        raise ValueError("nothing to union")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
