"""Rows and cells of whole Arrow columns of documents.

Most documents of a column hold plain tags, comments and the common character
references only. Their tags are found and their cells cut with a few array
steps for a stretch of many documents; the others are read one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from framewright.functions import html as H

# Bytes of documents that are read at once, and quoted attributes of a tag that are followed
_STRETCH, _QUOTES = 1 << 20, 64

_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _among(characters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters)] = True
    return found


_LESS, _MORE, _SLASH, _AMPERSAND, _DOUBLE, _SINGLE = b"<>/&\"'"
_QUOTE = _among(b"\"'")
_OPENS, _WORD, _SPACE = _among(_LETTERS + b"/!?"), _among(_LETTERS + b"0123456789_"), _among(b" \t\n\x0b\x0c\r")
_VISIBLE = _among(bytes(range(33, 127)))
_ROW, _ROW_END, _CELL, _CELL_END, _OTHER = range(5)
# which tag may follow which; outside of rows is as after a row's end
_FOLLOWS = np.zeros((4, 4), bool)
for _before, _after in (
    (_ROW, _CELL), (_ROW, _ROW_END), (_CELL, _CELL_END), (_CELL_END, _CELL), (_CELL_END, _ROW_END), (_ROW_END, _ROW)
):
    _FOLLOWS[_before, _after] = True

_REFERENCES = [(r.encode(), t.encode()) for r, t in (H.NO_BREAK_SPACE, *H.REFERENCES.items())]


def _number(text: bytes) -> tuple[np.uint64, np.uint64]:
    """The text as the low bytes of a word, and the mask of these bytes."""
    return np.uint64(int.from_bytes(text, "little")), np.uint64((1 << 8 * len(text)) - 1)


def _document_of(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(np.searchsorted(places, starts)))


def _tag_spans(buf: np.ndarray, starts: np.ndarray, words: np.ndarray, odd: np.ndarray):
    """Start, end, document and first bytes of all comments and tags; documents whose spans are in doubt become odd."""
    size = starts[-1]
    text = buf[:size]
    marks = np.flatnonzero((text == _LESS) | (text == _MORE) | (text == _DOUBLE) | (text == _SINGLE))
    kinds = buf[marks]
    at = np.flatnonzero(kinds == _LESS)
    at = at[_OPENS[buf[marks[at] + 1]]]
    begin = marks[at]
    first = words[begin]
    value, mask = _number(b"<!--")
    comment = first & mask == value
    comments, ends = begin[comment], None
    if len(comments):
        value, mask = _number(b"-->")
        shut = marks[kinds == _MORE] - 2
        shut = shut[shut >= 0]
        shut = np.append(shut[words[shut] & mask == value], size)
        ends = shut[np.searchsorted(shut, comments + 4)] + 3
        own = _document_of(comments, starts)
        open_ = ends > starts[own + 1]
        odd[own[open_]] = True
        ends[open_] = comments[open_] + 1
        # what a comment holds begins behind its own place among the spans
        low = np.searchsorted(begin, comments) + 1
        held = np.searchsorted(begin, ends) - low
        if held.any():
            shift = np.repeat(low - np.cumsum(held) + held, held)
            seen = np.ones(len(begin), bool)
            seen[shift + np.arange(len(shift))] = False
            seen |= comment
            at, begin, first, comment = at[seen], begin[seen], first[seen], comment[seen]
    # the mark that ends a tag: the next one, if that is not a quote
    n = len(marks)
    marks, kinds = np.append(marks, size), np.append(kinds, np.uint8(0))
    mark = at + 1
    quoted = np.flatnonzero(_QUOTE[kinds[mark]] & ~comment)
    if len(quoted):
        again = np.full(n + 1, n - 1)
        for quote in (_DOUBLE, _SINGLE):
            of_kind = np.flatnonzero(kinds == quote)
            again[of_kind[:-1]] = of_kind[1:]
        for _ in range(_QUOTES):
            mark[quoted] = again[mark[quoted]] + 1
            quoted = quoted[_QUOTE[kinds[mark[quoted]]]]
            if not len(quoted):
                break
    document = _document_of(begin, starts)
    end = marks[mark] + 1
    doubtful = kinds[mark] != _MORE
    if ends is not None:
        end[comment], doubtful[comment] = ends, False
    doubtful |= end > starts[document + 1]
    doubtful[:-1] |= end[:-1] > begin[1:]
    odd[document[doubtful]] = True
    return begin, np.minimum(end, starts[document + 1]), document, first, comment


def _tag_kinds(buf, begin, end, document, first, comment, tags: tuple[str, str], odd: np.ndarray) -> np.ndarray:
    """Which of the spans are tags of rows and cells; documents where these are not closed and un-nested become odd."""
    closing = (first >> np.uint64(8)) & np.uint64(255) == _SLASH
    name = np.where(closing, first >> np.uint64(16), first >> np.uint64(8))
    kind = np.full(len(begin), _OTHER, np.uint8)
    for tag, code in zip(tags, (_ROW, _CELL)):
        value, mask = _number(tag.lower().encode())
        blanks, _ = _number(b" " * len(tag))
        follows = (name >> np.uint64(8 * len(tag))).astype(np.uint8)
        own = np.flatnonzero(((name | blanks) & mask == value) & ~comment)
        own = own[~_WORD[follows[own]]]
        ends, follows = closing[own], follows[own]
        kind[own] = code + ends
        plain = (follows == _MORE) | (_SPACE[follows] & ~ends)
        plain &= np.where(ends, end[own] == begin[own] + len(tag) + 3, buf[end[own] - 2] != _SLASH)
        odd[document[own[~plain]]] = True
    blanks, mask = _number(b" " * 5)
    for tag in (b"scrip", b"style"):
        odd[document[~closing & ((name | blanks) & mask == _number(tag)[0])]] = True
    own = np.flatnonzero(kind != _OTHER)
    if len(own):
        kinds, documents = kind[own], document[own]
        new = documents[1:] != documents[:-1]
        before = np.append(np.uint8(_ROW_END), np.where(new, _ROW_END, kinds[:-1]))
        odd[documents[~_FOLLOWS[before, kinds]]] = True
        last = np.append(new, True)
        odd[documents[last & (kinds != _ROW_END)]] = True
    return kind


def _references(buf, begin, end, kind, starts, words, odd):
    """Places, and which of the common ones, of references in the text; documents with others become odd."""
    places = np.flatnonzero(buf[: starts[-1]] == _AMPERSAND)
    if not len(places):
        return places, places
    document, span = _document_of(places, starts), np.searchsorted(begin, places, "right") - 1
    which = np.full(len(places), -1)
    first = words[places]
    for k, (reference, _) in enumerate(_REFERENCES):
        value, mask = _number(reference)
        which[first & mask == value] = k
    if len(begin):
        tagged = (span >= 0) & (places < end[span])
        which[tagged & (kind[span] != _OTHER)] = -1
        seen = ~tagged | (kind[span] != _OTHER)
        places, which, document = places[seen], which[seen], document[seen]
    odd[document[which < 0]] = True
    good = ~odd[document]
    return places[good], which[good]


def _trimmed(texts: pa.Array, values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    tight = _VISIBLE[values[offsets[full]]] & _VISIBLE[values[offsets[full + 1] - 1]]
    loose = np.zeros(len(texts), bool)
    loose[full[~tight]] = True
    if not loose.any():
        return texts
    mask = pa.array(loose)
    return pc.replace_with_mask(texts, mask, pc.utf8_trim(texts.filter(mask), H.WHITE_SPACE))


def _simple_cells(buf: np.ndarray, starts: np.ndarray, tags: tuple[str, str], unescape: bool):
    """Of documents that lie one after the other: document, number and cells of each row, and which documents were not read.

    ``buf`` has eight bytes of room after the last document, and is written to.
    """
    size, odd = starts[-1], np.zeros(len(starts) - 1, bool)
    words = np.ndarray((size + 1,), "<u8", buf, strides=(1,))
    if not buf[:size].all():
        odd[_document_of(np.flatnonzero(buf[:size] == 0), starts)] = True
    begin, end, document, first, comment = _tag_spans(buf, starts, words, odd)
    kind = _tag_kinds(buf, begin, end, document, first, comment, tags, odd)
    places = _references(buf, begin, end, kind, starts, words, odd) if unescape else None
    if odd.any():
        good = ~odd[document]
        begin, end, document, kind = begin[good], end[good], document[good], kind[good]
        if unescape:
            good = ~odd[_document_of(places[0], starts)]
            places = places[0][good], places[1][good]
    cell = kind == _CELL
    count = np.cumsum(cell)
    inside = count > np.cumsum(kind == _CELL_END)  # the text after a span belongs to a cell
    length = np.append(begin[1:], size) - end
    edges = np.empty(2 * len(begin) + 2, np.int64)
    edges[0], edges[1:-1:2], edges[2:-1:2], edges[-1] = 0, begin, end, size
    flags = np.zeros(2 * len(begin) + 1, bool)
    flags[2::2] = inside
    keep = np.repeat(flags, np.diff(edges))
    if unescape:
        for k, (reference, text) in enumerate(_REFERENCES):
            own = places[0][places[1] == k]
            if not len(own):
                continue
            own = own[keep[own]]
            for j, byte in enumerate(text):
                buf[own + j] = byte
            for j in range(len(text), len(reference)):
                keep[own + j] = False
            span = np.searchsorted(begin, own, "right") - 1
            length -= np.bincount(span, minlength=len(begin)) * (len(reference) - len(text))
    values = buf[:size][keep]
    offsets = np.zeros(np.count_nonzero(cell) + 1, np.int32)
    if len(offsets) > 1:
        np.cumsum(np.add.reduceat(length[inside], np.flatnonzero(cell[inside])), out=offsets[1:])
    texts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(values))
    row = kind == _ROW
    rows = document[row]
    new = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else rows
    numbers = np.arange(len(rows)) - np.repeat(new, np.diff(np.append(new, len(rows))))
    cuts = pa.array(np.append(count[row], len(texts)).astype(np.int32))
    return rows, numbers.astype(np.int32), pa.ListArray.from_arrays(cuts, _trimmed(texts, values, offsets)), odd


@cache
def _patterns(row_tag: str, cell_tag: str) -> list[re.Pattern[str]]:
    patterns = [
        H.markup_pattern(row_tag, cell_tag), H.form_pattern(row_tag, cell_tag),
        H.body_pattern(row_tag), H.body_pattern(cell_tag), H.OTHER_REFERENCE,
    ]
    # letters of tags and white space are those of ASCII, as in the dialect that the patterns are written in
    return [re.compile(p.replace("(?i:", "(?ai:").replace(r"\s", r"(?a:\s)").replace(r"\z", r"\Z")) for p in patterns]


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    for reference, meaning in H.REFERENCES.items():
        text = text.replace(reference, meaning)
    return text.strip()


def regular_cells(text: str, row_tag: str, cell_tag: str, unescape: bool) -> list[list[str]] | None:
    """Cells of a document by patterns; None if its rows or cells are nested or unclosed, or it has uncommon references."""
    markup, form, row, cell, other = _patterns(row_tag, cell_tag)
    plain = markup.sub(H.MARK, text)
    if unescape:
        plain = plain.replace(*H.NO_BREAK_SPACE)
    if not form.search(plain) or unescape and other.search(plain):
        return None
    rows = [[c.replace(H.MARK, "").strip() for c in cell.findall(r)] for r in row.findall(plain)]
    return [[*map(_decoded, cells)] for cells in rows] if unescape else rows


def _stretches(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _STRETCH, "right")) - 1)
        yield at, to
        at = to


def cells_of_documents(
    docs: pa.Array, row_tag: str, cell_tag: str, unescape: bool, parse: Callable[[str], list[list[str]]]
) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Document number, row number and cells of every row. ``parse`` reads documents that no pattern fits."""
    docs = pc.fill_null(docs, "") if docs.null_count else docs
    _, offsets, data = docs.buffers()
    wide = np.int64 if pa.types.is_large_string(docs.type) else np.int32
    offsets = np.frombuffer(offsets, wide)[docs.offset : docs.offset + len(docs) + 1].astype(np.int64) if len(docs) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    short = row_tag.lower() != cell_tag.lower() and all(re.fullmatch("[a-zA-Z]{1,5}", t) for t in (row_tag, cell_tag))
    for at, to in _stretches(offsets):
        starts, whole = offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        others: Iterator[int] | np.ndarray = range(to - at)
        if short and len(whole) and _is_text(docs.slice(at, to - at)):
            buf = np.zeros(len(whole) + 8, np.uint8)
            buf[: len(whole)] = whole
            rows, numbers, cells, odd = _simple_cells(buf, starts, (row_tag, cell_tag), unescape)
            yield pa.array(rows + at), pa.array(numbers), cells
            others = np.flatnonzero(odd)
        found: list[tuple[int, int, list[str]]] = []
        for k in others:
            text = whole[starts[k] : starts[k + 1]].tobytes().decode("utf-8", "replace")
            rows = regular_cells(text, row_tag, cell_tag, unescape)
            found += [(at + int(k), n, row) for n, row in enumerate(parse(text) if rows is None else rows)]
        if found:
            yield (
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.int32()),
                pa.array([f[2] for f in found], pa.list_(pa.string())),
            )


def _is_text(docs: pa.Array) -> bool:
    try:
        docs.validate(full=True)
    except pa.ArrowInvalid:
        return False
    return True
