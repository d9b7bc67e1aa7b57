"""Text of HTML elements as column expressions."""

from __future__ import annotations

from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

# attributes may quote a closing bracket; possessive, so no deep backtracking
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""

# Every character that counts as white space when stripping
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


MARK = "\x00"  # stands where a tag was, so that its neighbours cannot form a new one

_HIDDEN = (
    r"!--.*?-->"
    rf"|(?i:script)\b{_ATTRIBUTES}>.*?</(?i:script)\s*>"
    rf"|(?i:style)\b{_ATTRIBUTES}>.*?</(?i:style)\s*>"
)


def visible_markup(html: Column) -> Column:
    """The document without comments, scripts and style sheets."""
    return F.regexp_replace(html, rf"(?s)<(?:{_HIDDEN})", "")


def markup_pattern(*keep: str) -> str:
    kept = rf"(?!/?(?i:{'|'.join(keep)})\b)"
    return rf"(?s)<(?:{_HIDDEN}|{kept}[/!?a-zA-Z]{_ATTRIBUTES}>)"


def plain_markup(html: Column, *keep: str) -> Column:
    """Only the named tags and the visible text, in one pass over the text."""
    return F.regexp_replace(html, markup_pattern(*keep), MARK)


def body_pattern(tag: str) -> str:
    end = rf"/(?i:{tag})\s*+>"
    # text up to the next bracket in one go, then any bracket but the end tag's
    body = rf"[^<]*+(?:<(?!{end})[^<]*+)*+"
    return rf"<(?i:{tag})\b{_ATTRIBUTES}>({body})<{end}"


def element_bodies(html: Column, tag: str) -> Column:
    """Inner markup of every closed, un-nested ``tag``, in document order."""
    return F.regexp_extract_all(html, F.lit(body_pattern(tag)), F.lit(1))


def form_pattern(tag: str, inner: str | None = None) -> str:
    names = "|".join([tag, inner] if inner else [tag])
    text = rf"[^<]*+(?:<(?!/?(?i:{names})\b)[^<]*+)*+"

    def elements(name: str, body: str) -> str:
        return rf"{text}(?:<(?i:{name})\b{_ATTRIBUTES}(?<!/)>{body}</(?i:{name})\s*+>{text})*+"

    return rf"\A{elements(tag, elements(inner, text) if inner else text)}\z"


def well_formed(markup: Column, tag: str, inner: str | None = None) -> Column:
    """True if every ``tag``, and every ``inner`` one, is closed and un-nested,
    and no ``inner`` one stands outside: then ``element_bodies`` finds them all.
    """
    return markup.rlike(form_pattern(tag, inner))


def cell_texts(row: Column, tag: str) -> Column:
    """Stripped text of every cell of a row of ``plain_markup``.

    Character references are not decoded yet.
    """
    return F.transform(
        element_bodies(row, tag), lambda cell: strip(F.replace(cell, F.lit(MARK), F.lit("")))
    )


def strip(text: Column) -> Column:
    """Trim every kind of white space.

    Trimming by a long list is slow, and a text that begins and ends with a
    visible ASCII character does not need it.
    """
    tight = F.ascii(text).between(33, 126) & F.ascii(F.substring(text, -1, 1)).between(33, 126)
    return F.when(tight, text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


# Character references that need no table, and what they stand for; the last one
# comes last, so that what it makes is not decoded again
NO_BREAK_SPACE = ("&nbsp;", "\xa0")  # makes no markup, so it may be decoded before the tags are read
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}
OTHER_REFERENCE = rf"&(?!(?:{'|'.join(r[1:-1] for r in REFERENCES)});)"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _decode_cells(cells: pa.Array) -> pa.Array:
    texts = [None if t is None else unescape(t).strip() for t in cells.flatten().to_pylist()]
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(cells), 0))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, pa.array(texts, pa.string()), mask=cells.is_null())


# not to be repeated in a filter that Catalyst moves below the projection
_decode_cells = _decode_cells.asNondeterministic()


def decode_references(cells: Column, done: Column | None = None) -> Column:
    """Decode character references and strip what they turn into.

    Rows without any reference, or ``done`` before, reach Python as nulls only.
    """
    wanted = F.exists(cells, lambda c: c.contains("&"))
    coded = F.when(wanted if done is None else wanted & ~done, cells)
    return F.coalesce(_decode_cells(coded), cells)
