"""Names for intermediate values inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A column used inside a lambda is computed per element once Catalyst has
    merged the projections; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def let_all(body: Callable[..., Column], **values: Column) -> Column:
    """``body(**values)`` with every value computed once."""
    bound = F.struct(*[v.alias(k) for k, v in values.items()])
    return let(bound, lambda b: body(**{k: b[k] for k in values}))
