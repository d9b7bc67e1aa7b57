"""Seeded draws that depend on the key only, never on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_draw(key: Column, seed: int, n: int | Column) -> Column:
    """Integer in ``[0, n)`` from the first 60 bits of ``md5("seed:key")``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    word = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return word % (F.lit(n) if isinstance(n, int) else n)


def clamp_index(index: Column) -> Column:
    """Positions before the first frame mean the first frame."""
    return F.greatest(F.lit(0).cast("bigint"), index)
