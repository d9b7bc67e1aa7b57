"""Four decimals, fast or exact."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T


@F.arrow_udf(T.DoubleType())
def _format4(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else float(f"{v:.4f}") for v in values.to_pylist()], pa.float64())


def round4(value: Column, exact: bool = False) -> Column:
    """Round to four decimals.

    ``exact`` decides on the binary value: 2.00005 is stored a little below
    the tie and gives 2.0, where the built-in function gives 2.0001. Only
    values near a tie, and negative ones that become zero, reach Python.
    """
    if not exact:
        return F.round(value, 4)
    value = value.cast("double")
    scaled = F.abs(value) * 10000
    near = F.abs(scaled - F.floor(scaled) - 0.5) <= F.greatest(F.lit(1e-6), scaled * 1e-12)
    near = near | ((value < 0) & (scaled < 0.5))
    return F.coalesce(_format4(F.when(near, value)), F.round(value, 4))
