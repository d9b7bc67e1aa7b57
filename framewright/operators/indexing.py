"""Gap-free positions over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framewright.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in these bits


def dense_index(
    df: DataFrame,
    order_by: list[str | Column],
    name: str = "frame_no",
    partitions: int | None = None,
) -> DataFrame:
    """Number the rows 0..n-1 in the order of ``order_by``, a unique key.

    A global ``row_number`` would send every row through one task. Here the
    rows are range-partitioned on the full key, so even one scene that holds
    most rows is spread evenly; each row learns its position inside its
    partition, and only one row count per partition meets a global window.
    The placed rows are written out first, because the range bounds are
    sampled and must be the same for the counts and for the rows.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(k) if isinstance(k, str) else k for k in order_by]
    placed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
        .select(
            *df.columns,
            F.shiftright("_place", _ROW_BITS).cast("int").alias("_part"),
            F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
        )
    )
    stored = materialize(placed, "index")
    # one row per partition, at most n: safe to broadcast and to sum in one task
    starts = (
        stored.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select(
            "_part",
            (
                F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0))
                - F.col("_rows")
            ).alias("_start"),
        )
    )
    return stored.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_row")).alias(name)
    )
