"""From evaluation summaries on disk to one table of metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from framewright.operators.metrics import CLASS_NAMES, flatten_metrics
from framewright.sources.metrics import scan_metrics_summary


def evaluate_runs(
    spark: SparkSession,
    paths: str | list[str],
    error_names: Mapping[str, str],
    classes: Sequence[str] = CLASS_NAMES,
    result_name: str = "pts_bbox",
    exact: bool = True,
) -> DataFrame:
    """``run_id``, ``metric``, ``value`` for every summary file."""
    runs = scan_metrics_summary(spark, paths)
    return flatten_metrics(runs, classes, error_names, result_name, exact)
