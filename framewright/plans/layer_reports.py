"""From HTML reports on disk to the four report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.operators import reports as R
from framewright.sources.reports import scan_html_reports


def wide_report(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    return R.layer_wide_report(R.layer_rows(scan_html_reports(spark, paths), **options))


def sparse_report(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    return R.layer_sparse_report(R.layer_rows(scan_html_reports(spark, paths), **options))


def long_report(
    spark: SparkSession, paths: str | list[str], on_short: str = "error", **options
) -> DataFrame:
    cells = R.table_cells(scan_html_reports(spark, paths), **options)
    return R.layer_long_report(cells, on_short=on_short)


def prefix_report(
    spark: SparkSession, paths: str | list[str], layer: int = 0, on_short: str = "error", **options
) -> DataFrame:
    cells = R.table_cells(scan_html_reports(spark, paths), **options)
    return R.layer_prefix_report(cells, layer, on_short=on_short)
