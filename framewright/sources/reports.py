"""HTML reports in, report tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def scan_html_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole HTML files, one row each: ``path``, ``html``."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")
    )


def reports_from_table(docs: DataFrame, path: str, html: str) -> DataFrame:
    """Reports already held in a table, under the names the operators expect."""
    return docs.select(F.col(path).alias("path"), F.col(html).alias("html"))


def write_report(
    report: DataFrame,
    path: str,
    format: str = "parquet",
    index: str | None = None,
    mode: str = "overwrite",
) -> None:
    """Write a report table as Parquet or CSV, from all tasks at once.

    ``index`` names the column to put first as the row label; None leaves
    the columns as they are.
    """
    if format not in ("parquet", "csv"):
        raise ValueError(f"format must be 'parquet' or 'csv', not {format!r}")
    if index is not None:
        report = report.select(index, *[F.col(f"`{c}`") for c in report.columns if c != index])
    writer = report.write.mode(mode)
    if format == "csv":
        # quote everything, so that a null and an empty text stay different
        writer = writer.option("header", True).option("quoteAll", True)
    writer.format(format).save(path)
