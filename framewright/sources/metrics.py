"""Evaluation summaries from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.operators.metrics import SUMMARY_SCHEMA


def scan_metrics_summary(
    spark: SparkSession, paths: str | list[str], run_id: str = "path", name: str = "metrics_summary.json"
) -> DataFrame:
    """Summaries of many runs, one JSON file each; broken files are errors.

    Only files called ``name``, a glob pattern, are summaries.
    ``run_id`` is the path of the file or the name of its folder.
    """
    if run_id not in ("path", "folder"):
        raise ValueError(f"run_id must be 'path' or 'folder', not {run_id!r}")
    file = F.col("_metadata.file_path")
    run = F.element_at(F.split(file, "/"), -2) if run_id == "folder" else file
    return (
        spark.read.schema(SUMMARY_SCHEMA)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .json(paths)
        .select(run.alias("run_id"), "*")
    )
