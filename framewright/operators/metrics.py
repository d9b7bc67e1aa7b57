"""Nested evaluation summaries to flat ``(metric, value)`` rows.

Input is one row per run with the columns of ``SUMMARY_SCHEMA``. Every step
only unfolds its own row, so any number of runs goes through one narrow stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from framewright.functions.rounding import round4

# Metric names, the split of each dataset version, class names
PREFIX = "{result_name}_NuScenes"
EVALUATION_SPLITS = {"v1.0-mini": "mini_val", "v1.0-trainval": "val"}
CLASS_NAMES = (
    "car", "truck", "construction_vehicle", "bus", "trailer", "barrier",
    "motorcycle", "bicycle", "pedestrian", "traffic_cone",
)

_BY_NAME = T.MapType(T.StringType(), T.DoubleType())
SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("label_aps", T.MapType(T.StringType(), _BY_NAME)),
        T.StructField("label_tp_errors", T.MapType(T.StringType(), _BY_NAME)),
        T.StructField("tp_errors", _BY_NAME),
        T.StructField("nd_score", T.DoubleType()),
        T.StructField("mean_ap", T.DoubleType()),
    ]
)


def metric_prefix(result_name: str = "pts_bbox") -> str:
    return PREFIX.format(result_name=result_name)


def lookup(mapping: Mapping[str, str], key: Column, what: str) -> Column:
    """A name from a small driver-side table; an unknown key fails the job."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(table[key], F.raise_error(F.concat(F.lit(f"no {what} "), key)))


def evaluation_split(version: Column) -> Column:
    return lookup(EVALUATION_SPLITS, version, "evaluation split for version")


def classes_filter(
    runs: DataFrame, by_class: str, classes: Sequence[str], keep: Sequence[str] = ("run_id",)
) -> DataFrame:
    """One row per run and configured class, in order: ``class_no``, ``name``
    and ``entry``. A class the run does not have fails the job."""
    wanted = F.array(*[F.lit(c) for c in classes])
    rows = runs.select(*keep, by_class, F.posexplode(wanted).alias("class_no", "name"))
    rows = rows.select(*keep, "class_no", "name", F.col(by_class)[F.col("name")].alias("entry"))
    # a filter, so that the check stays even if nobody reads the entry
    known = F.when(F.col("entry").isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"no {by_class} of class "), "name")).cast("boolean")
    )
    return rows.where(known)


def flatten_label_aps(
    runs: DataFrame, classes: Sequence[str], prefix: str, exact: bool = False, keep: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Average precision per class and distance."""
    rows = classes_filter(runs, "label_aps", classes, keep)
    return rows.select(*keep, "name", F.explode("entry").alias("k", "v")).select(
        *keep,
        F.concat(F.lit(prefix + "/"), "name", F.lit("_AP_dist_"), "k").alias("metric"),
        round4(F.col("v"), exact).alias("value"),
    )


def flatten_label_tp_errors(
    runs: DataFrame, classes: Sequence[str], prefix: str, exact: bool = False, keep: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Error of each kind per class."""
    rows = classes_filter(runs, "label_tp_errors", classes, keep)
    return rows.select(*keep, "name", F.explode("entry").alias("k", "v")).select(
        *keep,
        F.concat(F.lit(prefix + "/"), "name", F.lit("_"), "k").alias("metric"),
        round4(F.col("v"), exact).alias("value"),
    )


def flatten_mean_errors(
    runs: DataFrame,
    error_names: Mapping[str, str],
    prefix: str,
    exact: bool = False,
    keep: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Mean error of each kind, under its mapped name, once per run."""
    return runs.select(*keep, F.explode("tp_errors").alias("k", "v")).select(
        *keep,
        F.concat(F.lit(prefix + "/"), lookup(error_names, F.col("k"), "name for error")).alias("metric"),
        round4(F.col("v"), exact).alias("value"),
    )


def headline_scores(runs: DataFrame, prefix: str, keep: Sequence[str] = ("run_id",)) -> DataFrame:
    """Detection score and mean average precision, not rounded."""
    named = runs.select(
        *keep, F.col("nd_score").alias(f"{prefix}/NDS"), F.col("mean_ap").alias(f"{prefix}/mAP")
    )
    return named.unpivot(list(keep), [f"`{prefix}/NDS`", f"`{prefix}/mAP`"], "metric", "value")


def flatten_metrics(
    runs: DataFrame,
    classes: Sequence[str],
    error_names: Mapping[str, str],
    result_name: str = "pts_bbox",
    exact: bool = False,
    keep: Sequence[str] = ("run_id",),
) -> DataFrame:
    """All metrics of every run in one pass over the runs."""
    prefix = metric_prefix(result_name)
    slash = F.lit(prefix + "/")

    def per_class(by_class: str, joint: str) -> Column:
        def of(name: str) -> Column:
            entry = F.coalesce(
                F.col(by_class)[name], F.raise_error(F.lit(f"no {by_class} of class {name}"))
            )
            return F.transform(
                F.map_entries(entry),
                lambda e: _pair(F.concat(slash, F.lit(name + joint), e["key"]), e["value"]),
            )

        return F.flatten(F.array(*[of(name) for name in classes]))

    means = F.transform(
        F.map_entries("tp_errors"),
        lambda e: _pair(F.concat(slash, lookup(error_names, e["key"], "name for error")), e["value"]),
    )
    heads = F.array(
        _pair(F.lit(f"{prefix}/NDS"), F.col("nd_score"), False),
        _pair(F.lit(f"{prefix}/mAP"), F.col("mean_ap"), False),
    )
    parts = [means, heads]
    if classes:
        parts = [per_class("label_aps", "_AP_dist_"), per_class("label_tp_errors", "_"), *parts]
    else:
        parts = [heads]  # mean errors are written with the classes
    rows = runs.select(*keep, F.explode(F.concat(*parts)).alias("m"))
    value = F.when(F.col("m.rounded"), round4(F.col("m.value"), exact)).otherwise(F.col("m.value"))
    return rows.select(*keep, F.col("m.metric").alias("metric"), value.alias("value"))


def _pair(metric: Column, value: Column, rounded: bool = True) -> Column:
    return F.struct(metric.alias("metric"), value.alias("value"), F.lit(rounded).alias("rounded"))
