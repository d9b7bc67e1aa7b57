"""Filters on annotated objects, one row per object or arrays per sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# X, y, z from and to, in metres
POINT_CLOUD_RANGE = (-51.2, -51.2, -5.0, 51.2, 51.2, 3.0)


def in_range(x: Column, y: Column, bounds: Sequence[float] = POINT_CLOUD_RANGE) -> Column:
    """Whether a centre lies strictly inside the range, seen from above."""
    x0, y0, _, x1, y1, _ = bounds
    return (x > x0) & (x < x1) & (y > y0) & (y < y1)


def object_range_filter(
    samples: DataFrame,
    point_cloud_range: Sequence[float] = POINT_CLOUD_RANGE,
    boxes: str = "gt_bboxes_3d",
    labels: str = "gt_labels_3d",
) -> DataFrame:
    """Keep objects inside the range.

    With a ``boxes`` column the sample holds parallel arrays, filtered
    together; else every row is one object with ``x`` and ``y``.
    """
    if boxes not in samples.columns:
        return samples.where(in_range(F.col("x"), F.col("y"), point_cloud_range))
    return _filter_objects(
        samples, boxes, labels, lambda o: in_range(o[boxes][0], o[boxes][1], point_cloud_range)
    )


def object_name_filter(
    samples: DataFrame,
    classes: Sequence[str],
    names: str = "gt_names",
    boxes: str = "gt_bboxes_3d",
    labels: str = "gt_labels_3d",
) -> DataFrame:
    """Keep objects of the named classes.

    With a ``boxes`` column the labels are positions in ``classes``; else
    every row is one object with a class name.
    """
    if boxes not in samples.columns:
        return samples.where(F.col(names).isin(list(classes)))
    return _filter_objects(samples, boxes, labels, lambda o: o[labels].between(0, len(classes) - 1))


def collect_columns(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.select(*keys)


def _filter_objects(samples: DataFrame, boxes: str, labels: str, keep) -> DataFrame:
    kept = F.filter(F.arrays_zip(boxes, labels), keep)
    return samples.withColumn("_objects", kept).withColumns(
        {
            boxes: F.transform("_objects", lambda o: o[boxes]),
            labels: F.transform("_objects", lambda o: o[labels]),
        }
    ).drop("_objects")
