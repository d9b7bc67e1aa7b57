"""Declared preparation: an ordered list of ``{"type": ..., arguments}``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from framewright.operators import images as I, objects as O

Stage = Callable[..., DataFrame]


def load_views(samples: DataFrame, images: DataFrame, paths: str = "img_filename") -> DataFrame:
    """One row per sample and view with its image, joined by path.

    A view whose image is missing fails the job. Paths are unique among the
    images, so only the image side carries pixels through the join.
    """
    views = samples.select("*", F.posexplode(paths).alias("cam_idx", "path")).drop(paths)
    found = views.join(images, "path", "left")
    present = F.when(F.col("height").isNotNull(), F.col("path")).otherwise(
        F.raise_error(F.concat(F.lit("image file not found: "), F.col("path")))
    )
    return found.withColumn("path", present)


def scale_views(samples: DataFrame, scales: Sequence[float], **options: Any) -> DataFrame:
    if len(scales) != 1:
        raise ValueError("exactly one scale is supported")
    return I.rescale_views(samples, scales[0], **options)


# Stage names as the declared lists spell them
STAGES: dict[str, Stage] = {
    "LoadMultiViewImageFromFiles": load_views,
    "NormalizeMultiviewImage": I.normalize_images,
    "RandomScaleImageMultiViewImage": scale_views,
    "PadMultiViewImage": I.pad_images,
    "ObjectRangeFilter": O.object_range_filter,
    "ObjectNameFilter": O.object_name_filter,
    "CustomCollect3D": O.collect_columns,
}


def run_stages(
    samples: DataFrame,
    stages: Sequence[Mapping[str, Any]],
    registry: Mapping[str, Stage] | None = None,
    skip: Sequence[str] = (),
) -> DataFrame:
    """Chain the stages into one lazy DataFrame.

    ``registry`` adds stages of the caller or replaces built-in ones. A
    stage with ``transforms`` stands for that inner list. Types in ``skip``
    are passed over; any other unknown type is an error.
    """
    known = {**STAGES, **(registry or {})}
    for stage in stages:
        arguments = dict(stage)
        kind = arguments.pop("type")
        if kind in skip:
            continue
        if "transforms" in arguments and kind not in (registry or {}):
            samples = run_stages(samples, arguments["transforms"], registry, skip)
        elif kind in known:
            samples = samples.transform(known[kind], **arguments)
        else:
            raise ValueError(f"unknown stage type: {kind}")
    return samples
