"""Frame records: lookup, projection, cameras, annotations.

Frames are keyed by ``frame_no``, their position in the dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framewright.functions import geometry as G
from framewright.functions.binding import let

# Record fields and the names they are passed on under
FRAME_FIELDS = {
    "token": "sample_idx",
    "lidar_path": "pts_filename",
    "sweeps": "sweeps",
    "ego2global_translation": "ego2global_translation",
    "ego2global_rotation": "ego2global_rotation",
    "prev": "prev_idx",
    "next": "next_idx",
    "scene_token": "scene_token",
    "can_bus": "can_bus",
    "frame_idx": "frame_idx",
    "timestamp": "timestamp",
}
CAMERA_COLUMNS = ("img_filename", "lidar2img", "cam_intrinsic", "lidar2cam")
MICROS = 1e6


def frame_lookup(frames: DataFrame, requests: DataFrame, missing: str = "error") -> DataFrame:
    """Fetch many frames by position with one join on ``frame_no``.

    ``frame_no`` is unique among the frames, so a request repeated without
    end only makes the request side large, which adaptive execution splits.
    """
    if missing not in ("error", "null", "drop"):
        raise ValueError(f"missing must be 'error', 'null' or 'drop', not {missing!r}")
    if missing == "drop":
        return requests.join(frames, "frame_no")
    found = requests.join(frames.withColumn("_found", F.lit(True)), "frame_no", "left")
    if missing == "null":
        return found.drop("_found")
    known = F.when(F.col("_found"), F.col("frame_no")).otherwise(
        F.raise_error(F.concat(F.lit("no frame "), F.col("frame_no").cast("string")))
    )
    return found.withColumn("frame_no", known).drop("_found")


def frame_count(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count("*").alias("n_frames"))


def micros_to_seconds(timestamp: Column) -> Column:
    return timestamp / F.lit(MICROS)


def frame_fields(frames: DataFrame, keep: Sequence[str] = ("frame_no",)) -> DataFrame:
    """The fields a sample is made of, under their sample names."""
    return frames.select(
        *keep,
        *[
            (micros_to_seconds(F.col(old)) if old == "timestamp" else F.col(old)).alias(new)
            for old, new in FRAME_FIELDS.items()
        ],
    )


def ordered_cameras(cams: str | Column, cameras: Sequence[str]) -> Column:
    """A camera map as an array in the given order, absent cameras left out.

    Maps have no order, so the list gives it; a camera outside the list
    fails the job rather than getting lost.
    """
    def listed(cams: Column) -> Column:
        named = F.array(*[F.lit(c) for c in cameras])
        known = F.filter(named, lambda c: F.map_contains_key(cams, c))
        found = F.transform(known, lambda c: F.struct(c.alias("cam_type"), cams[c].alias("cam")))
        keys = F.map_keys(cams)
        return F.when(F.size(known) == F.size(keys), found).otherwise(
            F.raise_error(F.concat(F.lit("unlisted camera among: "), F.array_join(keys, ", ")))
        )

    return let(F.col(cams) if isinstance(cams, str) else cams, listed)


def explode_cameras(frames: DataFrame, cameras: Sequence[str], cams: str = "cams") -> DataFrame:
    """One row per frame and camera: ``cam_idx``, ``cam_type`` and its record."""
    others = [c for c in frames.columns if c != cams]
    rows = frames.select(*others, F.posexplode(ordered_cameras(cams, cameras)).alias("cam_idx", "_c"))
    return rows.select(*others, "cam_idx", "_c.cam_type", "_c.cam.*")


def camera_view(cam: Column) -> Column:
    """The three matrices of a camera record, each computed once."""

    def placed(c: Column) -> Column:
        return F.struct(
            c["pad"].alias("pad"), G.lidar_to_camera(c["inverse"], c["shift"]).alias("l2c")
        )

    def projected(c: Column) -> Column:
        return F.struct(
            G.lidar_to_image(c["pad"], c["l2c"]).alias("lidar2img"),
            c["pad"].alias("cam_intrinsic"),
            c["l2c"].alias("lidar2cam"),
        )

    calibration = F.struct(
        G.inverse_rotation(cam["sensor2lidar_rotation"]).alias("inverse"),
        cam["sensor2lidar_translation"].alias("shift"),
        G.pad_intrinsic(cam["cam_intrinsic"]).alias("pad"),
    )
    return let(let(calibration, placed), projected)


def camera_matrices(rows: DataFrame) -> DataFrame:
    """Add the three matrices to exploded camera rows."""
    record = F.struct("sensor2lidar_rotation", "sensor2lidar_translation", "cam_intrinsic")
    return (
        rows.withColumn("_view", let(record, camera_view))
        .withColumns({c: F.col("_view")[c] for c in CAMERA_COLUMNS[1:]})
        .drop("_view")
    )


def collect_cameras(frames: DataFrame, cameras: Sequence[str], cams: str = "cams") -> DataFrame:
    """Replace the camera map by parallel arrays, without a shuffle."""

    def view(c: Column) -> Column:
        return F.struct(c["cam"]["data_path"].alias("img_filename"), camera_view(c["cam"]).alias("m"))

    others = [c for c in frames.columns if c != cams]
    views = F.transform(ordered_cameras(cams, cameras), view)
    return frames.select(*others, views.alias("_views")).select(
        *others,
        F.col("_views.img_filename").alias("img_filename"),
        *[F.col(f"_views.m.{c}").alias(c) for c in CAMERA_COLUMNS[1:]],
    )


def regroup_cameras(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per-camera rows back to parallel arrays in camera order.

    For results of jobs that needed camera rows. A group has one row per
    camera, so it stays small.
    """
    ordered = F.sort_array(F.collect_list(F.struct("cam_idx", *columns)))
    return rows.groupBy(key).agg(ordered.alias("_views")).select(
        key, *[F.col("_views")[c].alias(c) for c in columns]
    )


def camera_modality(
    frames: DataFrame, cameras: Sequence[str], use_camera: bool = True, cams: str = "cams"
) -> DataFrame:
    """Camera arrays if the modality asks for cameras; else none is read."""
    return collect_cameras(frames, cameras, cams) if use_camera else frames.drop(cams)


def attach_annotations(frames: DataFrame, annotations: DataFrame) -> DataFrame:
    """Add the annotation record of the same position as ``ann_info``."""
    record = F.struct(*[c for c in annotations.columns if c != "frame_no"])
    return frames.join(annotations.select("frame_no", record.alias("ann_info")), "frame_no", "left")


def ego_pose(samples: DataFrame) -> DataFrame:
    """Write translation, rotation and heading into ``can_bus``."""
    return (
        samples.withColumn("_heading", G.quaternion_heading(F.col("ego2global_rotation")))
        .withColumn(
            "can_bus",
            G.write_pose_slots(
                F.col("can_bus"),
                F.col("ego2global_translation"),
                F.col("ego2global_rotation"),
                F.col("_heading"),
            ),
        )
        .drop("_heading")
    )
