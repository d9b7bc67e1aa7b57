"""From frame records to test views and training samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from framewright.operators import frames as R, queues as Q

Stage = Callable[[DataFrame], DataFrame]

META_FIELDS = ("frame_no", "sample_idx", "scene_token", "lidar2img", "prev_bev_exists", "relative")


def frame_view(
    infos: DataFrame,
    cameras: Sequence[str],
    use_camera: bool = True,
    annotations: DataFrame | None = None,
) -> DataFrame:
    """Frames ready for use: fields, camera arrays, pose, annotation.

    Without ``annotations`` this is the view for testing. Nothing here
    shuffles but the annotation join.
    """
    kept = ["frame_no", "cams"] if use_camera else ["frame_no"]
    view = R.frame_fields(infos, kept)
    if use_camera:
        view = R.collect_cameras(view, cameras)
    view = R.ego_pose(view)
    return view if annotations is None else R.attach_annotations(view, annotations)


def training_samples(
    infos: DataFrame,
    annotations: DataFrame,
    cameras: Sequence[str],
    length: int,
    seed: int,
    labels: str = "gt_labels",
    filter_empty: bool = True,
    replace: bool = False,
    stages: Sequence[Stage] = (),
    image: str = "img_filename",
    shape: str = "img_shape",
) -> DataFrame:
    """One sample per frame: its queue's images and metas, poses relative.

    Every frame is prepared once, before it is placed in the queues. Images
    stay references, so the queue shuffle moves names, not pixels.
    ``filter_empty`` drops queues with an unlabelled frame; ``replace``
    instead fills their places with drawn accepted ones. The sample keeps the
    other fields of its current frame. The stages must have added ``shape``,
    the shapes of the frame's images, which must agree within a queue.
    """
    frames = frame_view(infos, cameras, annotations=annotations)
    for stage in stages:
        frames = frames.transform(stage)
    if shape not in frames.columns:
        raise ValueError(f"the frames have no {shape}: add a stage that records the images' shapes")
    frames = Q.label_flag(frames, F.col(f"ann_info.{labels}"), "_has_gt")
    columns = ["sample_idx", "scene_token", "lidar2img", "can_bus", "_has_gt", shape, image]
    queues = Q.build_queues(frames, length, columns, seed)
    if replace:
        queues = Q.replace_rejected(queues, seed, flag="_has_gt")
    else:
        queues = Q.filter_empty_queues(queues, enabled=filter_empty, flag="_has_gt")
    queues = Q.relative_pose(Q.scene_start_flag(queues))
    return Q.merge_queue(queues, META_FIELDS, image, shape).drop("_has_gt")


def train_or_test_view(
    infos: DataFrame,
    cameras: Sequence[str],
    test_mode: bool,
    annotations: DataFrame | None = None,
    **training,
) -> DataFrame:
    """Test mode: single frames without annotation; else training samples."""
    if test_mode:
        return frame_view(infos, cameras)
    if annotations is None:
        raise ValueError("training samples need annotations")
    return training_samples(infos, annotations, cameras, **training)
