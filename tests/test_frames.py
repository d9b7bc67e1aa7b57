import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framewright.functions import geometry as G
from framewright.operators import frames as R
from framewright.plans import samples as S
from framewright.sources.frames import FRAME_SCHEMA, scan_frame_infos

EYE = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
K = [[100.0, 0.0, 50.0], [0.0, 100.0, 40.0], [0.0, 0.0, 1.0]]


def info(n, scene="A", **over):
    record = {
        "token": f"t{n}", "lidar_path": f"l{n}", "prev": f"t{n - 1}", "next": f"t{n + 1}",
        "scene_token": scene, "frame_idx": n, "timestamp": 1_500_000 + n, "sweeps": [],
        "ego2global_translation": [float(n), 2.0, 3.0],
        "ego2global_rotation": [1.0, 0.0, 0.0, 0.0],
        "can_bus": [0.0] * 12,
        "cams": {
            "BACK": {"data_path": f"b{n}", "sensor2lidar_rotation": EYE,
                     "sensor2lidar_translation": [1.0, 2.0, 3.0], "cam_intrinsic": K},
            "FRONT": {"data_path": f"f{n}", "sensor2lidar_rotation": EYE,
                      "sensor2lidar_translation": [0.0, 0.0, 0.0], "cam_intrinsic": K},
        },
    }
    record.update(over)
    return record


@pytest.fixture(scope="module")
def infos(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("infos")
    scenes = "AAABB"
    (folder / "frames.json").write_text(json.dumps([info(n, s) for n, s in enumerate(scenes)]))
    return scan_frame_infos(spark, str(folder))


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_list_position_is_the_key(infos):
    rows = infos.orderBy("frame_no").collect()
    assert [(r.frame_no, r.token) for r in rows] == [(n, f"t{n}") for n in range(5)]


def test_lines_over_many_files_and_bad_records(spark, tmp_path):
    for k in range(3):
        lines = [json.dumps(info(10 * k + n)) for n in range(10)]
        (tmp_path / f"part{k}.json").write_text("\n".join(lines))
    frames = scan_frame_infos(spark, str(tmp_path), lines=True, partitions=4)
    assert [r.token for r in frames.orderBy("frame_no").collect()] == [f"t{n}" for n in range(30)]
    (tmp_path / "part9.json").write_text('{"token": 1, "timestamp": "x"}')
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        scan_frame_infos(spark, str(tmp_path), lines=True).collect()


def test_camera_fixture(spark):
    inv = one(spark, G.inverse_rotation(F.lit(EYE)))
    l2c = one(spark, G.lidar_to_camera(F.lit(inv), F.lit([1.0, 2.0, 3.0])))
    assert l2c == [[1, 0, 0, -1], [0, 1, 0, -2], [0, 0, 1, -3], [0, 0, 0, 1]]
    pad = one(spark, G.pad_intrinsic(F.lit(K)))
    l2i = one(spark, G.lidar_to_image(F.lit(pad), F.lit(l2c)))
    assert l2i == [[100, 0, 50, -250], [0, 100, 40, -320], [0, 0, 1, -3], [0, 0, 0, 1]]
    half = one(spark, G.rescale_camera_matrix(F.lit(l2i), 0.5))
    assert half[:2] == [[50, 0, 25, -125], [0, 50, 20, -160]] and half[2:] == l2i[2:]


def test_inverse_is_a_true_inverse(spark):
    r = np.sin(np.arange(9.0) ** 2).reshape(3, 3)
    inv = one(spark, G.inverse_rotation(F.lit(r.tolist())))
    np.testing.assert_allclose(inv, np.linalg.inv(r), rtol=1e-12, atol=1e-12)
    with pytest.raises(PySparkException, match="singular"):
        one(spark, G.inverse_rotation(F.lit([[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [0.0, 0.0, 1.0]])))


def test_pad_intrinsic_shapes(spark):
    for shape in ((3, 3), (3, 4), (4, 4), (2, 3)):
        k = np.arange(1.0, 1 + shape[0] * shape[1]).reshape(shape)
        expected = np.eye(4)
        expected[: shape[0], : shape[1]] = k
        assert one(spark, G.pad_intrinsic(F.lit(k.tolist()))) == expected.tolist()
    with pytest.raises(PySparkException, match="larger"):
        one(spark, G.pad_intrinsic(F.lit(np.ones((5, 5)).tolist())))


@pytest.mark.parametrize("degrees", [0, 90, 135, 180, 270, 359])
def test_heading(spark, degrees):
    half = np.radians(degrees) / 2
    q = [float(3 * np.cos(half)), 0.0, 0.0, float(3 * np.sin(half))]  # length does not matter
    assert one(spark, G.quaternion_heading(F.lit(q))) == pytest.approx(degrees, abs=1e-9)


def test_pose_slots(spark):
    bus = [float(i) for i in range(18)]
    out = one(spark, G.write_pose_slots(F.lit(bus), F.lit([-1.0, -2.0, -3.0]), F.lit([0.5] * 4), F.lit(90.0)))
    assert out[:7] == [-1, -2, -3, 0.5, 0.5, 0.5, 0.5] and out[7:16] == bus[7:16]
    assert out[16:] == [pytest.approx(np.pi / 2), 90.0]
    nine = one(spark, G.write_pose_slots(F.lit(bus[:9]), F.lit([1.0] * 3), F.lit([0.5] * 4), F.lit(0.0)))
    assert len(nine) == 9
    with pytest.raises(PySparkException, match="at least 9"):
        one(spark, G.write_pose_slots(F.lit(bus[:8]), F.lit([1.0] * 3), F.lit([0.5] * 4), F.lit(0.0)))


def test_lookup(spark, infos):
    wanted = spark.createDataFrame([(3,), (0,), (3,)], "frame_no long")
    assert sorted(r.token for r in R.frame_lookup(infos, wanted).collect()) == ["t0", "t3", "t3"]
    beyond = spark.createDataFrame([(99,)], "frame_no long")
    assert R.frame_lookup(infos, beyond, "drop").count() == 0
    assert R.frame_lookup(infos, beyond, "null").first().token is None
    with pytest.raises(PySparkException, match="no frame 99"):
        R.frame_lookup(infos, beyond).collect()


def test_cameras_follow_the_list(infos):
    rows = R.explode_cameras(infos, ["FRONT", "SIDE", "BACK"]).where("frame_no = 0").collect()
    assert [(r.cam_idx, r.cam_type, r.data_path) for r in rows] == [(0, "FRONT", "f0"), (1, "BACK", "b0")]
    with pytest.raises(PySparkException, match="unlisted camera"):
        R.explode_cameras(infos, ["FRONT"]).collect()


def test_both_camera_forms_agree(infos):
    cameras = ["FRONT", "BACK"]
    arrays = R.collect_cameras(infos, cameras).select("token", *R.CAMERA_COLUMNS)
    rows = R.camera_matrices(R.explode_cameras(infos, cameras)).withColumnRenamed("data_path", "img_filename")
    grouped = R.regroup_cameras(rows, "token", R.CAMERA_COLUMNS)
    assert sorted(map(str, arrays.collect())) == sorted(map(str, grouped.collect()))


def test_views(spark, infos):
    notes = spark.createDataFrame([(n, [0]) for n in range(5) if n != 1], "frame_no long, gt_labels array<int>")
    cameras = ["FRONT", "BACK"]
    test = S.train_or_test_view(infos, cameras, test_mode=True)
    assert "ann_info" not in test.columns and test.count() == 5
    assert test.where("frame_no = 4").first().timestamp == pytest.approx(1.500004)
    shapes = [lambda df: df.withColumn("img_shape", F.lit("450x800"))]
    with pytest.raises(ValueError, match="img_shape"):
        S.train_or_test_view(infos, cameras, False, notes, length=2, seed=1)
    train = S.train_or_test_view(infos, cameras, False, notes, length=2, seed=1, stages=shapes)
    kept = {r.queue_no: r for r in train.collect()}
    assert set(kept) <= {0, 2, 3, 4} and {0, 4} <= set(kept)
    assert kept[4].img[-1] == ["f4", "b4"] and len(kept[4].img_metas) == 2
    assert kept[4].pts_filename == "l4" and kept[4].prev_idx == "t3" and kept[4].timestamp == pytest.approx(1.500004)
    assert kept[4].sweeps == [] and kept[4].ego2global_translation == [4.0, 2.0, 3.0] and kept[4].can_bus[0] == 4.0
    by_frame = [lambda df: df.withColumn("img_shape", F.col("frame_no"))]
    with pytest.raises(PySparkException, match="differ in shape"):
        S.train_or_test_view(infos, cameras, False, notes, length=2, seed=1, stages=by_frame).collect()
    full = S.train_or_test_view(infos, cameras, False, notes, length=2, seed=1, replace=True, stages=shapes)
    assert sorted(r.queue_no for r in full.collect()) == [0, 1, 2, 3, 4]
    assert "cams" not in S.frame_view(infos, cameras, use_camera=False).columns
    with pytest.raises(ValueError):
        S.train_or_test_view(infos, cameras, False, length=2, seed=1)


def test_schema_has_every_field():
    assert set(R.FRAME_FIELDS) < set(FRAME_SCHEMA.fieldNames())
