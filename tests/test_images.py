import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framewright.functions.kernels import KERNELS, axis_taps, weight_matrix
from framewright.operators import images as I
from framewright.plans.stages import run_stages
from framewright.sources.images import scan_images, write_images

SCHEMA = "image_id int, height int, width int, channels int, pixels array<double>"


def table(spark, *arrays):
    rows = []
    for i, a in enumerate(arrays):
        a = np.asarray(a, float)
        a = a[:, :, None] if a.ndim == 2 else a
        rows.append((i, *a.shape, a.ravel().tolist()))
    return spark.createDataFrame(rows, SCHEMA)


def arrays(df):
    return [np.array(r.pixels).reshape(r.height, r.width, r.channels) for r in df.orderBy("image_id").collect()]


def png(pixels):
    """Bytes of an 8-bit RGB or gray file."""
    h, w = pixels.shape[:2]
    kind = 2 if pixels.ndim == 3 else 0
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_bilinear_fixture(spark):
    out = I.resample_images(table(spark, [[1, 3, 5, 9]]), 1, 2)
    assert arrays(out)[0].ravel().tolist() == [2, 7]


CASES = [(b, k) for b, ks in KERNELS.items() for k in ks]


@pytest.mark.parametrize("backend,kernel", CASES)
def test_engines_agree_on_rows_of_different_size(spark, backend, kernel):
    pixels = 127.5 + 127.5 * np.sin(np.arange(200.0) ** 2)
    images = table(spark, pixels[:162].reshape(6, 9, 3), pixels[20:32].reshape(3, 4), pixels[50:74].reshape(12, 2))
    height, width = F.lit(5), (F.col("width") / 2 + 2).cast("int")
    a, b = (arrays(I.resample_images(images, height, width, kernel, backend, e)) for e in ("sql", "arrow"))
    assert [x.shape for x in a] == [(5, 6, 3), (5, 4, 1), (5, 3, 1)]
    for x, y in zip(a, b):
        np.testing.assert_allclose(x, y, atol=1e-9)


@pytest.mark.parametrize("backend,kernel", CASES)
@pytest.mark.parametrize("src,dst", [(8, 5), (5, 8), (7, 7), (1, 3), (9, 1)])
def test_weights_sum_to_one(spark, backend, kernel, src, dst):
    taps = axis_taps(F.lit(src), F.lit(dst), kernel, backend, F.lit(src >= dst))
    rows = spark.range(1).select(taps.alias("t")).first().t
    dense = np.zeros((dst, src))
    for d, row in enumerate(rows):
        for t in row:
            dense[d, t.src] += t.w
    np.testing.assert_allclose(dense.sum(axis=1), 1, atol=1e-12)
    np.testing.assert_allclose(dense, weight_matrix(src, dst, kernel, backend, src >= dst), atol=1e-12)
    if src == dst:
        np.testing.assert_allclose(dense, np.eye(src), atol=1e-12)


def test_same_pixels_after_a_filter_and_a_chain(spark):
    images = table(spark, np.arange(48).reshape(4, 4, 3), np.ones((4, 4, 3)))
    chain = I.pad_images(I.resample_images(I.normalize_images(images), 2, 2), 4).where(F.size("pixels") > 0)
    assert [a.shape for a in arrays(chain)] == [(4, 4, 3)] * 2


def test_unknown_names(spark):
    images = table(spark, [[1.0]])
    for args in (("bilinear", "other"), ("area", "pillow"), ("hamming", "cv2")):
        with pytest.raises(ValueError):
            I.resample_images(images, 1, 1, *args)
    with pytest.raises(ValueError):
        I.resample_images(images, 1, 1, engine="gpu")
    with pytest.raises(ValueError):
        I.convert_channels(images, "sepia")
    with pytest.raises(PySparkException, match="at least 1"):
        I.resample_images(images, 0, 1).collect()


def test_rescale_truncates_and_keeps_the_original_shape(spark):
    l2i = [[100.0, 0.0, 50.0, -250.0], [0.0, 100.0, 40.0, -320.0], [0.0, 0.0, 1.0, -3.0], [0.0, 0.0, 0.0, 1.0]]
    images = table(spark, np.ones((5, 7))).withColumn("lidar2img", F.lit(l2i))
    row = I.rescale_views(images, 0.5).first()
    assert (row.height, row.width) == (2, 3)
    assert tuple(row.img_shape) == (2, 3, 1) and tuple(row.ori_shape) == (5, 7, 1)
    assert row.lidar2img[0] == [50, 0, 25, -125] and row.lidar2img[2] == l2i[2]
    assert tuple(I.rescale_views(images, 0.5, compat=True).first().ori_shape) == (2, 3, 1)


def test_normalize_against_numpy(spark):
    image = (127.5 + 127.5 * np.sin(np.arange(36.0) ** 2)).reshape(3, 4, 3)
    got = arrays(I.normalize_images(table(spark, image)))[0]
    mean, std = (np.array(I.IMAGE_NORM[k]) for k in ("mean", "std"))
    np.testing.assert_allclose(got, (image[:, :, ::-1] - mean) / std)
    plain = arrays(I.normalize_images(table(spark, image), to_rgb=False))[0]
    np.testing.assert_allclose(plain, (image - mean) / std)


def test_padding(spark):
    out = arrays(I.pad_images(table(spark, np.ones((33, 64)), np.ones((32, 32)))))
    assert out[0].shape == (64, 64, 1) and out[0].sum() == 33 * 64 and out[0][33:].sum() == 0
    assert out[1].shape == (32, 32, 1)


def test_rmse(spark):
    a, b = table(spark, [[0, 0, 0, 0]], [[0]]), table(spark, [[3, 4, 0, 0]], [[16]])
    assert [r.rmse for r in I.image_rmse(a, b).orderBy("image_id").collect()] == [2.5, 16]
    assert [r.rmse for r in I.image_rmse(a, a).collect()] == [0, 0]
    with pytest.raises(PySparkException, match="lack a partner"):
        I.image_rmse(a, b.where("image_id = 0")).collect()
    with pytest.raises(PySparkException, match="differ in size"):
        I.image_rmse(a, table(spark, [[0], [0], [0], [0]], [[0]])).collect()


def test_channels(spark):
    image = (127.5 + 127.5 * np.sin(np.arange(18.0) ** 2)).reshape(2, 3, 3)
    images = table(spark, image)
    np.testing.assert_allclose(arrays(I.convert_channels(images, "color", "rgb"))[0], image[:, :, ::-1])
    np.testing.assert_allclose(arrays(I.convert_channels(images, "unchanged", "rgb"))[0], image)
    gray = arrays(I.convert_channels(images, "grayscale"))[0]
    np.testing.assert_allclose(gray[:, :, 0], image @ np.array([0.114, 0.587, 0.299]))


def test_scan_images(spark, tmp_path):
    image = (np.arange(60) * 37 % 256).reshape(4, 5, 3)
    (tmp_path / "a.png").write_bytes(png(image))
    (tmp_path / "b.png").write_bytes(png(image[:, :, 0]))
    bgr = {r.path[-5:]: r for r in scan_images(spark, str(tmp_path)).collect()}
    got = np.array(bgr["a.png"].pixels).reshape(4, 5, 3)
    np.testing.assert_array_equal(got, image[:, :, ::-1])
    assert bgr["b.png"].channels == 3
    raw = {r.path[-5:]: r for r in scan_images(spark, str(tmp_path), "unchanged").collect()}
    assert raw["b.png"].channels == 1
    rgb = {r.path[-5:]: r for r in scan_images(spark, str(tmp_path), "color", "rgb").collect()}
    np.testing.assert_array_equal(np.array(rgb["a.png"].pixels).reshape(4, 5, 3), image)
    gray = scan_images(spark, str(tmp_path), "grayscale").collect()
    assert {r.channels for r in gray} == {1}
    with pytest.raises(ValueError):
        scan_images(spark, str(tmp_path), "sepia")
    (tmp_path / "c.png").write_bytes(b"no image")
    with pytest.raises(PySparkException, match="cannot be read"):
        scan_images(spark, str(tmp_path)).collect()
    with pytest.raises(PySparkException):
        scan_images(spark, str(tmp_path / "missing.png")).collect()


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_written_images_come_back(spark, tmp_path, channels):
    shapes = [(1, 1), (4, 5), (3, 70), (300, 90)]  # the last takes several stored blocks
    images = [np.arange(h * w * channels).reshape(h, w, channels) * 37 % 256 for h, w in shapes]
    named = table(spark, *images).withColumn("path", F.concat(F.lit("i"), "image_id"))
    write_images(named.repartition(3), str(tmp_path / "files"))
    rows = {r.path.split("/")[-1]: r for r in scan_images(spark, str(tmp_path / "files"), "unchanged").collect()}
    assert set(rows) == {f"i{k}.png" for k in range(len(images))}
    for k, image in enumerate(images):
        r = rows[f"i{k}.png"]
        np.testing.assert_array_equal(np.array(r.pixels).reshape(r.height, r.width, r.channels), image)
    assert (tmp_path / "files" / "_SUCCESS").exists()
    assert sorted(p.name for p in (tmp_path / "files").glob(".*.png")) == []
    write_images(named.where("false"), f"file://{tmp_path}/none")
    assert (tmp_path / "none" / "_SUCCESS").exists()


def test_images_that_cannot_be_written(spark, tmp_path):
    good = table(spark, np.ones((2, 3, 3)), np.ones((2, 3, 1))).withColumn("path", F.concat(F.lit("i"), "image_id"))
    with pytest.raises(ValueError, match="two images are named same"):
        write_images(good.withColumn("path", F.lit("same")), str(tmp_path / "a"))
    bad = {
        "no name": good.withColumn("path", F.lit(None).cast("string")),
        "no name for an image file: 'up": good.withColumn("path", F.concat(F.lit("up/"), "path")),
        "image i. has values that are no bytes": good.withColumn("pixels", F.transform("pixels", lambda v: v * 300)),
        "values": good.withColumn("pixels", F.transform("pixels", lambda v: v * float("nan"))),
        "size of image i. differ": good.withColumn("height", F.lit(9)),
        "size of image i1? differ": good.where("image_id = 1").withColumn("pixels", F.lit(None).cast("array<double>")),
        "cannot have 2 channels": good.where("image_id = 1").selectExpr("path", "2 AS height", "1 AS width", "2 AS channels", "array(1D, 2D, 3D, 4D) AS pixels"),
        "cannot be empty": good.selectExpr("path", "0 AS height", "0 AS width", "1 AS channels", "cast(array() AS array<double>) AS pixels"),
    }
    for k, (reason, images) in enumerate(bad.items()):
        with pytest.raises(PySparkException, match=reason):
            write_images(images, str(tmp_path / f"b{k}"))
        assert not (tmp_path / f"b{k}" / "_SUCCESS").exists()


def test_stages(spark):
    images = table(spark, np.ones((40, 70, 3))).withColumnRenamed("pixels", "p")
    stages = [
        {"type": "Name"},
        {"type": "PhotoMetric"},
        {"type": "NormalizeMultiviewImage"},
        {"type": "Inner", "transforms": [
            {"type": "RandomScaleImageMultiViewImage", "scales": [0.5]},
            {"type": "PadMultiViewImage", "size_divisor": 32},
        ]},
        {"type": "CustomCollect3D", "keys": ["height", "width", "pixels"]},
    ]
    own = {"Name": lambda df: df.withColumnRenamed("p", "pixels")}
    row = run_stages(images, stages, own, skip=["PhotoMetric"]).first()
    assert (row.height, row.width, len(row.pixels)) == (32, 64, 32 * 64 * 3)
    with pytest.raises(ValueError, match="unknown stage"):
        run_stages(images, stages, own)
    with pytest.raises(ValueError, match="one scale"):
        run_stages(images, [{"type": "RandomScaleImageMultiViewImage", "scales": []}])


def test_load_views(spark):
    samples = spark.createDataFrame([(1, ["a", "b"])], "sample_id int, img_filename array<string>")
    images = table(spark, [[1.0]], [[2.0]]).withColumn("path", F.element_at(F.array(F.lit("a"), F.lit("b")), F.col("image_id") + 1))
    stage = [{"type": "LoadMultiViewImageFromFiles", "images": images}]
    rows = run_stages(samples, stage).orderBy("cam_idx").collect()
    assert [(r.cam_idx, r.pixels) for r in rows] == [(0, [1.0]), (1, [2.0])]
    stage[0]["images"] = images.where("path = 'a'")
    with pytest.raises(PySparkException, match="not found: b"):
        run_stages(samples, stage).collect()


def test_implementations_are_compared_without_a_shuffle(spark):
    rows = [(k, 4, 6, 1, [float((k * 7 + j * j) % 256) for j in range(24)]) for k in range(9)]
    images = spark.createDataFrame(rows, "image_id int, height int, width int, channels int, pixels array<double>")
    half = {e: (lambda df, e=e: I.resample_images(df, 3, 2, "bilinear", engine=e)) for e in ("sql", "arrow")}
    got = I.compare_implementations(images, {"resize": (half["sql"], half["arrow"]), "same": (half["sql"], half["sql"])})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    found = got.collect()
    assert len(found) == 18 and all(r["rmse"] < 1e-9 for r in found)
    moved = I.compare_implementations(images, {"shift": (lambda df: df, lambda df: df.withColumn("pixels", F.transform("pixels", lambda v: v + 3)))})
    assert {round(r["rmse"], 9) for r in moved.collect()} == {3.0}
    with pytest.raises(Exception, match="differ in size"):
        I.compare_implementations(images, {"sizes": (half["sql"], lambda df: df)}).collect()
