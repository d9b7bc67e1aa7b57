"""Tiled images against whole ones."""

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from framewright.functions.kernels import KERNELS
from framewright.operators.images import resample_images
from framewright.operators.tiles import cut_tiles, join_tiles, resample_tiles, tile_pixels

COLUMNS = "image_id int, height int, width int, channels int, pixels array<double>"
SIZES = [(1, 1, 1), (7, 3, 1), (13, 21, 3), (40, 9, 4)]


@pytest.fixture(scope="module")
def images(spark):
    values = np.random.default_rng(3)
    rows = [(i, h, w, c, values.uniform(0, 255, h * w * c).tolist()) for i, (h, w, c) in enumerate(SIZES)]
    return spark.createDataFrame(rows, COLUMNS)


def arrays(df):
    return {r.image_id: (r.height, r.width, r.channels, r.pixels) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for i in a:
        assert a[i][:3] == b[i][:3]
        np.testing.assert_allclose(a[i][3], b[i][3], atol=1e-9)


def test_cut_and_joined(images):
    tiles = cut_tiles(images, 4)
    assert tiles.agg(F.max("tile_height"), F.max("tile_width")).first() == (4, 4)
    same(arrays(join_tiles(tiles)), arrays(images))
    placed = {(r.image_id, r.y, r.x, r.c): r.v for r in tile_pixels(tiles).collect()}
    for i, (h, w, c, pixels) in arrays(images).items():
        for y, x, k in np.ndindex(h, w, c):
            assert placed.pop((i, y, x, k)) == pixels[(y * w + x) * c + k]
    assert not placed


@pytest.mark.parametrize("backend, kernel", [(b, k) for b, ks in KERNELS.items() for k in ks])
def test_equals_the_whole_image(images, backend, kernel):
    three = images.select(*images.columns, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("case"))
    three = three.withColumn("image_id", F.col("image_id") * 3 + F.col("case"))
    case = F.col("image_id") % 3
    h = F.when(case == 0, 17).when(case == 1, 2).otherwise(F.col("height") * 2)
    w = F.when(case == 0, 30).when(case == 1, 3).otherwise(F.ceil(F.col("width") / 5))
    whole = resample_images(three, h, w, kernel, backend, "arrow")
    tiled = join_tiles(resample_tiles(cut_tiles(three, 4), h, w, kernel, backend, tile=4))
    same(arrays(tiled), arrays(whole))


def test_one_large_image_takes_many_small_tiles(spark):
    """3000 by 2000 pixels to 90 by 70: no row of the result, and no share, is larger than a tile."""
    tiles = spark.range(12).select(
        F.lit(0).alias("image_id"), F.lit(3000).alias("height"), F.lit(2000).alias("width"), F.lit(1).alias("channels"),
        (F.floor(F.col("id") / 3) * 750).cast("int").alias("top"), (F.col("id") % 3 * 667).cast("int").alias("left"),
    )
    tiles = tiles.withColumn("tile_height", F.lit(750)).withColumn("tile_width", F.least(F.lit(667), 2000 - F.col("left")))
    value = F.transform(F.sequence(F.lit(0), F.col("tile_height") * F.col("tile_width") - 1), lambda i: (F.col("top") + F.floor(i / F.col("tile_width"))).cast("double"))
    small = resample_tiles(tiles.withColumn("pixels", value), 90, 70, "box", "pillow", tile=750)
    assert small.count() == 5 * 3 and small.agg(F.max(F.size("pixels"))).first()[0] <= 22 * 26
    for r in tile_pixels(small).where("x = 11").collect():
        assert abs(r.v - (r.y + 0.5) * 3000 / 90 + 0.5) < 0.6


def test_a_missing_or_repeated_tile_fails(images):
    tiles = cut_tiles(images.where("image_id = 2"), 4)
    for wrong in (tiles.where("top > 0 OR left > 0"), tiles.unionByName(tiles.where("top = 4 AND left = 4"))):
        with pytest.raises(Exception, match="missing or repeated tiles"):
            resample_tiles(wrong, 5, 5, tile=4).collect()
        with pytest.raises(PythonException, match="missing or repeated tiles"):
            join_tiles(wrong).collect()


def test_nulls_empty_tables_and_other_columns(spark, images):
    assert resample_tiles(cut_tiles(images.limit(0)), 5, 5).count() == 0
    assert cut_tiles(spark.createDataFrame([(1, 0, 5, 1, [])], COLUMNS)).count() == 0
    unknown = spark.createDataFrame([(None, 8, 8, 1, None)], COLUMNS)
    tiles = cut_tiles(unknown.withColumn("a.b", F.lit("x")), 4)
    assert tiles.count() == 4 and tiles.first()["a.b"] == "x"
    assert [r.pixels for r in resample_tiles(tiles, 4, 4).collect()] == [None]
    holed = cut_tiles(images.where("image_id = 3"), 4).withColumn("pixels", F.when(F.col("top") < 36, F.col("pixels")))
    found = {(r.top, r.left): r.pixels for r in resample_tiles(holed, 40, 9, "nearest", tile=4).collect()}
    assert found[0, 0] is not None and found[36, 8] is None
    with pytest.raises(Exception, match="at least 1"):
        resample_tiles(cut_tiles(images), 0, 5).collect()
