"""Image tables: resample, normalise, pad, compare.

One row per image: key columns, ``height``, ``width``, ``channels`` and
``pixels``, an array of doubles ordered by row, column, channel. Work on an
image stays inside its row, so none of this shuffles pixels; only the
comparison joins two tables, on the image key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from framewright.functions.binding import let_all
from framewright.functions.geometry import rescale_camera_matrix
from framewright.functions.kernels import axis_taps, check_kernel, weight_matrix

# Channel statistics in RGB order, padding step, gray weights
IMAGE_NORM = {"mean": (123.675, 116.28, 103.53), "std": (58.395, 57.12, 57.375), "to_rgb": True}
SIZE_DIVISOR = 32
GRAY_WEIGHTS_BGR = (0.114, 0.587, 0.299)
DEFAULT_BACKEND = "cv2"

SIZE = ("height", "width", "channels")


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("int")


def _per_pixel(count: Column, value) -> Column:
    """Array of ``value(i)`` for i below ``count``; empty for no pixels."""
    indices = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(indices, value)


def explode_pixels(images: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per pixel and channel: keys, ``c``, ``y``, ``x``, ``v``."""
    # the outer form adds no filter on the array that Catalyst would repeat below
    rows = images.select(*keys, "width", "channels", F.posexplode_outer("pixels").alias("_i", "v"))
    i, c = F.col("_i"), F.col("channels")
    return rows.where(i.isNotNull()).select(
        *keys,
        (i % c).alias("c"),
        _div(i, c * F.col("width")).alias("y"),
        (_div(i, c) % F.col("width")).alias("x"),
        "v",
    )


# -- resize -----------------------------------------------------------------


def resample_images(
    images: DataFrame,
    height: int | Column,
    width: int | Column,
    interpolation: str = "bilinear",
    backend: str | None = None,
    engine: str = "sql",
) -> DataFrame:
    """Resize every image; the new size may differ from row to row.

    ``engine='sql'`` is made of Spark expressions, ``engine='arrow'`` runs
    two matrix products per image on Arrow batches: the choice for photos.
    Results agree to rounding.
    """
    backend = backend or DEFAULT_BACKEND
    check_kernel(interpolation, backend)
    if engine not in ("sql", "arrow"):
        raise ValueError(f"engine must be 'sql' or 'arrow', not {engine!r}")
    size = [F.lit(s) if isinstance(s, int) else s for s in (height, width)]
    target = [
        F.when(s >= 1, s.cast("int")).otherwise(F.raise_error(F.lit("new size must be at least 1")))
        for s in size
    ]
    sized = images.withColumn("_h", target[0]).withColumn("_w", target[1])
    resize = _resample_sql if engine == "sql" else _resample_arrow
    return resize(sized, interpolation, backend).select(*images.columns)


def _resample_sql(images: DataFrame, interpolation: str, backend: str) -> DataFrame:
    def weighted(taps: Column, pixel) -> Column:
        return F.aggregate(taps, F.lit(0.0), lambda acc, t: acc + t["w"] * pixel(t["src"]))

    def across(pixels: Column, taps: Column, h: Column, w: Column, c: Column, new_w: Column) -> Column:
        def value(i: Column) -> Column:
            start = _div(i, new_w * c) * w
            return weighted(
                F.get(taps, _div(i, c) % new_w), lambda x: F.get(pixels, (start + x) * c + i % c)
            )

        return _per_pixel(h * new_w * c, value)

    def down(rows: Column, taps: Column, new_h: Column, line: Column) -> Column:
        def value(i: Column) -> Column:
            return weighted(F.get(taps, _div(i, line)), lambda y: F.get(rows, y * line + i % line))

        return _per_pixel(new_h * line, value)

    def resized(pixels, h, w, c, new_h, new_w) -> Column:
        shrinking = (h >= new_h) & (w >= new_w)
        rows = let_all(
            across,
            pixels=pixels, h=h, w=w, c=c, new_w=new_w,
            taps=axis_taps(w, new_w, interpolation, backend, shrinking),
        )
        taps = axis_taps(h, new_h, interpolation, backend, shrinking)
        return let_all(down, rows=rows, taps=taps, new_h=new_h, line=new_w * c)

    pixels = let_all(
        resized,
        pixels=F.col("pixels"), h=F.col("height"), w=F.col("width"), c=F.col("channels"),
        new_h=F.col("_h"), new_w=F.col("_w"),
    )
    return (
        images.withColumn("pixels", pixels)
        .withColumn("height", F.col("_h"))
        .withColumn("width", F.col("_w"))
    )


def _resample_arrow(images: DataFrame, interpolation: str, backend: str) -> DataFrame:
    names = images.columns
    at = {n: names.index(n) for n in (*SIZE, "_h", "_w", "pixels")}
    schema = T.StructType(
        [
            T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == "pixels" else f
            for f in images.schema
        ]
    )

    def resize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = {n: batch.column(at[n]).to_pylist() for n in (*SIZE, "_h", "_w")}
            column, results = batch.column(at["pixels"]), []
            for i in range(batch.num_rows):
                h, w, c, new_h, new_w = (size[n][i] for n in (*SIZE, "_h", "_w"))
                if not column[i].is_valid:
                    results.append(None)
                    continue
                image = pixel_numbers(column[i]).reshape(h, w * c)
                both = h >= new_h and w >= new_w
                rows = weight_matrix(h, new_h, interpolation, backend, both) @ image
                columns = weight_matrix(w, new_w, interpolation, backend, both)
                results.append(np.matmul(columns, rows.reshape(new_h, w, c)).ravel())
            arrays = list(batch.columns)
            arrays[at["pixels"]] = pa.array(results, pa.list_(pa.float64()))
            arrays[at["height"]], arrays[at["width"]] = arrays[at["_h"]], arrays[at["_w"]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return images.mapInArrow(resize, schema)


def pixel_numbers(pixels: pa.Scalar) -> np.ndarray:
    """Doubles from an array of doubles or from raw bytes."""
    if pa.types.is_binary(pixels.type) or pa.types.is_large_binary(pixels.type):
        return np.frombuffer(pixels.as_py(), np.uint8).astype(float)
    return pixels.values.to_numpy(zero_copy_only=False)


def saturate_pixels(images: DataFrame) -> DataFrame:
    """Round to whole numbers in 0 .. 255, as byte images hold them."""
    return images.withColumn(
        "pixels",
        F.transform("pixels", lambda v: F.least(F.greatest(F.floor(v + 0.5), F.lit(0)), F.lit(255)).cast("double")),
    )


def resize_scale_factors(images: DataFrame, height: int | Column, width: int | Column) -> DataFrame:
    """Add ``w_scale`` and ``h_scale`` of a resize; pixels are not read."""
    h, w = (F.lit(s) if isinstance(s, int) else s for s in (height, width))
    return images.withColumn("w_scale", w / F.col("width")).withColumn("h_scale", h / F.col("height"))


def image_shapes(images: DataFrame, before: Sequence[str] | None = None) -> DataFrame:
    """Add ``img_shape``, and ``ori_shape`` from the columns in ``before``."""

    def shape(names: Sequence[str]) -> Column:
        return F.struct(*[F.col(n).alias(a) for n, a in zip(names, "hwc")])

    return images.withColumn("img_shape", shape(SIZE)).withColumn(
        "ori_shape", shape(before or SIZE)
    )


def rescale_views(
    images: DataFrame,
    scale: float,
    interpolation: str = "bilinear",
    backend: str | None = None,
    engine: str = "sql",
    compat: bool = False,
) -> DataFrame:
    """Scale every view by one factor, its camera matrix and shapes too.

    New sizes are truncated. ``ori_shape`` keeps the size before scaling;
    ``compat`` makes it the new one. A ``lidar2img`` column is scaled along.
    """
    s = F.lit(float(scale))
    marked = images.withColumn("_old_h", F.col("height")).withColumn("_old_w", F.col("width"))
    size = [F.floor(F.col(n) * s).cast("int") for n in ("height", "width")]
    scaled = resample_images(marked, *size, interpolation, backend, engine)
    before = None if compat else ("_old_h", "_old_w", "channels")
    scaled = image_shapes(scaled, before).drop("_old_h", "_old_w")
    if "lidar2img" in images.columns:
        scaled = scaled.withColumn("lidar2img", rescale_camera_matrix(F.col("lidar2img"), scale))
    return scaled


# -- values and channels ----------------------------------------------------


def flip_channels(pixels: Column, channels: Column) -> Column:
    """Reverse the channel order of every pixel: BGR to RGB and back."""

    def flipped(p: Column, c: Column) -> Column:
        return F.transform(p, lambda v, i: F.get(p, i - i % c + (c - 1 - i % c)))

    return let_all(flipped, p=pixels, c=channels)


def convert_channels(images: DataFrame, flag: str = "color", channel_order: str = "bgr") -> DataFrame:
    """Channels as the reader's flags ask; colour input is BGR.

    ``color`` may be turned to RGB, ``grayscale`` makes one weighted channel,
    ``unchanged`` leaves all as it is.
    """
    if flag not in ("color", "grayscale", "unchanged"):
        raise ValueError(f"unsupported flag: {flag}")
    c = F.col("channels")
    if flag == "color" and channel_order == "rgb":
        return images.withColumn(
            "pixels", F.when(c == 3, flip_channels(F.col("pixels"), c)).otherwise(F.col("pixels"))
        )
    if flag == "grayscale":
        blue, green, red = GRAY_WEIGHTS_BGR


        def weighted(p: Column, n: Column, step: Column) -> Column:
            at = lambda i, k: F.get(p, i * step + k)
            return _per_pixel(n, lambda i: blue * at(i, 0) + green * at(i, 1) + red * at(i, 2))

        gray = let_all(weighted, p=F.col("pixels"), n=F.col("height") * F.col("width"), step=c)
        return images.withColumn(
            "pixels", F.when(c >= 3, gray).otherwise(F.col("pixels"))
        ).withColumn("channels", F.when(c >= 3, F.lit(1)).otherwise(c))
    return images


def normalize_images(
    images: DataFrame,
    mean: Sequence[float] = IMAGE_NORM["mean"],
    std: Sequence[float] = IMAGE_NORM["std"],
    to_rgb: bool = IMAGE_NORM["to_rgb"],
) -> DataFrame:
    """``(v - mean) / std`` per channel, after turning BGR to RGB if asked."""
    c = F.col("channels")
    if to_rgb:
        images = images.withColumn("pixels", flip_channels(F.col("pixels"), c))
    means, stds = (F.lit([float(x) for x in xs]) for xs in (mean, std))
    scaled = F.transform("pixels", lambda v, i: (v - means[i % c]) / stds[i % c])
    return images.withColumn("pixels", scaled)


def pad_images(images: DataFrame, size_divisor: int = SIZE_DIVISOR, fill: float = 0.0) -> DataFrame:
    """Fill up below and to the right to a multiple of ``size_divisor``."""

    def up(n: str) -> Column:
        return (F.ceil(F.col(n) / size_divisor) * size_divisor).cast("int")

    def padded(pixels, h, w, c, new_h, new_w) -> Column:
        def value(i: Column) -> Column:
            y, x = _div(i, new_w * c), _div(i, c) % new_w
            inside = (y < h) & (x < w)
            return F.when(inside, F.get(pixels, (y * w + x) * c + i % c)).otherwise(F.lit(float(fill)))

        return _per_pixel(new_h * new_w * c, value)

    pixels = let_all(
        padded,
        pixels=F.col("pixels"), h=F.col("height"), w=F.col("width"), c=F.col("channels"),
        new_h=up("height"), new_w=up("width"),
    )
    return images.withColumns({"pixels": pixels, "height": up("height"), "width": up("width")})


# -- comparison -------------------------------------------------------------


def _root_mean_square(a: str, b: str, size_a: Column, size_b: Column, keys: Sequence[str]) -> Column:
    squares = F.aggregate(
        F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, x: acc + x
    )
    same = F.coalesce(size_a == size_b, F.lit(False))
    return F.when(same, F.sqrt(squares / F.size(a))).otherwise(
        F.raise_error(
            F.concat(F.lit("images differ in size or lack a partner: "), F.concat_ws(", ", *keys))
        )
    )


def image_rmse(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Root of the mean squared difference of two images over all elements.

    An image without a partner, or of another size, fails the job. The tables
    are independent, so their images meet in a join; two ways to compute the
    same table are compared by ``compare_implementations`` without one.
    """
    keys = list(keys)
    a = left.select(*keys, F.struct(*SIZE).alias("_size_a"), F.col("pixels").alias("_a"))
    b = right.select(*keys, F.struct(*SIZE).alias("_size_b"), F.col("pixels").alias("_b"))
    both = a.join(b, keys, "full")
    return both.select(*keys, _root_mean_square("_a", "_b", F.col("_size_a"), F.col("_size_b"), keys).alias("rmse"))


def compare_implementations(
    images: DataFrame,
    implementations: dict[str, tuple],
    keys: Sequence[str] = ("image_id",),
) -> DataFrame:
    """RMSE per view between two implementations of each step.

    ``implementations`` maps a step name to two functions on the image table,
    which change its image columns and keep the others. Both run on the same
    row, one after the other, so no pixels are shuffled. Functions that lose
    columns, because they make new rows, are compared by a join instead.
    """
    whole = None
    for step, (first, second) in implementations.items():
        found = _beside(images, first, second, keys)
        found = image_rmse(first(images), second(images), keys) if found is None else found
        found = found.select(F.lit(step).alias("step"), *keys, "rmse")
        whole = found if whole is None else whole.unionByName(found)
    if whole is None:
        raise ValueError("nothing to compare")
    return whole


def _beside(images: DataFrame, first, second, keys: Sequence[str]) -> DataFrame | None:
    columns = [*SIZE, "pixels"]
    one = first(images.select(*keys, *columns, F.struct(*columns).alias("_source")))
    if "_source" not in one.columns:
        return None
    again = one.select(*keys, F.struct(*columns).alias("_one"), *[F.col(f"_source.{c}").alias(c) for c in columns])
    two = second(again)
    if "_one" not in two.columns:
        return None
    sides = two.select(
        *keys, F.struct(*[F.col(f"_one.{c}") for c in SIZE]).alias("_size_a"), F.struct(*SIZE).alias("_size_b"),
        F.col("_one.pixels").alias("_a"), F.col("pixels").alias("_b"),
    )
    return sides.select(*keys, _root_mean_square("_a", "_b", F.col("_size_a"), F.col("_size_b"), keys).alias("rmse"))
