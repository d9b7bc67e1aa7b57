"""Large images as tiles: cut, resample and join them.

One row per tile: key columns, ``height``, ``width`` and ``channels`` of the
whole image, ``top``, ``left``, ``tile_height``, ``tile_width``, and the
tile's ``pixels``. No task holds a whole image: resampling is a sum over source
pixels, so each source tile makes its share of every target tile that its
pixels reach, and only shares of the same target tile meet.

The tiles of an image cover it once. A missing or repeated tile fails the job;
a tile with null pixels makes those target tiles null that it reaches; an image
without pixels has no tiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from framewright.functions.binding import let
from framewright.functions.kernels import SUPPORT, check_kernel, weight_band
from framewright.operators.images import DEFAULT_BACKEND, SIZE, pixel_numbers

TILE = 512
PLACE = ("top", "left", "tile_height", "tile_width")
_BATCH_NUMBERS = 1 << 21  # numbers in one batch of shares


def cut_tiles(images: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of every image; its other columns go to each of them."""

    def starts(size: str) -> Column:
        n = F.col(size)
        return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(tile))).otherwise(F.array().cast("array<int>"))

    others = [F.col(f"`{c}`") for c in images.columns if c != "pixels"]
    line = F.col("width") * F.col("channels")
    bands = images.select(*others, "pixels", F.explode(starts("height")).alias("top"))
    bands = bands.withColumn("tile_height", F.least(F.lit(tile), F.col("height") - F.col("top")))
    # a band of lines is cut from the image once, whatever the number of its tiles
    bands = bands.withColumn("pixels", F.slice("pixels", F.col("top") * line + 1, F.col("tile_height") * line))
    tiles = bands.select("*", F.explode(starts("width")).alias("left"))
    tiles = tiles.withColumn("tile_width", F.least(F.lit(tile), F.col("width") - F.col("left")))
    lines = F.sequence(F.lit(0), F.col("tile_height") - 1)
    own = let(
        F.col("pixels"),
        lambda p: F.flatten(
            F.transform(lines, lambda y: F.slice(p, y * line + F.col("left") * F.col("channels") + 1, F.col("tile_width") * F.col("channels")))
        ),
    )
    return tiles.select(*others, *PLACE, own.alias("pixels"))


def tile_pixels(tiles: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per pixel and channel at its place in the whole image: keys, ``c``, ``y``, ``x``, ``v``."""
    rows = tiles.select(*keys, "channels", *PLACE, F.posexplode_outer("pixels").alias("_i", "v"))
    i, c, w = F.col("_i"), F.col("channels"), F.col("tile_width")
    return rows.where(i.isNotNull()).select(
        *keys,
        (i % c).alias("c"),
        (F.col("top") + F.floor(i / (c * w))).cast("int").alias("y"),
        (F.col("left") + F.floor(i / c) % w).cast("int").alias("x"),
        "v",
    )


def join_tiles(tiles: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Whole images of their tiles, for those that a task can hold."""
    return _assembled(tiles.select(*keys, *SIZE, F.struct(*PLACE, "pixels").alias("_part")), keys)


def resample_tiles(
    tiles: DataFrame,
    height: int | Column,
    width: int | Column,
    interpolation: str = "bilinear",
    backend: str | None = None,
    keys: Sequence[str] = ("image_id",),
    tile: int = TILE,
) -> DataFrame:
    """Resize tiled images into tiles: keys, sizes, places and pixels.

    The new size must be the same for all tiles of an image. The result equals
    that of the whole image to rounding. A target tile's side is ``tile``, or
    less where the image shrinks, so that its source is no larger than a few
    tiles; shares are summed in the order of their source.
    """
    backend = backend or DEFAULT_BACKEND
    check_kernel(interpolation, backend)
    keys = list(keys)
    size = [F.lit(s) if isinstance(s, int) else s for s in (height, width)]
    size = [F.when(s >= 1, s.cast("int")).otherwise(F.raise_error(F.lit("new size must be at least 1"))) for s in size]
    source = tiles.select(*keys, *SIZE, *PLACE, size[0].alias("_h"), size[1].alias("_w"), "pixels")
    n = len(keys)
    whole, ints = T.IntegerType(), pa.int32()
    part = "struct<order:bigint,covered:bigint,wanted:bigint,top:int,left:int,tile_height:int,tile_width:int,pixels:array<double>>"
    schema = T.StructType([source.schema[k] for k in keys] + [T.StructField(c, whole) for c in SIZE] + [T.StructField("_part", T.DataType.fromDDL(part))])
    part_type = pa.struct(
        [(c, pa.int64()) for c in ("order", "covered", "wanted")] + [(c, ints) for c in PLACE] + [("pixels", pa.list_(pa.float64()))]
    )

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column(k).to_pylist() for k in range(n, n + 9)]
            rows, sizes, parts, held = [], [], [], 0

            def flush() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                arrays = [batch.column(k).take(at) for k in range(n)]
                arrays += [pa.array([s[k] for s in sizes], ints) for k in range(3)] + [pa.array(parts, part_type)]
                return pa.RecordBatch.from_arrays(arrays, names=schema.names)

            for i, (h, w, c, top, left, th, tw, new_h, new_w) in enumerate(zip(*numbers)):
                pixels = batch.column(n + 9)[i]
                block = pixel_numbers(pixels).reshape(th, tw * c) if pixels.is_valid else None
                both = h >= new_h and w >= new_w
                for y in _reached(h, new_h, top, th, interpolation, backend, both, tile):
                    lines = None if block is None else y.weights @ block[y.inside]
                    for x in _reached(w, new_w, left, tw, interpolation, backend, both, tile):
                        share = None
                        if block is not None:
                            share = np.matmul(x.weights, lines.reshape(y.size, tw, c)[:, x.inside]).ravel()
                        rows.append(i), sizes.append((new_h, new_w, c))
                        parts.append((top * w + left, y.covered * x.covered, y.wanted * x.wanted, y.first, x.first, y.size, x.size, share))
                        held += y.size * x.size * c
                        if held > _BATCH_NUMBERS:
                            yield flush()
                            rows, sizes, parts, held = [], [], [], 0
            yield flush()

    return _summed(source.mapInArrow(shares, schema), keys)


class _Reached:
    """Targets ``first`` .. ``first + size`` of one axis, and the weights of the source pixels of one tile for them."""

    def __init__(self, src, dst, first, size, start, stop, lo, hi, *kernel) -> None:
        self.first, self.size, self.wanted = first, size, hi - lo
        from_, to = max(lo, start), min(hi, stop)
        self.covered, self.inside = to - from_, slice(from_ - start, to - start)
        self.weights = weight_band(src, dst, first, first + size, lo, hi, *kernel)[:, from_ - lo : to - lo]


@lru_cache(maxsize=64)
def _reached(src: int, dst: int, start: int, length: int, interpolation: str, backend: str, both: bool, tile: int) -> list[_Reached]:
    """The target tiles of one axis that the source pixels from ``start`` on reach."""
    scale = src / dst
    side = max(1, min(tile, int(tile / scale)))
    half = SUPPORT[interpolation] * max(scale, 1.0) if backend == "pillow" and interpolation != "nearest" else 4.0
    reach, stop = half + scale + 2, start + length
    nearest = max(0, floor((start - reach) / scale - 1)) // side
    found = []
    for first in range(nearest * side, min(dst, ceil((stop + reach) / scale + 1)), side):
        size = min(side, dst - first)
        lo = max(0, floor((first + 0.5) * scale - reach))
        hi = min(src, ceil((first + size - 0.5) * scale + reach))
        if lo < stop and start < hi:
            found.append(_Reached(src, dst, first, size, start, stop, lo, hi, interpolation, backend, both))
    return found


def _summed(shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    place = [F.col(f"_part.{c}").alias(f"_{c}") for c in PLACE]
    met = shares.select("*", *place).groupBy(*keys, *SIZE, *[f"_{c}" for c in PLACE]).agg(F.collect_list("_part").alias("_parts"))
    met = met.select(*keys, *SIZE, *[F.col(f"_{c}").alias(c) for c in PLACE], F.sort_array("_parts").alias("_parts"))
    covered = F.aggregate("_parts", F.lit(0).cast("bigint"), lambda n, p: n + p["covered"])
    whole = covered == F.col("_parts")[0]["wanted"]
    checked = F.when(whole, F.col("_parts.pixels")).otherwise(
        F.raise_error(F.concat(F.lit("missing or repeated tiles: "), F.concat_ws(", ", *keys)))
    )
    total = F.reduce(
        F.slice(checked, 2, F.size("_parts")), checked[0], lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b)
    )
    return met.select(*keys, *SIZE, *PLACE, total.alias("pixels"))


def _assembled(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    met = parts.groupBy(*keys, *SIZE).agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    n = len(list(keys))
    schema = T.StructType([met.schema[k] for k in (*keys, *SIZE)] + [T.StructField("pixels", T.ArrayType(T.DoubleType()))])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                h, w, c = (batch.column(n + k)[i].as_py() for k in range(3))
                image, area, known = np.empty((h, w, c)), 0, True
                for part in batch.column(n + 3)[i]:
                    top, left, th, tw = (part[p].as_py() for p in PLACE)
                    area += th * tw
                    if part["pixels"].is_valid:
                        image[top : top + th, left : left + tw] = pixel_numbers(part["pixels"]).reshape(th, tw, c)
                    else:
                        known = False
                if area != h * w:
                    raise ValueError(f"missing or repeated tiles: {[batch.column(k)[i].as_py() for k in range(n)]}")
                out.append(image.ravel() if known else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 3], pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    return met.mapInArrow(assemble, schema)
