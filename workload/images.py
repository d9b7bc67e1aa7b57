"""Image tables: a vector of 64 numbers is an image of 8 by 8 pixels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.functions.kernels import CUBIC, KERNELS, SUPPORT
from framewright.operators import images as I, tiles as TI
from framewright.session import shared_folder
from framewright.sources.images import PIXEL_SCHEMA, scan_images, write_images
from workload.registry import query, rounded, spread_table, sql_rounded as r

SIDE = 8
NEW_H, NEW_W = 5, 11
PI = "pi()"


def gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir, 1, F.transform("embedding", lambda v: v.cast("double")))


def color_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels out of each number, at the scale of byte images."""
    channels = F.transform(
        "embedding",
        lambda v: F.array(v.cast("double") * 100 + 128, 128 - v.cast("double") * 100, v.cast("double") * 50),
    )
    return _images(spark, sf_dir, 3, F.flatten(channels))


def _images(spark, sf_dir, channels, pixels):
    return spread_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
        F.lit(channels).alias("channels"),
        pixels.alias("pixels"),
    )


def pixel_rows(images: DataFrame) -> DataFrame:
    return I.explode_pixels(images).withColumn("v", rounded(F.col("v")))


GRAY = f"""
e AS (SELECT vec_id AS image_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64))::INT AS i FROM embeddings),
px AS (SELECT image_id, 0 AS c, i // {SIDE} AS y, i % {SIDE} AS x, v FROM e)"""
COLOR = f"""
e AS (SELECT vec_id AS image_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64))::INT AS i FROM embeddings),
px AS (SELECT image_id, i // {SIDE} AS y, i % {SIDE} AS x, c,
              CASE c WHEN 0 THEN v * 100 + 128 WHEN 1 THEN 128 - v * 100 ELSE v * 50 END AS v
       FROM e CROSS JOIN (SELECT unnest(range(0, 3))::INT AS c) k)"""
OUT = f"SELECT image_id, c, y, x, {r('v')} AS v FROM"


# -- image files -------------------------------------------------------------

LINES = 50  # vectors in an image, each a line
GRAY_WEIGHTS = (0.114, 0.587, 0.299)
FILES = f"""
n AS (SELECT vec_id // {LINES} AS image_id, row_number() OVER (PARTITION BY vec_id // {LINES} ORDER BY vec_id)::INT - 1 AS y, embedding
      FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
e AS (SELECT image_id, y, unnest(range(0, 64))::INT AS x, unnest(embedding)::DOUBLE AS v FROM n),
b AS (SELECT image_id, y, x, (((floor(v * 1024)::BIGINT % 256) + 256) % 256)::DOUBLE AS p, [1, 3, 4][image_id % 3 + 1] AS n FROM e),
px AS (SELECT image_id, y, x, n, p, 255 - p AS g, (p + 128) % 256 AS r, 255 - floor(p / 2) AS a FROM b)"""


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vectors an image, one a line: gray, in three channels, or with opacity."""
    byte = F.transform("embedding", lambda v: F.pmod(F.floor(v.cast("double") * 1024), F.lit(256)).cast("double"))
    channels = lambda p: F.array(p, 255 - p, (p + 128) % 256, 255 - F.floor(p / 2).cast("double"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    lines = spread_table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND size(embedding) = 64").where(finite)
    lines = lines.select(F.floor(F.col("vec_id") / LINES).alias("image_id"), F.struct("vec_id", byte.alias("line")).alias("line"))
    whole = lines.groupBy("image_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    n = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4)), (F.col("image_id") % 3 + 1).cast("int"))
    pixels = F.transform(F.flatten(F.transform("lines", lambda line: line["line"])), lambda p: F.slice(channels(p), 1, n))
    return whole.select(
        F.concat(F.lit("lines-"), "image_id").alias("path"),
        F.size("lines").alias("height"),
        F.lit(64).alias("width"),
        n.alias("channels"),
        F.flatten(pixels).alias("pixels"),
    )


@query(
    "scan_images",
    f"""WITH {FILES},
    read AS (
        SELECT image_id, 'unchanged' AS flag, n AS channels, c, y, x, [p, g, r, a][c + 1] AS v
        FROM px CROSS JOIN (SELECT unnest(range(0, 4))::INT AS c) k WHERE c < n
        UNION ALL
        SELECT image_id, 'color', 3, c, y, x, CASE WHEN n = 1 THEN p ELSE [p, g, r][c + 1] END
        FROM px CROSS JOIN (SELECT unnest(range(0, 3))::INT AS c) k
        UNION ALL
        SELECT image_id, 'grayscale', 1, 0, y, x,
               CASE WHEN n = 1 THEN p ELSE {GRAY_WEIGHTS[0]} * p + {GRAY_WEIGHTS[1]} * g + {GRAY_WEIGHTS[2]} * r END
        FROM px)
    SELECT image_id::BIGINT AS image_id, flag, channels::INT AS channels, c, y, x, {r('v')} AS v FROM read""",
)
def q_scan_images(spark, sf_dir):
    """The images written as files, which the executors read back under each of the three flags."""
    folder = f"{shared_folder(spark)}/framewright/images-{uuid.uuid4().hex}"
    write_images(image_files(spark, sf_dir), folder)
    keys = [F.regexp_extract("path", r"lines-(\d+)\.png$", 1).cast("long").alias("image_id")]
    read = [
        scan_images(spark, folder, flag).select(*keys, F.lit(flag).alias("flag"), *PIXEL_SCHEMA.fieldNames()[1:])
        for flag in ("unchanged", "color", "grayscale")
    ]
    # explode_pixels gives the channel's number; the number of channels is a key here
    whole = read[0].unionByName(read[1]).unionByName(read[2]).withColumn("n", F.col("channels"))
    return I.explode_pixels(whole, ("image_id", "flag", "n")).select(
        "image_id", "flag", F.col("n").alias("channels"), "c", "y", "x", rounded(F.col("v")).alias("v")
    )


# -- kernel weights in SQL, written independently of the library -------------


def _sql_sinc(t):
    return f"(CASE WHEN {t} = 0 THEN 1 ELSE sin({PI} * ({t})) / ({PI} * ({t})) END)"


def _sql_cubic(t, a):
    t = f"abs({t})"
    return (
        f"(CASE WHEN {t} < 1 THEN ({a} + 2) * {t} ** 3 - ({a} + 3) * {t} ** 2 + 1"
        f" WHEN {t} < 2 THEN {a} * {t} ** 3 - 5 * {a} * {t} ** 2 + 8 * {a} * {t} - 4 * {a} ELSE 0 END)"
    )


def _sql_axis(name: str, dst: int, kernel: str, backend: str, shrinking: bool) -> str:
    """A table (dst, src, w) under ``name``."""
    scale = f"({SIDE}::DOUBLE / {dst})"
    targets = f"(SELECT unnest(range(0, {dst}))::DOUBLE AS d) t"
    sources = f"(SELECT unnest(range(0, {SIDE}))::DOUBLE AS s) u"
    if kernel == "nearest":
        shift = 0 if backend == "cv2" else 0.5
        body = f"SELECT d, least(floor((d + {shift}) * {scale}), {SIDE - 1}) AS s, 1.0::DOUBLE AS w FROM {targets}"
    elif backend == "pillow":
        widen = max(SIDE / dst, 1.0)
        reach = SUPPORT[kernel] * widen
        center = f"((d + 0.5) * {scale})"
        t = f"((s - {center} + 0.5) / {widen}::DOUBLE)"
        weight = {
            "box": f"(CASE WHEN {t} > -0.5 AND {t} <= 0.5 THEN 1 ELSE 0 END)",
            "bilinear": f"greatest(0, 1 - abs({t}))",
            "hamming": f"(CASE WHEN abs({t}) < 1 THEN {_sql_sinc(t)} * (0.54 + 0.46 * cos({PI} * {t})) ELSE 0 END)",
            "bicubic": _sql_cubic(t, CUBIC["pillow"]),
            "lanczos": f"(CASE WHEN {t} >= -3 AND {t} < 3 THEN {_sql_sinc(t)} * {_sql_sinc(t + ' / 3')} ELSE 0 END)",
        }[kernel]
        body = (
            f"SELECT d, s, {weight} AS w FROM {targets} CROSS JOIN {sources}"
            f" WHERE s >= trunc(greatest(0, {center} - {reach} + 0.5))"
            f" AND s < least({SIDE}, trunc({center} + {reach} + 0.5))"
        )
    elif kernel == "area" and shrinking:
        body = (
            f"SELECT d, s, least((d + 1) * {scale}, s + 1) - greatest(d * {scale}, s) AS w"
            f" FROM {targets} CROSS JOIN {sources}"
            f" WHERE least((d + 1) * {scale}, s + 1) - greatest(d * {scale}, s) > 0.001"
        )
    else:
        taps = {"bilinear": (0, 1), "area": (0, 1), "bicubic": range(-1, 3), "lanczos": range(-3, 5)}[kernel]
        at = f"((d + 0.5) * {scale} - 0.5)"
        if kernel == "bilinear":
            at = f"greatest(0, {at})"
        if kernel == "area":
            f = f"greatest(0, d + 1 - (floor(d * {scale}) + 1) / {scale})"
            start, fraction = f"floor(d * {scale})", f"({f} - floor({f}))"
        else:
            start, fraction = f"floor({at})", f"({at} - floor({at}))"
        t = f"({fraction} - k)"
        weight = {
            "bilinear": f"1 - abs({t})",
            "area": f"1 - abs({t})",
            "bicubic": _sql_cubic(t, CUBIC["cv2"]),
            "lanczos": f"{_sql_sinc(t)} * {_sql_sinc(t + ' / 4')}",
        }[kernel]
        body = (
            f"SELECT d, least(greatest({start} + k, 0), {SIDE - 1}) AS s, {weight} AS w FROM {targets}"
            f" CROSS JOIN (SELECT unnest([{', '.join(map(str, taps))}]) AS k) n"
        )
    return (
        f"{name} AS (SELECT d::INT AS dst, s::INT AS src, w / sum(w) OVER (PARTITION BY d) AS w"
        f" FROM ({body}) b)"
    )


def _sql_resampled(pixels: str, kernel: str, backend: str, h: int, w: int, tag: str = "") -> str:
    """CTEs that end in ``out``: the resampled pixels."""
    both = h <= SIDE and w <= SIDE
    return f"""{pixels},
    {_sql_axis('kx' + tag, w, kernel, backend, both)},
    {_sql_axis('ky' + tag, h, kernel, backend, both)},
    hx{tag} AS (SELECT image_id, c, y, k.dst AS x, sum(v * k.w) AS v
                FROM px JOIN kx{tag} k ON k.src = px.x GROUP BY image_id, c, y, k.dst),
    out{tag} AS (SELECT image_id, c, k.dst AS y, x, sum(v * k.w) AS v
                 FROM hx{tag} h JOIN ky{tag} k ON k.src = h.y GROUP BY image_id, c, k.dst, x)"""


def _register_resample(name: str, kernel: str, backend: str, h: int, w: int, engine: str) -> None:
    sql = f"WITH {_sql_resampled(GRAY, kernel, backend, h, w)} {OUT} out"

    @query(name, sql)
    def run(spark, sf_dir):
        images = gray_images(spark, sf_dir)
        return pixel_rows(I.resample_images(images, h, w, kernel, backend, engine))


for _backend, _kernels in KERNELS.items():
    for _kernel in _kernels:
        _register_resample(f"resample_{_backend}_{_kernel}", _kernel, _backend, NEW_H, NEW_W, "sql")
_register_resample("resample_cv2_area_shrink", "area", "cv2", 5, 6, "sql")
_register_resample("resample_arrow_bilinear", "bilinear", "cv2", NEW_H, NEW_W, "arrow")
_register_resample("resample_arrow_lanczos", "lanczos", "pillow", NEW_H, NEW_W, "arrow")
for _backend, _kernels in KERNELS.items():
    for _kernel in _kernels:
        if (_backend, _kernel) not in (("cv2", "bilinear"), ("pillow", "lanczos")):  # the two above
            _register_resample(f"resample_arrow_{_backend}_{_kernel}", _kernel, _backend, NEW_H, NEW_W, "arrow")
_register_resample("resample_arrow_cv2_area_shrink", "area", "cv2", 5, 6, "arrow")


def _register_tiles(name: str, kernel: str, backend: str, h: int, w: int) -> None:
    @query(name, f"WITH {_sql_resampled(GRAY, kernel, backend, h, w)} {OUT} out")
    def run(spark, sf_dir):
        """Images cut into tiles of 4 by 4 pixels, so that every kernel reaches over their edges."""
        tiles = TI.resample_tiles(TI.cut_tiles(gray_images(spark, sf_dir), 4), h, w, kernel, backend, tile=4)
        return TI.tile_pixels(tiles).withColumn("v", rounded(F.col("v")))


for _backend, _kernels in KERNELS.items():
    for _kernel in _kernels:
        _register_tiles(f"resample_tiles_{_backend}_{_kernel}", _kernel, _backend, NEW_H, NEW_W)
_register_tiles("resample_tiles_cv2_area_shrink", "area", "cv2", 5, 6)


@query(
    "resize_scale_factors",
    f"SELECT vec_id AS image_id, {r(f'{NEW_W} / 8.0::DOUBLE')} AS w_scale, {r(f'{NEW_H} / 8.0::DOUBLE')} AS h_scale"
    " FROM embeddings",
)
def q_resize_scale_factors(spark, sf_dir):
    factors = I.resize_scale_factors(gray_images(spark, sf_dir), NEW_H, NEW_W)
    return factors.select("image_id", rounded(F.col("w_scale")).alias("w_scale"), rounded(F.col("h_scale")).alias("h_scale"))


@query("rescale_views", f"WITH {_sql_resampled(COLOR, 'bilinear', 'cv2', 4, 4)} {OUT} out")
def q_rescale_views(spark, sf_dir):
    return pixel_rows(I.rescale_views(color_images(spark, sf_dir), 0.5))


@query(
    "image_shapes",
    "SELECT vec_id AS image_id, 5 AS img_h, 5 AS img_w, 3 AS img_c, 8 AS ori_h, 8 AS ori_w FROM embeddings",
)
def q_image_shapes(spark, sf_dir):
    shaped = I.rescale_views(color_images(spark, sf_dir), 0.7)
    return shaped.select(
        "image_id",
        F.col("img_shape.h").alias("img_h"), F.col("img_shape.w").alias("img_w"),
        F.col("img_shape.c").alias("img_c"),
        F.col("ori_shape.h").alias("ori_h"), F.col("ori_shape.w").alias("ori_w"),
    )


NORMALIZED = """
nm AS (SELECT image_id, 2 - c AS c, y, x,
              CASE c WHEN 2 THEN (v - 123.675::DOUBLE) / 58.395::DOUBLE
                     WHEN 1 THEN (v - 116.28::DOUBLE) / 57.12::DOUBLE
                     ELSE (v - 103.53::DOUBLE) / 57.375::DOUBLE END AS v FROM px)"""


@query("normalize_images", f"WITH {COLOR}, {NORMALIZED} {OUT} nm")
def q_normalize_images(spark, sf_dir):
    return pixel_rows(I.normalize_images(color_images(spark, sf_dir)))


@query("convert_channels", f"WITH {COLOR} SELECT image_id, 2 - c AS c, y, x, {r('v')} AS v FROM px")
def q_convert_channels(spark, sf_dir):
    return pixel_rows(I.convert_channels(color_images(spark, sf_dir), "color", "rgb"))


@query(
    "convert_grayscale",
    f"""WITH {COLOR}, g AS (SELECT image_id, 0 AS c, y, x,
        sum(v * CASE c WHEN 0 THEN 0.114::DOUBLE WHEN 1 THEN 0.587::DOUBLE ELSE 0.299::DOUBLE END) AS v
        FROM px GROUP BY image_id, y, x) {OUT} g""",
)
def q_convert_grayscale(spark, sf_dir):
    return pixel_rows(I.convert_channels(color_images(spark, sf_dir), "grayscale"))


@query(
    "saturate_pixels",
    f"WITH {COLOR} SELECT image_id, c, y, x, least(255, greatest(0, floor(v + 0.5)))::DOUBLE AS v FROM px",
)
def q_saturate_pixels(spark, sf_dir):
    return pixel_rows(I.saturate_pixels(color_images(spark, sf_dir)))


@query(
    "pad_images",
    f"""WITH {COLOR}, s AS (SELECT unnest(range(0, 12))::INT AS p),
    grid AS (SELECT vec_id AS image_id, c, a.p AS y, b.p AS x FROM embeddings
             CROSS JOIN s a CROSS JOIN s b CROSS JOIN (SELECT unnest(range(0, 3))::INT AS c) k),
    padded AS (SELECT g.image_id, g.c, g.y, g.x, coalesce(v, 0) AS v FROM grid g
               LEFT JOIN px USING (image_id, c, y, x)) {OUT} padded""",
)
def q_pad_images(spark, sf_dir):
    return pixel_rows(I.pad_images(color_images(spark, sf_dir), size_divisor=6))


@query(
    "image_rmse",
    f"WITH {COLOR}, {NORMALIZED} SELECT image_id, {r('sqrt(avg((px.v - nm.v) * (px.v - nm.v)))')} AS rmse"
    " FROM px JOIN nm USING (image_id, c, y, x) GROUP BY image_id",
)
def q_image_rmse(spark, sf_dir):
    images = color_images(spark, sf_dir)
    return I.image_rmse(images, I.normalize_images(images)).withColumn("rmse", rounded(F.col("rmse")))


@query(
    "compare_implementations",
    f"""WITH {_sql_resampled(GRAY, 'bilinear', 'cv2', 5, 5, '1')},
    {_sql_resampled('', 'bilinear', 'pillow', 5, 5, '2').strip().lstrip(',')}
    SELECT 'resize' AS step, image_id, {r('sqrt(avg((a.v - b.v) * (a.v - b.v)))')} AS rmse
    FROM out1 a JOIN out2 b USING (image_id, c, y, x) GROUP BY image_id
    UNION ALL SELECT 'engine', vec_id, 0.0 FROM embeddings""",
)
def q_compare_implementations(spark, sf_dir):
    def resize(backend, engine="sql"):
        return lambda images: I.resample_images(images, 5, 5, "bilinear", backend, engine)

    compared = I.compare_implementations(
        gray_images(spark, sf_dir),
        {
            "resize": (resize("cv2"), resize("pillow")),
            "engine": (resize("cv2"), resize("cv2", "arrow")),
        },
    )
    return compared.withColumn("rmse", rounded(F.col("rmse")))
