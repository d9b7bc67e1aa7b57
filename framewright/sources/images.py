"""Image files as rows, and rows as image files."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from framewright.operators.images import convert_channels

PIXEL_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("pixels", T.ArrayType(T.DoubleType())),
    ]
)


def scan_images(
    spark: SparkSession, paths: str | list[str], flag: str = "color", channel_order: str = "bgr"
) -> DataFrame:
    """Decoded image files: ``path``, size and ``pixels`` in BGR order.

    The executors decode. A file that cannot be decoded fails the job, as a
    missing path does.
    """
    if flag not in ("color", "grayscale", "unchanged"):
        raise ValueError(f"unsupported flag: {flag}")
    raw = spark.read.format("image").option("dropInvalid", False).load(paths).select("image.*")
    path = F.when(F.col("height") > 0, F.col("origin")).otherwise(
        F.raise_error(F.concat(F.lit("image file cannot be read: "), F.col("origin")))
    )
    images = raw.select(
        path.alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data"
    )
    decoded = images.mapInArrow(_bytes_to_pixels(flag), PIXEL_SCHEMA)
    return convert_channels(decoded, flag, channel_order)


def _bytes_to_pixels(flag: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one image at a time: a photo grows eightfold when its bytes become doubles
            for i in range(batch.num_rows):
                path, height, width, channels, data = (c[i].as_py() for c in batch.columns)
                pixels = np.frombuffer(data, np.uint8).reshape(-1, channels).astype(float)
                if flag != "unchanged":
                    # colour means three channels: repeat gray, drop the opacity
                    pixels = np.repeat(pixels, 3, 1) if channels == 1 else pixels[:, :3]
                    channels = 3
                values = pa.ListArray.from_arrays(
                    pa.array([0, pixels.size], pa.int32()), pa.array(pixels.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path]),
                        *[pa.array([n], pa.int32()) for n in (height, width, channels)],
                        values,
                    ],
                    names=PIXEL_SCHEMA.fieldNames(),
                )

    return decode


# What a bitmap file begins with, and its colour types by the number of channels
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_COLOR_TYPES = {1: 0, 3: 2, 4: 6}


def encode_image(pixels: np.ndarray) -> bytes:
    """An uncompressed PNG file of bytes in rows, columns and channels: gray, BGR, or BGR with opacity."""
    height, width, channels = pixels.shape
    if channels not in PNG_COLOR_TYPES:
        raise ValueError(f"an image file cannot have {channels} channels")
    if not height or not width:
        raise ValueError("an image file cannot be empty")
    order = [0] if channels == 1 else [2, 1, 0, 3][:channels]
    lines = np.zeros((height, 1 + width * channels), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = pixels[:, :, order].reshape(height, -1)

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", width, height, 8, PNG_COLOR_TYPES[channels], 0, 0, 0)
    body = zlib.compress(lines.tobytes(), 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


class _ImageWriter(DataSourceArrowWriter):
    """Each task writes its images; a file appears whole, whatever attempt finishes first."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.folder)
        store.create_dir(root)
        for batch in iterator:
            for i in range(batch.num_rows):
                name, height, width, channels = (batch.column(c)[i].as_py() for c in ("path", "height", "width", "channels"))
                if not name or "/" in name or name[0] in "._":
                    raise ValueError(f"no name for an image file: {name!r}")
                values = batch.column("pixels")[i].values
                values = None if values is None else values.to_numpy(zero_copy_only=False)
                if None in (height, width, channels) or values is None or values.size != height * width * channels:
                    raise ValueError(f"pixels and size of image {name} differ")
                if not ((values >= 0) & (values <= 255) & (values == np.floor(values))).all():
                    raise ValueError(f"image {name} has values that are no bytes")
                part = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(encode_image(values.reshape(height, width, channels)))
                store.move(part, f"{root}/{name}.png")
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.folder)
        store.create_dir(root)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address and the folder in it."""
    store, root = fs.FileSystem.from_uri(folder)
    return store, root.rstrip("/")


class ImageFiles(DataSource):
    """A data sink that makes a file of every row."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> _ImageWriter:
        return _ImageWriter(self.options["path"])


def write_images(images: DataFrame, folder: str) -> None:
    """Write each image to ``<path>.png`` in the folder, which the cluster shares.

    ``path`` is a plain file name; ``pixels`` are whole numbers from 0 to 255,
    gray, in BGR order, or BGR with opacity. A missing or repeated name, values
    that are no bytes, or pixels that do not fit the size fail the job, which
    names the image. The executors write, and a file is moved to its name when it
    is whole, so that a task can run again. ``_SUCCESS`` marks a finished folder.
    """
    twice = images.groupBy("path").count().where("path IS NOT NULL AND count > 1").select("path").first()
    if twice is not None:
        raise ValueError(f"two images are named {twice[0]}")
    images.sparkSession.dataSource.register(ImageFiles)
    sized = images.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PIXEL_SCHEMA])
    sized.write.format(ImageFiles.name()).mode("append").save(folder)
