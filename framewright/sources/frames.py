"""Frame records from JSON files, numbered by their position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from framewright.operators.indexing import dense_index
from framewright.sources.json_list import read_json_lists

_VECTOR = T.ArrayType(T.DoubleType())
_MATRIX = T.ArrayType(_VECTOR)

CAMERA_SCHEMA = T.StructType(
    [
        T.StructField("data_path", T.StringType()),
        T.StructField("sensor2lidar_rotation", _MATRIX),
        T.StructField("sensor2lidar_translation", _VECTOR),
        T.StructField("cam_intrinsic", _MATRIX),
    ]
)
FRAME_SCHEMA = T.StructType(
    [
        T.StructField("token", T.StringType()),
        T.StructField("lidar_path", T.StringType()),
        T.StructField("prev", T.StringType()),
        T.StructField("next", T.StringType()),
        T.StructField("scene_token", T.StringType()),
        T.StructField("frame_idx", T.IntegerType()),
        T.StructField("timestamp", T.LongType()),
        # passed through and never looked into, so any shape is kept as text
        T.StructField("sweeps", T.ArrayType(T.StringType())),
        T.StructField("ego2global_translation", _VECTOR),
        T.StructField("ego2global_rotation", _VECTOR),
        T.StructField("can_bus", _VECTOR),
        T.StructField("cams", T.MapType(T.StringType(), CAMERA_SCHEMA)),
    ]
)


def scan_frame_infos(
    spark: SparkSession,
    paths: str | list[str],
    lines: bool = False,
    schema: T.StructType = FRAME_SCHEMA,
    partitions: int | None = None,
) -> DataFrame:
    """Frame records with ``frame_no``, their position over all files.

    A file holds one JSON list, or one record per line (``lines``); both are
    read by byte ranges. Files count in the order of their paths, records in
    the order of the file; the row id only has to rise within a split.
    """
    if not lines:
        return read_json_lists(spark, paths, schema, "frame_no")
    records = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    placed = records.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    numbered = dense_index(placed, ["_file", "_block", "_id"], partitions=partitions)
    return numbered.select("frame_no", *schema.fieldNames())
