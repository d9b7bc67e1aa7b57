"""Object filters and declared stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import objects as O
from framewright.plans.stages import run_stages
from workload.images import COLOR, NORMALIZED, OUT, SIDE, _sql_axis, color_images, pixel_rows
from workload.registry import query, spread_table, table

CLASSES = ["click", "purchase", "view"]
OBJECTS = """
o AS (SELECT vec_id, embedding[1]::DOUBLE * 200 AS x, embedding[2]::DOUBLE * 200 AS y, label FROM embeddings)"""


def _objects(spark, sf_dir):
    e = F.col("embedding")
    return spread_table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (e[0].cast("double") * 200).alias("x"),
        (e[1].cast("double") * 200).alias("y"),
        "label",
    )


@query(
    "object_range_filter",
    f"WITH {OBJECTS} SELECT vec_id FROM o WHERE x > -51.2 AND x < 51.2 AND y > -51.2 AND y < 51.2",
)
def q_object_range_filter(spark, sf_dir):
    return O.object_range_filter(_objects(spark, sf_dir)).select("vec_id")


@query(
    "object_range_filter_arrays",
    """WITH o AS (SELECT vec_id, unnest(range(0, 32)) AS i, embedding FROM embeddings),
    p AS (SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE * 200 AS x, embedding[2 * i + 2]::DOUBLE * 200 AS y FROM o)
    SELECT vec_id, count(*) FILTER (x > -51.2 AND x < 51.2 AND y > -51.2 AND y < 51.2) AS n_objects,
           coalesce(sum(i) FILTER (x > -51.2 AND x < 51.2 AND y > -51.2 AND y < 51.2), 0)::BIGINT AS label_sum
    FROM p GROUP BY vec_id""",
)
def q_object_range_filter_arrays(spark, sf_dir):
    e = F.col("embedding")
    index = F.sequence(F.lit(0), F.lit(31))
    samples = spread_table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform(
            index, lambda i: F.array(*[F.get(e, i * 2 + k).cast("double") * 200 for k in (0, 1)])
        ).alias("gt_bboxes_3d"),
        index.alias("gt_labels_3d"),
    )
    kept = O.object_range_filter(samples)
    return kept.select(
        "vec_id",
        F.size("gt_bboxes_3d").cast("bigint").alias("n_objects"),
        F.aggregate("gt_labels_3d", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("label_sum"),
    )


@query(
    "object_name_filter",
    "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase', 'view')",
)
def q_object_name_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return O.object_name_filter(events, CLASSES, names="event_type")


@query("collect_columns", "SELECT event_id, value FROM events")
def q_collect_columns(spark, sf_dir):
    return O.collect_columns(table(spark, sf_dir, "events"), ["event_id", "value"])


@query(
    "run_stages",
    f"""WITH {COLOR}, {NORMALIZED},
    {_sql_axis('kx', SIDE // 2, 'bilinear', 'cv2', True)},
    half AS (SELECT image_id, c, ky.dst AS y, kx.dst AS x, sum(nm.v * kx.w * ky.w) AS v FROM nm
             JOIN kx ON kx.src = nm.x JOIN kx ky ON ky.src = nm.y GROUP BY image_id, c, ky.dst, kx.dst),
    s AS (SELECT unnest(range(0, 6))::INT AS p),
    grid AS (SELECT vec_id AS image_id, c, a.p AS y, b.p AS x FROM embeddings
             CROSS JOIN s a CROSS JOIN s b CROSS JOIN (SELECT unnest(range(0, 3))::INT AS c) k),
    padded AS (SELECT image_id, c, y, x, coalesce(v, 0) AS v FROM grid LEFT JOIN half USING (image_id, c, y, x))
    {OUT} padded""",
)
def q_run_stages(spark, sf_dir):
    stages = [
        {"type": "Rename"},
        {"type": "NormalizeMultiviewImage"},
        {
            "type": "MultiScaleFlipAug3D",
            "transforms": [
                {"type": "RandomScaleImageMultiViewImage", "scales": [0.5]},
                {"type": "PadMultiViewImage", "size_divisor": 6},
            ],
        },
        {"type": "CustomCollect3D", "keys": ["image_id", "height", "width", "channels", "pixels"]},
    ]
    raw = color_images(spark, sf_dir).withColumnRenamed("image_id", "id")
    own = {"Rename": lambda df: df.withColumnRenamed("id", "image_id")}
    return pixel_rows(run_stages(raw, stages, registry=own))
