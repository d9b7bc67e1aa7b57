"""Frame records: events as frames, vectors as camera calibrations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.functions import geometry as G
from framewright.operators import frames as R
from framewright.operators.indexing import dense_index
from framewright.plans import samples as S
from framewright.session import shared_folder
from framewright.sources.frames import scan_frame_infos
from framewright.sources.json_list import write_json_lists
from workload.registry import query, rounded, spread_table, sql_rounded as r, table

CAMERAS = ["FRONT", "BACK"]
# the column has no time zone, and the result does not depend on the session's
EPOCH_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


# -- vectors as calibrations ------------------------------------------------


def _slots(first: int, rows: int, cols: int, eye: float = 0.0):
    """Consecutive vector elements as a matrix, plus a multiple of identity."""
    e = F.col("embedding")
    return F.array(
        *[
            F.array(
                *[
                    e[first + i * cols + j].cast("double") + F.lit(eye if i == j else 0.0)
                    for j in range(cols)
                ]
            )
            for i in range(rows)
        ]
    )


def _camera(name: str, first: int, cols: int):
    e = F.col("embedding")
    return F.struct(
        F.concat(F.lit(f"{name}/"), F.col("vec_id"), F.lit(".jpg")).alias("data_path"),
        _slots(first, 3, 3, 1.0).alias("sensor2lidar_rotation"),
        F.array(*[e[first + 9 + i].cast("double") for i in range(3)]).alias("sensor2lidar_translation"),
        _slots(first + 12, 3, cols).alias("cam_intrinsic"),
    )


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cameras per vector: a 3×3 and a 3×4 intrinsic, wide cells padded."""
    vectors = spread_table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.col("vec_id").alias("frame_no"),
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in reversed(CAMERAS)]),
            F.array(_camera("BACK", 24, 4), _camera("FRONT", 0, 3)),
        ).alias("cams"),
    )


def camera_rows(spark, sf_dir):
    return R.explode_cameras(vector_frames(spark, sf_dir), CAMERAS)


def _elements(rows: DataFrame, matrix, name: str) -> DataFrame:
    return (
        rows.select("frame_no", "cam_idx", F.posexplode_outer(matrix).alias("i", "_row"))
        .select("frame_no", "cam_idx", "i", F.posexplode_outer("_row").alias("j", "_v"))
        .select("frame_no", "cam_idx", "i", "j", rounded(F.col("_v")).alias(name))
    )


def _sql_calibration() -> str:
    """Elements r, t, k of both cameras as plain columns."""
    parts = []
    for idx, (name, first, cols) in enumerate((("FRONT", 0, 3), ("BACK", 24, 4))):
        cells = [
            f"embedding[{first + 3 * i + j + 1}]::DOUBLE + {1 if i == j else 0} AS r{i}{j}"
            for i in range(3)
            for j in range(3)
        ]
        cells += [f"embedding[{first + 10 + i}]::DOUBLE AS t{i}" for i in range(3)]
        for i in range(4):
            for j in range(4):
                if i < 3 and j < cols:
                    cells.append(f"embedding[{first + 13 + cols * i + j}]::DOUBLE AS k{i}{j}")
                else:
                    cells.append(f"{1.0 if i == j else 0.0}::DOUBLE AS k{i}{j}")
        parts.append(
            f"SELECT vec_id AS frame_no, {idx} AS cam_idx, '{name}' AS cam_type,"
            f" '{name}/' || vec_id || '.jpg' AS data_path, {', '.join(cells)} FROM embeddings"
        )
    return "cal AS (" + " UNION ALL ".join(parts) + ")"


def _sql_matrices() -> str:
    def minor(i, j):
        a, b, c, d = (i + 1) % 3, (i + 2) % 3, (j + 1) % 3, (j + 2) % 3
        return f"(r{a}{c} * r{b}{d} - r{a}{d} * r{b}{c})"

    det = " + ".join(f"r0{j} * {minor(0, j)}" for j in range(3))
    inv = [f"{minor(j, i)} / det AS v{i}{j}" for i in range(3) for j in range(3)]
    cam = [f"v{i}{j} AS c{i}{j}" for i in range(3) for j in range(3)]
    cam += [f"-(v{i}0 * t0 + v{i}1 * t1 + v{i}2 * t2) AS c{i}3" for i in range(3)]
    cam += [f"{x}::DOUBLE AS c3{j}" for j, x in enumerate((0, 0, 0, 1))]
    img = [
        " + ".join(f"k{i}{k} * c{k}{j}" for k in range(4)) + f" AS p{i}{j}"
        for i in range(4)
        for j in range(4)
    ]
    return (
        _sql_calibration()
        + f", d AS (SELECT *, {det} AS det FROM cal), v AS (SELECT *, {', '.join(inv)} FROM d)"
        + f", c AS (SELECT *, {', '.join(cam)} FROM v), m AS (SELECT *, {', '.join(img)} FROM c)"
    )


def _sql_elements(source: str, letter: str, rows: int, cols: int, name: str, value="{}") -> str:
    return " UNION ALL ".join(
        f"SELECT frame_no, cam_idx, {i} AS i, {j} AS j,"
        f" {r(value.format(f'{letter}{i}{j}', i=i))} AS {name} FROM {source}"
        for i in range(rows)
        for j in range(cols)
    )


@query(
    "explode_cameras",
    f"WITH {_sql_calibration()} SELECT frame_no, cam_idx, cam_type, data_path FROM cal",
)
def q_explode_cameras(spark, sf_dir):
    return camera_rows(spark, sf_dir).select("frame_no", "cam_idx", "cam_type", "data_path")


@query(
    "inverse_rotation", f"WITH {_sql_matrices()} " + _sql_elements("v", "v", 3, 3, "inverse")
)
def q_inverse_rotation(spark, sf_dir):
    rows = camera_rows(spark, sf_dir)
    return _elements(rows, G.inverse_rotation(F.col("sensor2lidar_rotation")), "inverse")


@query(
    "lidar_to_camera", f"WITH {_sql_matrices()} " + _sql_elements("c", "c", 4, 4, "lidar2cam")
)
def q_lidar_to_camera(spark, sf_dir):
    return _elements(R.camera_matrices(camera_rows(spark, sf_dir)), F.col("lidar2cam"), "lidar2cam")


@query(
    "pad_intrinsic", f"WITH {_sql_calibration()} " + _sql_elements("cal", "k", 4, 4, "intrinsic")
)
def q_pad_intrinsic(spark, sf_dir):
    rows = camera_rows(spark, sf_dir)
    return _elements(rows, G.pad_intrinsic(F.col("cam_intrinsic")), "intrinsic")


@query(
    "lidar_to_image", f"WITH {_sql_matrices()} " + _sql_elements("m", "p", 4, 4, "lidar2img")
)
def q_lidar_to_image(spark, sf_dir):
    return _elements(R.camera_matrices(camera_rows(spark, sf_dir)), F.col("lidar2img"), "lidar2img")


@query(
    "rescale_camera_matrices",
    f"WITH {_sql_matrices()} "
    + _sql_elements("m", "p", 4, 4, "lidar2img", "(CASE WHEN {i} < 2 THEN {} * 0.5 ELSE {} END)".replace("{}", "{0}")),
)
def q_rescale_camera_matrices(spark, sf_dir):
    rows = R.camera_matrices(camera_rows(spark, sf_dir))
    return _elements(rows, G.rescale_camera_matrix(F.col("lidar2img"), 0.5), "lidar2img")


@query(
    "collect_cameras",
    f"WITH {_sql_matrices()} "
    f"SELECT frame_no, cam_idx, data_path AS img_filename, {r('p03')} AS image_shift_x,"
    f" {r('c23')} AS camera_shift_z, {r('k11')} AS focal_y FROM m",
)
def q_collect_cameras(spark, sf_dir):
    frames = R.collect_cameras(vector_frames(spark, sf_dir), CAMERAS)
    views = F.arrays_zip("img_filename", "lidar2img", "cam_intrinsic", "lidar2cam")
    return frames.select("frame_no", F.posexplode(views).alias("cam_idx", "v")).select(
        "frame_no",
        "cam_idx",
        F.col("v.img_filename").alias("img_filename"),
        rounded(F.col("v.lidar2img")[0][3]).alias("image_shift_x"),
        rounded(F.col("v.lidar2cam")[2][3]).alias("camera_shift_z"),
        rounded(F.col("v.cam_intrinsic")[1][1]).alias("focal_y"),
    )


@query(
    "regroup_cameras",
    f"WITH {_sql_calibration()} SELECT frame_no, string_agg(data_path, ',' ORDER BY cam_idx) AS paths"
    " FROM cal GROUP BY frame_no",
)
def q_regroup_cameras(spark, sf_dir):
    grouped = R.regroup_cameras(camera_rows(spark, sf_dir), "frame_no", ["data_path"])
    return grouped.select("frame_no", F.array_join("data_path", ",").alias("paths"))


@query("camera_modality", "SELECT vec_id AS frame_no FROM embeddings")
def q_camera_modality(spark, sf_dir):
    return R.camera_modality(vector_frames(spark, sf_dir), CAMERAS, use_camera=False)


def _pose_vectors(spark, sf_dir):
    e = F.col("embedding")
    double = lambda i: e[i].cast("double")
    return spread_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame_no"),
        F.transform(e, lambda x: x.cast("double")).alias("can_bus"),
        F.array(*[double(i) for i in range(3)]).alias("ego2global_translation"),
        F.array(*[double(i) for i in range(3, 7)]).alias("ego2global_rotation"),
    )


POSE = """
q AS (SELECT vec_id, embedding AS e, e[4]::DOUBLE AS w, e[5]::DOUBLE AS x, e[6]::DOUBLE AS y,
             e[7]::DOUBLE AS z FROM embeddings),
y AS (SELECT *, degrees(atan2(2 * (w * z + x * y), w * w + x * x - y * y - z * z)) AS yaw FROM q),
a AS (SELECT *, CASE WHEN yaw < 0 THEN yaw + 360 ELSE yaw END AS heading FROM y)"""


@query(
    "quaternion_heading",
    f"WITH {POSE} SELECT vec_id AS frame_no, {r('heading')} AS heading FROM a",
)
def q_quaternion_heading(spark, sf_dir):
    heading = G.quaternion_heading(F.col("ego2global_rotation"))
    return _pose_vectors(spark, sf_dir).select("frame_no", rounded(heading).alias("heading"))


@query(
    "write_pose_slots",
    f"""WITH {POSE}, n AS (SELECT vec_id, heading, e, unnest(range(0, 64))::INT AS slot FROM a)
    SELECT vec_id AS frame_no, slot, {r('''CASE slot WHEN 62 THEN radians(heading)
        WHEN 63 THEN heading ELSE e[slot + 1]::DOUBLE END''')} AS value FROM n""",
)
def q_write_pose_slots(spark, sf_dir):
    posed = R.ego_pose(_pose_vectors(spark, sf_dir))
    return posed.select("frame_no", F.posexplode("can_bus").alias("slot", "v")).select(
        "frame_no", "slot", rounded(F.col("v")).alias("value")
    )


# -- events as frame records ------------------------------------------------


def event_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frame records, numbered by user and time."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    indexed = dense_index(events, ["user_id", "ts", "event_id"])
    number = F.col("event_id")
    return indexed.select(
        "frame_no",
        number.cast("string").alias("token"),
        F.concat(F.lit("lidar/"), number, F.lit(".bin")).alias("lidar_path"),
        (number - 1).cast("string").alias("prev"),
        (number + 1).cast("string").alias("next"),
        F.col("user_id").cast("string").alias("scene_token"),
        (number % 40).cast("int").alias("frame_idx"),
        F.expr(EPOCH_MICROS).alias("timestamp"),
        F.array(number.cast("string")).alias("sweeps"),
        F.array(F.col("value"), -F.col("value"), F.lit(1.0)).alias("ego2global_translation"),
        F.array(
            F.cos(number.cast("double")), F.lit(0.0), F.lit(0.0), F.sin(number.cast("double"))
        ).alias("ego2global_rotation"),
        F.array_repeat(F.lit(0.0), 18).alias("can_bus"),
        F.create_map(
            *[
                x
                for name in CAMERAS
                for x in (
                    F.lit(name),
                    F.struct(
                        F.concat(F.lit(f"{name}/"), number, F.lit(".jpg")).alias("data_path"),
                        F.lit([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]).alias("sensor2lidar_rotation"),
                        F.array(F.col("value"), F.lit(2.0), F.lit(3.0)).alias("sensor2lidar_translation"),
                        F.lit([[100.0, 0.0, 50.0], [0.0, 100.0, 40.0], [0.0, 0.0, 1.0]]).alias("cam_intrinsic"),
                    ),
                )
            ]
        ).alias("cams"),
    )


def event_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as annotations by frame number; most frames have none."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(
        F.col("doc_id").alias("frame_no"),
        F.array(F.col("quality") - 1, F.col("toxic")).alias("gt_labels"),
    )


INFOS = """
f AS (SELECT row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS frame_no,
             event_id, user_id, ts, value FROM events)"""
SAMPLE = """f.frame_no, f.event_id::VARCHAR AS sample_idx, 'lidar/' || f.event_id || '.bin' AS pts_filename,
    (f.event_id - 1)::VARCHAR AS prev_idx, (f.event_id + 1)::VARCHAR AS next_idx,
    f.user_id::VARCHAR AS scene_token, (f.event_id % 40)::INT AS frame_idx"""


@query(
    "frame_lookup",
    f"""WITH {INFOS} SELECT l.doc_id, f.frame_no, f.event_id::VARCHAR AS token
    FROM labels l JOIN f ON f.frame_no = l.doc_id * l.doc_id % (SELECT count(*) FROM events)""",
)
def q_frame_lookup(spark, sf_dir):
    frames = event_infos(spark, sf_dir).select("frame_no", "token")
    total = table(spark, sf_dir, "events").count()
    wanted = table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("doc_id") * F.col("doc_id") % total).alias("frame_no")
    )
    return R.frame_lookup(frames, wanted).select("doc_id", "frame_no", "token")


@query("frame_count", "SELECT count(*) AS n_frames FROM events")
def q_frame_count(spark, sf_dir):
    return R.frame_count(table(spark, sf_dir, "events"))


@query(
    "frame_fields",
    f"""WITH {INFOS} SELECT {SAMPLE}, {r('epoch_us(ts) / 1e6')} AS timestamp, event_id::VARCHAR AS sweep,
        {r('value')} AS ego_x, {r('-value')} AS ego_y, {r('cos(event_id)')} AS q_w, {r('sin(event_id)')} AS q_z,
        18 AS n_bus FROM f""",
)
def q_frame_fields(spark, sf_dir):
    fields = R.frame_fields(event_infos(spark, sf_dir))
    place, turn = F.col("ego2global_translation"), F.col("ego2global_rotation")
    return fields.select(
        "frame_no", "sample_idx", "pts_filename", "prev_idx", "next_idx", "scene_token", "frame_idx",
        rounded(F.col("timestamp")).alias("timestamp"), F.col("sweeps")[0].alias("sweep"),
        rounded(place[0]).alias("ego_x"), rounded(place[1]).alias("ego_y"),
        rounded(turn[0]).alias("q_w"), rounded(turn[3]).alias("q_z"), F.size("can_bus").alias("n_bus"),
    )


@query("micros_to_seconds", f"SELECT event_id, {r('epoch_us(ts) / 1e6')} AS seconds FROM events")
def q_micros_to_seconds(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    seconds = R.micros_to_seconds(F.expr(EPOCH_MICROS))
    return events.select("event_id", rounded(seconds).alias("seconds"))


@query(
    "attach_annotations",
    f"""WITH {INFOS} SELECT f.frame_no, l.quality - 1 AS first_label, l.toxic AS second_label
    FROM f LEFT JOIN labels l ON l.doc_id = f.frame_no""",
)
def q_attach_annotations(spark, sf_dir):
    frames = event_infos(spark, sf_dir).select("frame_no")
    joined = R.attach_annotations(frames, event_annotations(spark, sf_dir))
    label = lambda i: F.get("ann_info.gt_labels", F.lit(i))
    return joined.select("frame_no", label(0).alias("first_label"), label(1).alias("second_label"))


HEADING = """degrees(atan2(2 * (cos(event_id) * sin(event_id)),
    cos(event_id) * cos(event_id) - sin(event_id) * sin(event_id)))"""


@query(
    "test_view",
    f"""WITH {INFOS}, h AS (SELECT *, {HEADING} AS yaw FROM f)
    SELECT {SAMPLE.replace('f.', 'h.')}, 'FRONT/' || event_id || '.jpg' AS front,
        {r('-100 * value - 50 * 3')} AS shift, {r('value')} AS x,
        {r('CASE WHEN yaw < 0 THEN yaw + 360 ELSE yaw END')} AS heading FROM h""",
)
def q_test_view(spark, sf_dir):
    view = S.frame_view(event_infos(spark, sf_dir), CAMERAS)
    return view.select(
        "frame_no", "sample_idx", "pts_filename", "prev_idx", "next_idx", "scene_token", "frame_idx",
        F.col("img_filename")[0].alias("front"),
        rounded(F.col("lidar2img")[0][0][3]).alias("shift"),
        rounded(F.col("can_bus")[0]).alias("x"),
        rounded(F.element_at("can_bus", -1)).alias("heading"),
    )


def camera_shapes(frames: DataFrame) -> DataFrame:
    """The images' shapes, height, width and channels, as a reader would record them."""
    shape = F.struct(F.lit(450).alias("h"), F.lit(800).alias("w"), F.lit(3).alias("c"))
    return frames.withColumn("img_shape", F.transform("img_filename", lambda _: shape))


@query(
    "train_view",
    f"""WITH {INFOS}, l AS (SELECT doc_id AS frame_no, quality <> 0 OR toxic <> -1 AS good FROM labels),
    h AS (SELECT f.frame_no AS queue_no, p.pos, greatest(0, f.frame_no - 3 + p.pos) AS frame_no
          FROM f CROSS JOIN (SELECT unnest(range(0, 4)) AS pos) p),
    d AS (SELECT * FROM h WHERE pos <> ('0x' || substr(md5('7:' || queue_no), 1, 15))::BIGINT % 3),
    s AS (SELECT d.queue_no, (row_number() OVER (PARTITION BY d.queue_no ORDER BY d.pos) - 1)::INT AS slot,
                 f.*, coalesce(l.good, false) AS good
          FROM d JOIN f USING (frame_no) LEFT JOIN l USING (frame_no)),
    w AS (SELECT *, bool_and(good) OVER (PARTITION BY queue_no) AS kept,
                 coalesce(user_id = lag(user_id) OVER q, false) AS same,
                 value - lag(value) OVER q AS moved
          FROM s WINDOW q AS (PARTITION BY queue_no ORDER BY slot))
    SELECT queue_no, slot, w.frame_no, w.user_id::VARCHAR AS scene_token, same AS prev_bev_exists,
           {r('CASE WHEN same THEN moved ELSE 0 END')} AS rel_x,
           'FRONT/' || w.event_id || '.jpg' AS front, now.event_id::VARCHAR AS sample_idx,
           'lidar/' || now.event_id || '.bin' AS pts_filename, (now.event_id - 1)::VARCHAR AS prev_idx,
           (now.event_id + 1)::VARCHAR AS next_idx, (now.event_id % 40)::INT AS frame_idx,
           {r('epoch_us(now.ts) / 1e6')} AS timestamp, {r('now.value')} AS ego_x, {r('now.value')} AS bus_x,
           now.event_id::VARCHAR AS sweep, 2 AS n_matrices
    FROM w JOIN f now ON now.frame_no = w.queue_no WHERE kept""",
)
def q_train_view(spark, sf_dir):
    samples = S.training_samples(
        event_infos(spark, sf_dir), event_annotations(spark, sf_dir), CAMERAS, length=3, seed=7,
        stages=[camera_shapes],
    )
    slots = samples.select("*", F.explode_outer("img_metas").alias("slot", "m"))
    return slots.select(
        "queue_no", "slot", "m.frame_no", "m.scene_token", "m.prev_bev_exists",
        rounded(F.get("m.relative", F.lit(0))).alias("rel_x"),
        F.col("img")[F.col("slot")][0].alias("front"),
        "sample_idx", "pts_filename", "prev_idx", "next_idx", "frame_idx",
        rounded(F.col("timestamp")).alias("timestamp"),
        rounded(F.col("ego2global_translation")[0]).alias("ego_x"),
        rounded(F.col("can_bus")[0]).alias("bus_x"),
        F.col("sweeps")[0].alias("sweep"),
        F.size("lidar2img").alias("n_matrices"),
    )


SCANNED = f"""WITH {INFOS} SELECT f.frame_no, f.event_id::VARCHAR AS token, f.user_id::VARCHAR AS scene_token,
    epoch_us(ts) AS timestamp, {r('value')} AS x, 'BACK/' || event_id || '.jpg' AS back FROM f"""


def _in_order(spark, sf_dir, files: int | None = None) -> DataFrame:
    infos = event_infos(spark, sf_dir)
    dealt = infos.repartitionByRange(files, "frame_no") if files else infos.repartitionByRange("frame_no")
    return dealt.sortWithinPartitions("frame_no").drop("frame_no")


def _scanned(frames: DataFrame) -> DataFrame:
    return frames.select(
        "frame_no", "token", "scene_token", "timestamp",
        rounded(F.col("ego2global_translation")[0]).alias("x"),
        F.col("cams")["BACK"]["data_path"].alias("back"),
    )


@query("scan_frame_infos", SCANNED)
def q_scan_frame_infos(spark, sf_dir):
    """Frame records written as JSON lines in order, and numbered again."""
    path = f"{shared_folder(spark)}/framewright/frames-{uuid.uuid4().hex}"
    _in_order(spark, sf_dir).write.json(path)
    return _scanned(scan_frame_infos(spark, path, lines=True))


@query("scan_frame_lists", SCANNED)
def q_scan_frame_lists(spark, sf_dir):
    """The same records as a few large JSON lists, each read by byte ranges."""
    path = f"{shared_folder(spark)}/framewright/lists-{uuid.uuid4().hex}"
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    write_json_lists(_in_order(spark, sf_dir, files), path)
    return _scanned(scan_frame_infos(spark, path))
