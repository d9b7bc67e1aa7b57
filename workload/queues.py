"""Temporal queues over `events`: one event is a frame, one user a scene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.functions.draws import clamp_index
from framewright.operators import queues as Q
from framewright.operators.indexing import dense_index
from workload.registry import query, rounded, sql_rounded as r, table

LENGTH = 4
SEED = 42


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames, numbered by scene and time."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return dense_index(events, ["user_id", "ts", "event_id"]).select(
        "frame_no",
        "event_id",
        F.col("user_id").alias("scene_token"),
        F.array(
            "value", F.col("value") * 2, -F.col("value"),
            F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0),
            F.radians((F.col("event_id") % 360).cast("double")),
            (F.col("event_id") % 360).cast("double"),
        ).alias("can_bus"),
        F.when(F.col("event_type") == "error", F.array(F.lit(-1)))
        .otherwise(F.array(F.lit(-1), F.length("event_type")))
        .alias("gt_labels"),
        F.concat(F.lit("img/"), F.col("event_id"), F.lit(".jpg")).alias("img"),
        F.struct(F.lit(450).alias("h"), F.lit(800).alias("w"), F.lit(3).alias("c")).alias("img_shape"),
    )


def _queues(spark, sf_dir, columns, own=()):
    frames = event_frames(spark, sf_dir).select("frame_no", *dict.fromkeys([*columns, *own]))
    return Q.build_queues(frames, LENGTH, columns, SEED).select("queue_no", *own, "members")


def _flagged_queues(spark, sf_dir):
    frames = Q.label_flag(event_frames(spark, sf_dir), "gt_labels").select("frame_no", "has_gt")
    return Q.build_queues(frames, LENGTH, ["has_gt"], SEED).select("queue_no", "members")


FRAMES = """
f AS (SELECT row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS frame_no,
             event_id, user_id AS scene_token, value AS x, 2 * value AS y, -value AS z,
             (event_id % 360)::DOUBLE AS angle, event_type <> 'error' AS has_gt,
             length(event_type) AS kind,
             'img/' || event_id || '.jpg' AS img
      FROM events)"""
HISTORY = FRAMES + f""",
h AS (SELECT f.frame_no AS queue_no, p.pos::INT AS pos, f.frame_no - {LENGTH} + p.pos AS wanted,
             greatest(0, f.frame_no - {LENGTH} + p.pos) AS frame_no
      FROM f CROSS JOIN (SELECT unnest(range(0, {LENGTH + 1})) AS pos) p)"""
DRAW = "('0x' || substr(md5('{seed}:' || {key}), 1, 15))::BIGINT % {n}"
KEPT = HISTORY + f""",
d AS (SELECT * FROM h WHERE pos <> {DRAW.format(seed=SEED, key='queue_no', n=LENGTH)})"""
SLOTS = KEPT + """,
s AS (SELECT d.queue_no, d.pos,
             (row_number() OVER (PARTITION BY d.queue_no ORDER BY d.pos) - 1)::INT AS slot,
             f.* FROM d JOIN f USING (frame_no))"""
FLAGS = SLOTS + """,
w AS (SELECT *, coalesce(scene_token = lag(scene_token) OVER q, false) AS prev_bev_exists,
             x - lag(x) OVER q AS dx, y - lag(y) OVER q AS dy, z - lag(z) OVER q AS dz,
             angle - lag(angle) OVER q AS dangle
      FROM s WINDOW q AS (PARTITION BY queue_no ORDER BY slot))"""
GOOD = SLOTS + """,
ok AS (SELECT queue_no, bool_and(has_gt) AS good FROM s GROUP BY queue_no)"""


@query(
    "dense_index",
    "SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS frame_no FROM events",
)
def q_dense_index(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return dense_index(events, ["user_id", "ts", "event_id"]).select("event_id", "frame_no")


@query(
    "clamp_index",
    f"WITH {FRAMES} SELECT frame_no, greatest(0, frame_no - {LENGTH}) AS oldest FROM f",
)
def q_clamp_index(spark, sf_dir):
    frames = event_frames(spark, sf_dir)
    return frames.select("frame_no", clamp_index(F.col("frame_no") - LENGTH).alias("oldest"))


@query("history_window", f"WITH {HISTORY} SELECT queue_no, pos, frame_no FROM h")
def q_history_window(spark, sf_dir):
    frames = event_frames(spark, sf_dir).select("frame_no")
    return Q.queue_rows(Q.history_window(frames, LENGTH, []))


@query("drop_one_history", f"WITH {KEPT} SELECT queue_no, pos, frame_no FROM d")
def q_drop_one_history(spark, sf_dir):
    frames = event_frames(spark, sf_dir).select("frame_no")
    kept = Q.drop_one_history(Q.history_window(frames, LENGTH, []), LENGTH, SEED)
    return Q.queue_rows(kept)


@query("queue_order", f"WITH {SLOTS} SELECT queue_no, slot, pos, frame_no FROM s")
def q_queue_order(spark, sf_dir):
    frames = event_frames(spark, sf_dir).select("frame_no")
    kept = Q.drop_one_history(Q.history_window(frames, LENGTH, []), LENGTH, SEED)
    return Q.queue_rows(Q.queue_order(kept))


@query(
    "build_queues",
    f"WITH {SLOTS} SELECT queue_no, slot, frame_no, event_id, scene_token, img FROM s",
)
def q_build_queues(spark, sf_dir):
    queues = _queues(spark, sf_dir, ["event_id", "scene_token", "img"])
    rows = Q.queue_rows(queues, ["event_id", "scene_token", "img"])
    return rows.select("queue_no", "slot", "frame_no", "event_id", "scene_token", "img")


@query("has_ground_truth", f"WITH {FRAMES} SELECT frame_no, has_gt FROM f")
def q_has_ground_truth(spark, sf_dir):
    frames = event_frames(spark, sf_dir)
    return frames.select("frame_no", Q.has_ground_truth("gt_labels").alias("has_gt"))


@query(
    "filter_empty_queues",
    f"WITH {GOOD} SELECT queue_no, slot, s.frame_no FROM s JOIN ok USING (queue_no) WHERE good",
)
def q_filter_empty_queues(spark, sf_dir):
    kept = Q.filter_empty_queues(_flagged_queues(spark, sf_dir), flag="has_gt")
    return Q.queue_rows(kept).select("queue_no", "slot", "frame_no")


@query(
    "replace_rejected",
    f"""WITH {GOOD},
    n AS (SELECT count(*) AS n FROM ok WHERE good),
    ranked AS (SELECT queue_no, row_number() OVER (ORDER BY queue_no) - 1 AS rank FROM ok WHERE good),
    pick AS (SELECT queue_no, queue_no AS source_queue_no FROM ok WHERE good
             UNION ALL
             SELECT ok.queue_no, ranked.queue_no
             FROM ok CROSS JOIN n
             JOIN ranked ON ranked.rank = {DRAW.format(seed=SEED, key='ok.queue_no', n='n.n')}
             WHERE NOT good)
    SELECT pick.queue_no, source_queue_no, slot, s.frame_no
    FROM pick JOIN s ON s.queue_no = source_queue_no""",
)
def q_replace_rejected(spark, sf_dir):
    full = Q.replace_rejected(_flagged_queues(spark, sf_dir), SEED, flag="has_gt")
    return full.select("queue_no", "source_queue_no", F.explode_outer("members").alias("m")).select(
        "queue_no", "source_queue_no", "m.slot", "m.frame_no"
    )


@query(
    "scene_start_flag",
    f"WITH {FLAGS} SELECT queue_no, slot, frame_no, scene_token, prev_bev_exists FROM w",
)
def q_scene_start_flag(spark, sf_dir):
    flagged = Q.scene_start_flag(_queues(spark, sf_dir, ["scene_token"]))
    return Q.queue_rows(flagged, ["scene_token"]).select(
        "queue_no", "slot", "frame_no", "scene_token", "prev_bev_exists"
    )


@query(
    "relative_pose",
    f"""WITH {FLAGS} SELECT queue_no, slot, frame_no, prev_bev_exists,
        {r('CASE WHEN prev_bev_exists THEN dx ELSE 0 END')} AS rel_x,
        {r('CASE WHEN prev_bev_exists THEN dy ELSE 0 END')} AS rel_y,
        {r('CASE WHEN prev_bev_exists THEN dz ELSE 0 END')} AS rel_z,
        {r('CASE WHEN prev_bev_exists THEN dangle ELSE 0 END')} AS rel_angle,
        {r('radians(angle)')} AS heading_radians
        FROM w""",
)
def relative_pose(spark, sf_dir):
    flagged = Q.scene_start_flag(_queues(spark, sf_dir, ["scene_token", "can_bus"]))
    rows = Q.queue_rows(Q.relative_pose(flagged))
    part = lambda i: rounded(F.element_at("relative", i))
    return rows.select(
        "queue_no", "slot", "frame_no", "prev_bev_exists",
        part(1).alias("rel_x"), part(2).alias("rel_y"), part(3).alias("rel_z"),
        part(-1).alias("rel_angle"), part(-2).alias("heading_radians"),
    )


@query(
    "stack_queue",
    f"""WITH {SLOTS} SELECT queue_no, count(*) AS n_images,
        string_agg(img, ',' ORDER BY slot) AS images FROM s GROUP BY queue_no""",
)
def q_stack_queue(spark, sf_dir):
    stacked = Q.stack_queue(_queues(spark, sf_dir, ["img", "img_shape"]))
    return stacked.select(
        "queue_no",
        F.size("img").cast("bigint").alias("n_images"),
        F.array_join("img", ",").alias("images"),
    )


@query(
    "queue_metas",
    f"WITH {FLAGS} SELECT queue_no, slot, scene_token, event_id, prev_bev_exists FROM w",
)
def q_queue_metas(spark, sf_dir):
    queues = Q.scene_start_flag(_queues(spark, sf_dir, ["scene_token", "event_id"]))
    metas = Q.queue_metas(queues, ["scene_token", "event_id", "prev_bev_exists"])
    return metas.select("queue_no", F.explode_outer("img_metas").alias("slot", "meta")).select(
        "queue_no", "slot", "meta.scene_token", "meta.event_id", "meta.prev_bev_exists"
    )


@query(
    "merge_queue",
    f"""WITH {FLAGS}, m AS (
        SELECT queue_no, string_agg(img, ',' ORDER BY slot) AS images,
               string_agg(scene_token || ':' || CASE WHEN prev_bev_exists THEN 1 ELSE 0 END, ' '
                          ORDER BY slot) AS metas,
               sum(CASE WHEN prev_bev_exists THEN dx ELSE 0 END) AS moved
        FROM w GROUP BY queue_no)
        SELECT m.queue_no, f.event_id, f.has_gt, m.images, m.metas, {r('m.moved')} AS moved
        FROM m JOIN f ON f.frame_no = m.queue_no""",
)
def q_merge_queue(spark, sf_dir):
    queues = _queues(
        spark, sf_dir, ["scene_token", "can_bus", "img", "img_shape"], own=["event_id", "gt_labels"]
    )
    queues = Q.relative_pose(Q.scene_start_flag(queues))
    merged = Q.merge_queue(queues, ["slot", "scene_token", "prev_bev_exists", "relative"])
    metas = F.array_sort(F.map_values("img_metas"))
    return merged.select(
        "queue_no",
        "event_id",
        Q.has_ground_truth("gt_labels").alias("has_gt"),
        F.array_join("img", ",").alias("images"),
        F.array_join(
            F.transform(
                metas, lambda m: F.concat_ws(":", m["scene_token"], m["prev_bev_exists"].cast("int"))
            ),
            " ",
        ).alias("metas"),
        rounded(
            F.aggregate(metas, F.lit(0.0), lambda acc, m: acc + F.get(m["relative"], F.lit(0)))
        ).alias("moved"),
    )
