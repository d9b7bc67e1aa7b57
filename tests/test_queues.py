import pytest
from pyspark.sql import functions as F

from framewright.operators import queues as Q
from framewright.operators.indexing import dense_index

FRAMES = [
    (0, "A", 0.0, 350.0, [0]),
    (1, "A", 1.0, 355.0, [-1]),
    (2, "A", 3.0, 5.0, [0]),
    (3, "B", 10.0, 90.0, [0, -1]),
    (4, "B", 14.0, 100.0, [0]),
]
COLUMNS = ["scene_token", "can_bus", "gt_labels", "img", "img_shape"]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(n, s, [x, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 9.0, a], g, f"i{n}", 3) for n, s, x, a, g in FRAMES]
    return spark.createDataFrame(
        rows,
        "frame_no long, scene_token string, can_bus array<double>, gt_labels array<int>, img string, img_shape int",
    )


def oldest_dropped(frames, **kw):
    return Q.build_queues(frames, 3, COLUMNS, 1, draw=F.lit(0), **kw)


@pytest.mark.parametrize("block_rows", [1, 2, 3, 1024])
def test_fixture_queues(frames, block_rows):
    queues = Q.relative_pose(Q.scene_start_flag(oldest_dropped(frames, block_rows=block_rows)))
    got = {}
    for r in Q.queue_rows(queues).orderBy("queue_no", "slot").collect():
        got.setdefault(r.queue_no, []).append(
            (r.frame_no, r.prev_bev_exists, r.relative[0], r.relative[-1])
        )
        assert r.relative[3:8] == [1.0, 0.0, 0.0, 0.0, 9.0]
    f, t = False, True
    assert got == {
        0: [(0, f, 0, 0), (0, t, 0, 0), (0, t, 0, 0)],
        1: [(0, f, 0, 0), (0, t, 0, 0), (1, t, 1, 5)],
        2: [(0, f, 0, 0), (1, t, 1, 5), (2, t, 2, -350)],
        3: [(1, f, 0, 0), (2, t, 2, -350), (3, f, 0, 0)],
        4: [(2, f, 0, 0), (3, f, 0, 0), (4, t, 4, 10)],
    }


def test_label_filter_and_replacement(frames):
    queues = oldest_dropped(frames)
    kept = Q.filter_empty_queues(queues)
    assert sorted(r.queue_no for r in kept.collect()) == [0, 4]
    assert Q.filter_empty_queues(queues, enabled=False).count() == 5
    full = Q.replace_rejected(queues, seed=3).collect()
    assert sorted(r.queue_no for r in full) == [0, 1, 2, 3, 4]
    source = {r.queue_no: r.source_queue_no for r in full}
    assert source[0] == 0 and source[4] == 4 and set(source.values()) <= {0, 4}
    for r in full:
        assert [m.frame_no for m in r.members] == ([0, 0, 0] if r.source_queue_no == 0 else [2, 3, 4])


def test_donors_in_several_copies(frames, monkeypatch):
    queues = oldest_dropped(frames)
    once = sorted((r.queue_no, r.source_queue_no) for r in Q.replace_rejected(queues, seed=3).collect())
    monkeypatch.setattr(Q, "DRAWS_PER_COPY", 1)
    assert sorted((r.queue_no, r.source_queue_no) for r in Q.replace_rejected(queues, seed=3).collect()) == once


def test_no_accepted_queue_is_an_error(frames):
    queues = oldest_dropped(frames.withColumn("gt_labels", F.array(F.lit(-1))))
    with pytest.raises(ValueError, match="no queue is accepted"):
        Q.replace_rejected(queues, seed=3)
    assert Q.replace_rejected(queues.where("false"), seed=3).count() == 0


def test_ground_truth(spark):
    rows = spark.createDataFrame([(None,), ([],), ([-1, -1],), ([-1, 0],)], "g array<int>")
    assert [r[0] for r in rows.select(Q.has_ground_truth("g")).collect()] == [False, False, False, True]


@pytest.mark.parametrize("length", [0, 1, 3, 4])
@pytest.mark.parametrize("partitions", ["1", "4", "16"])
def test_slots(spark, frames, length, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        queues = Q.build_queues(frames, length, ["scene_token"], seed=42)
        rows = [(r.queue_no, [(m.slot, m.pos, m.frame_no) for m in r.members]) for r in queues.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r[0] for r in rows) == [0, 1, 2, 3, 4]
    for queue_no, slots in rows:
        assert [s for s, _, _ in slots] == list(range(max(length, 1)))
        positions = [p for _, p, _ in slots]
        assert positions == sorted(positions) and positions[-1] == length
        assert [f for _, _, f in slots] == [max(0, queue_no - length + p) for p in positions]


def test_draw_does_not_depend_on_partitioning(spark, frames):
    results = set()
    for n in (1, 5):
        queues = Q.build_queues(frames.repartition(n), 3, ["scene_token"], seed=42, block_rows=n)
        results.add(str(sorted((r.queue_no, [m.pos for m in r.members]) for r in queues.collect())))
    assert len(results) == 1


def test_gap_rejects_queue(frames):
    queues = oldest_dropped(frames.where("frame_no <> 2"))
    assert [r.queue_no for r in Q.filter_empty_queues(queues, enabled=False).orderBy("queue_no").collect()] == [0, 1]


def test_stack_metas_merge(frames):
    queues = Q.relative_pose(Q.scene_start_flag(oldest_dropped(frames)))
    merged = {r.queue_no: r for r in Q.merge_queue(queues, ["frame_no", "scene_token", "prev_bev_exists"]).collect()}
    assert merged[3].img == ["i1", "i2", "i3"]
    assert sorted(merged[3].img_metas) == [0, 1, 2]
    assert merged[3].img_metas[2].scene_token == "B" and not merged[3].img_metas[2].prev_bev_exists
    mixed = frames.withColumn("img_shape", F.col("frame_no").cast("int"))
    with pytest.raises(Exception, match="differ in shape"):
        Q.stack_queue(oldest_dropped(mixed)).collect()


def test_relative_positions_sum_up(frames):
    queues = Q.relative_pose(Q.scene_start_flag(Q.build_queues(frames, 4, COLUMNS, 7)))
    for q in queues.collect():
        by_scene = {}
        for m in q.members:
            by_scene.setdefault(m.frame.scene_token, []).append((m.frame.can_bus[0], m.relative[0]))
        for steps in by_scene.values():
            assert sum(r for _, r in steps) == pytest.approx(steps[-1][0] - steps[0][0])


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_dense_index_with_a_hot_scene(spark, partitions):
    # one scene holds most of the rows
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10).alias("scene"),
        ((F.col("id") * 7919) % 5003).alias("ts"), "id",
    )
    got = dense_index(rows, ["scene", "ts", "id"], partitions=partitions).collect()
    wanted = sorted((r.scene, r.ts, r.id) for r in rows.collect())
    assert [(r.scene, r.ts, r.id) for r in sorted(got, key=lambda r: r.frame_no)] == wanted
    assert sorted(r.frame_no for r in got) == list(range(5000))


@pytest.mark.parametrize("copies, step", [(1, 1), (3, 1), (1, 157), (2, 61)])
def test_ranks_find_their_numbers(spark, monkeypatch, copies, step):
    monkeypatch.setattr(Q, "WORDS_PER_BLOCK", 4)
    numbers = [k * step for k in range(700) if k * k % 7 != 2] + [62 * 5000 + 61]
    words = Q.rank_words(spark.createDataFrame([(n,) for n in numbers], "queue_no long"))
    assert words.agg(F.sum("_n")).first()[0] == len(numbers)
    ranks = [(k, k * 31 % len(numbers), k % copies) for k in range(2 * len(numbers))]
    drawn = spark.createDataFrame(ranks, "id long, _rank long, _copy int")
    got = {r["id"]: r["queue_no"] for r in Q.select_ranked(words, drawn, copies).collect()}
    assert got == {k: numbers[rank] for k, rank, _ in ranks}


def test_a_flag_rejects_what_its_labels_reject(frames):
    by_labels = Q.filter_empty_queues(oldest_dropped(frames)).select("queue_no").collect()
    flagged = Q.build_queues(Q.label_flag(frames, "gt_labels"), 3, ["has_gt"], 42, draw=F.lit(0))
    assert sorted(Q.filter_empty_queues(flagged, flag="has_gt").select("queue_no").collect()) == sorted(by_labels)


def test_replacement_plans_the_window_once(frames):
    """What comes back is read from the stored queues: no history is gathered again."""
    plan = Q.replace_rejected(oldest_dropped(frames), seed=3)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FileScan" in plan
