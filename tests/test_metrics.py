import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framewright.functions.rounding import round4
from framewright.operators import metrics as M, objects as O
from framewright.plans.evaluation import evaluate_runs
from framewright.sources.metrics import scan_metrics_summary

SUMMARY = {
    "label_aps": {"car": {"0.5": 0.12344, "1.0": 0.2}, "bus": {"0.5": 0.7}},
    "label_tp_errors": {"car": {"e1": 0.3}, "bus": {"e1": 0.9}},
    "tp_errors": {"e1": 0.31239},
    "nd_score": 0.4,
    "mean_ap": 0.25,
}
EXPECTED = {
    "pts_bbox_NuScenes/car_AP_dist_0.5": 0.1234,
    "pts_bbox_NuScenes/car_AP_dist_1.0": 0.2,
    "pts_bbox_NuScenes/car_e1": 0.3,
    "pts_bbox_NuScenes/mE1": 0.3124,
    "pts_bbox_NuScenes/NDS": 0.4,
    "pts_bbox_NuScenes/mAP": 0.25,
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    for run in ("r1", "r2"):
        (root / run).mkdir()
        (root / run / "metrics_summary.json").write_text(json.dumps(SUMMARY, indent=2))
    return str(root)


@pytest.fixture(scope="module")
def runs(spark, folder):
    return scan_metrics_summary(spark, folder, run_id="folder")


@pytest.mark.parametrize("exact", [False, True])
def test_flatten(runs, exact):
    rows = M.flatten_metrics(runs, ["car"], {"e1": "mE1"}, exact=exact).collect()
    for run in ("r1", "r2"):
        assert {r.metric: r.value for r in rows if r.run_id == run} == EXPECTED
    assert len(rows) == 12


def test_parts_add_up(runs):
    prefix, names = M.metric_prefix(), {"e1": "mE1"}
    parts = (
        M.flatten_label_aps(runs, ["car", "bus"], prefix)
        .unionByName(M.flatten_label_tp_errors(runs, ["car", "bus"], prefix))
        .unionByName(M.flatten_mean_errors(runs, names, prefix))
        .unionByName(M.headline_scores(runs, prefix))
    )
    whole = M.flatten_metrics(runs, ["car", "bus"], names)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


def test_missing_names_fail(runs):
    with pytest.raises(PySparkException, match="of class truck"):
        M.flatten_metrics(runs, ["truck"], {"e1": "mE1"}).collect()
    with pytest.raises(PySparkException, match="of class truck"):
        M.classes_filter(runs, "label_aps", ["truck"]).collect()
    with pytest.raises(PySparkException, match="name for error e1"):
        M.flatten_metrics(runs, ["car"], {"e2": "mE2"}).collect()


def test_class_order(runs):
    rows = M.classes_filter(runs, "label_aps", ["car", "bus"]).where("run_id = 'r1'").collect()
    assert [(r.class_no, r.name) for r in rows] == [(0, "car"), (1, "bus")]


def test_plan_reads_files(spark, folder):
    rows = evaluate_runs(spark, folder, {"e1": "mE1"}, classes=["car"]).collect()
    assert len(rows) == 12 and {r.run_id.split("/")[-2] for r in rows} == {"r1", "r2"}


def test_broken_file_fails(spark, tmp_path):
    (tmp_path / "metrics_summary.json").write_text('{"nd_score": ')
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        scan_metrics_summary(spark, str(tmp_path)).collect()


def test_neighbouring_files_are_no_summaries(spark, tmp_path):
    for name in ("metrics_summary.json", "metrics_details.json"):
        (tmp_path / name).write_text(json.dumps(SUMMARY) if "summary" in name else "{}")
    assert scan_metrics_summary(spark, str(tmp_path)).count() == 1


def test_exact_rounding(spark):
    values = [2.00005, 5e-05, -1.00005, 0.12345, 1e20, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in rows.select(round4(F.col("v"), exact=True)).collect()]
    assert got == [None if v is None else float(f"{v:.4f}") for v in values]
    assert got[0] == 2.0


def test_split(spark):
    rows = spark.createDataFrame([("v1.0-mini",), ("v1.0-trainval",)], "v string")
    assert [r[0] for r in rows.select(M.evaluation_split(F.col("v"))).collect()] == ["mini_val", "val"]
    with pytest.raises(PySparkException, match="version v2"):
        rows.select(M.evaluation_split(F.lit("v2"))).collect()


def test_object_filters(spark):
    rows = [(1, [[0.0, 0.0, 9.0], [51.2, 0.0, 0.0], [-60.0, 1.0, 0.0]], [0, 1, 12]), (2, [], [])]
    samples = spark.createDataFrame(rows, "id int, gt_bboxes_3d array<array<double>>, gt_labels_3d array<int>")
    near = {r.id: r for r in O.object_range_filter(samples).collect()}
    assert near[1].gt_labels_3d == [0] and near[1].gt_bboxes_3d == [[0.0, 0.0, 9.0]] and near[2].gt_labels_3d == []
    named = {r.id: r for r in O.object_name_filter(samples, M.CLASS_NAMES).collect()}
    assert named[1].gt_labels_3d == [0, 1] and len(named[1].gt_bboxes_3d) == 2
