"""Evaluation summaries: customers of a region are a run, segments classes.

Money is summed in whole cents, so both engines average the same numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.functions.rounding import round4
from framewright.operators import metrics as M
from framewright.session import shared_folder
from framewright.sources.metrics import scan_metrics_summary
from workload.registry import query, table

CLASSES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]
ERROR_NAMES = {"trans_err": "mATE", "scale_err": "mASE"}
PREFIX = "pts_bbox_NuScenes"
DISTANCES = ("0.5", "1.0", "2.0")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary per region: nested maps of averages over its customers."""
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("run_id"))
    per_class = (
        table(spark, sf_dir, "customer")
        .join(places, "c_nationkey")
        .groupBy("run_id", "c_mktsegment")
        .agg(F.sum(cents).alias("cents"), F.count("*").alias("n"))
    )
    # at most one row per segment is left to collect for a region
    entries = F.sort_array(F.collect_list(F.struct("c_mktsegment", "cents", "n")))
    runs = per_class.groupBy("run_id").agg(
        entries.alias("e"), F.sum("cents").alias("cents"), F.sum("n").alias("n")
    )
    scale = lambda e, k: e["cents"] / e["n"] / (1000000.0 * k)
    aps = lambda e: F.create_map(
        *[x for i, d in enumerate(DISTANCES) for x in (F.lit(d), scale(e, i + 1))]
    )
    errors = lambda e: F.create_map(
        F.lit("trans_err"), scale(e, 7), F.lit("scale_err"), scale(e, 9)
    )
    by_class = lambda f: F.map_from_entries(
        F.transform("e", lambda e: F.struct(e["c_mktsegment"], f(e)))
    )
    whole = F.struct("cents", "n")
    return runs.select(
        "run_id",
        by_class(aps).alias("label_aps"),
        by_class(errors).alias("label_tp_errors"),
        errors(whole).alias("tp_errors"),
        scale(whole, 3).alias("nd_score"),
        scale(whole, 5).alias("mean_ap"),
    )


RUNS = """
g AS (SELECT r_name AS run_id, c_mktsegment AS name, sum(round(c_acctbal * 100)::BIGINT) AS cents,
             count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey
      JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2),
w AS (SELECT run_id, sum(cents) AS cents, sum(n) AS n FROM g GROUP BY 1),
c AS (SELECT * FROM g WHERE name IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')),
""" + "\n".join(
    f"""{name} AS ({body}),"""
    for name, body in {
        "aps": " UNION ALL ".join(
            f"SELECT run_id, '{PREFIX}/' || name || '_AP_dist_{d}' AS metric,"
            f" round(cents / n / (1000000.0::DOUBLE * {i + 1}), 4) AS value FROM c"
            for i, d in enumerate(DISTANCES)
        ),
        "errs": " UNION ALL ".join(
            f"SELECT run_id, '{PREFIX}/' || name || '_{k}' AS metric,"
            f" round(cents / n / (1000000.0::DOUBLE * {d}), 4) AS value FROM c"
            for k, d in (("trans_err", 7), ("scale_err", 9))
        ),
        "means": " UNION ALL ".join(
            f"SELECT run_id, '{PREFIX}/{k}' AS metric,"
            f" round(cents / n / (1000000.0::DOUBLE * {d}), 4) AS value FROM w"
            for k, d in (("mATE", 7), ("mASE", 9))
        ),
    }.items()
) + f"""
heads AS (SELECT run_id, '{PREFIX}/NDS' AS metric, cents / n / (1000000.0::DOUBLE * 3) AS value FROM w
          UNION ALL SELECT run_id, '{PREFIX}/mAP', cents / n / (1000000.0::DOUBLE * 5) FROM w)"""
ALL = " UNION ALL ".join(f"SELECT run_id, metric, value FROM {t}" for t in ("aps", "errs", "means", "heads"))


@query("flatten_label_aps", f"WITH {RUNS} SELECT run_id, metric, value FROM aps")
def q_flatten_label_aps(spark, sf_dir):
    return M.flatten_label_aps(summaries(spark, sf_dir), CLASSES, PREFIX)


@query("flatten_label_tp_errors", f"WITH {RUNS} SELECT run_id, metric, value FROM errs")
def q_flatten_label_tp_errors(spark, sf_dir):
    return M.flatten_label_tp_errors(summaries(spark, sf_dir), CLASSES, PREFIX)


@query("flatten_mean_errors", f"WITH {RUNS} SELECT run_id, metric, value FROM means")
def q_flatten_mean_errors(spark, sf_dir):
    return M.flatten_mean_errors(summaries(spark, sf_dir), ERROR_NAMES, PREFIX)


@query("headline_scores", f"WITH {RUNS} SELECT run_id, metric, value FROM heads")
def q_headline_scores(spark, sf_dir):
    return M.headline_scores(summaries(spark, sf_dir), PREFIX)


@query("round4", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 4) AS rounded FROM lineitem")
def q_round4(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", round4(F.col("l_extendedprice") / 7).alias("rounded")
    )


@query(
    "round4_exact",
    "SELECT l_orderkey, l_linenumber, printf('%.4f', l_extendedprice / 7)::DOUBLE AS rounded FROM lineitem",
)
def q_round4_exact(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", round4(F.col("l_extendedprice") / 7, exact=True).alias("rounded")
    )


@query(
    "classes_filter",
    f"""WITH {RUNS} SELECT run_id, CASE name WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
        WHEN 'FURNITURE' THEN 2 ELSE 3 END AS class_no, name FROM c""",
)
def q_classes_filter(spark, sf_dir):
    rows = M.classes_filter(summaries(spark, sf_dir), "label_aps", CLASSES)
    return rows.select("run_id", "class_no", "name")


@query(
    "evaluation_split",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'mini_val' ELSE 'val' END AS split
       FROM customer""",
)
def q_evaluation_split(spark, sf_dir):
    version = F.when(F.col("c_custkey") % 2 == 0, "v1.0-mini").otherwise("v1.0-trainval")
    return table(spark, sf_dir, "customer").select("c_custkey", M.evaluation_split(version).alias("split"))


@query("flatten_metrics", f"WITH {RUNS} {ALL}")
def q_flatten_metrics(spark, sf_dir):
    return M.flatten_metrics(summaries(spark, sf_dir), CLASSES, ERROR_NAMES)


@query("scan_metrics_summary", f"WITH {RUNS} {ALL}")
def q_scan_metrics_summary(spark, sf_dir):
    """Summaries written as JSON, one folder per run, and read back."""
    path = f"{shared_folder(spark)}/framewright/summaries-{uuid.uuid4().hex}"
    summaries(spark, sf_dir).write.partitionBy("run_id").json(path)
    runs = scan_metrics_summary(spark, path, run_id="folder", name="*.json")
    runs = runs.withColumn("run_id", F.url_decode(F.regexp_replace("run_id", "^run_id=", "")))
    return M.flatten_metrics(runs, CLASSES, ERROR_NAMES)
