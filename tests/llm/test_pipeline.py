"""The pipeline, stage by stage, on the smallest tables and on planted rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import queries

SF = "/root/testdata/sf0.001"
PASSAGE = "every lantern on the northern quay was lit before the ships came home from the long winter of the ninth year"


def _planted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, other = "one two three four five six seven eight nine ten " * 12, "the harbour master wrote down the names of the ships"
    rows = [(900_001, n, "en"), (900_002, n, "en"), (900_003, f"{other} {PASSAGE}", "en"), (900_004, f"{PASSAGE} and nothing that was said before or after", "en"), (900_005, "12 34", None), (900_006, None, "en"), (900_007, "", None)]
    extra = spark.createDataFrame([(i, t, lang, "planted", len(t or "")) for i, t, lang in rows], docs.schema)
    return docs.unionByName(extra)


def test_stages_have_their_effect(spark):
    docs = _planted(spark)
    told = corpus_pipeline.language(spark, docs, SF)
    assert told.columns == docs.columns
    ids = {r[0] for r in told.select("doc_id").collect()}
    assert {900_001, 900_002, 900_003, 900_004} <= ids and not {900_005, 900_006, 900_007} & ids
    one = corpus_pipeline.near_duplicates(spark, told, SF)
    kept = {r[0] for r in one.select("doc_id").collect()}
    assert 900_001 in kept and 900_002 not in kept and {900_003, 900_004} <= kept and one.columns == docs.columns
    cut = corpus_pipeline.repeated_passages(spark, one, SF)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert set(texts) == kept and PASSAGE in texts[900_003] and PASSAGE not in texts[900_004]
    packed = corpus_pipeline.sequences(spark, cut, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == kept


def test_a_table_without_labels_keeps_its_texts(spark):
    docs = _planted(spark).withColumn("lang", F.lit(None).cast("string"))
    told = corpus_pipeline.language(spark, docs, SF)
    want = {r["doc_id"]: r["text"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))}
    assert {r["doc_id"]: r["text"] for r in told.collect()} == want and len(want) > 100
    assert told.columns == docs.columns and told.where("lang IS NOT NULL").count() == 0


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    columns = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(tuple, docs.select(columns).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select(columns).collect()))


def test_every_query_of_the_list_is_there():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
