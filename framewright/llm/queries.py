"""The operators applied to the whole supplied tables, and SQL where it can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.llm import bpe, bytebpe, chat, langid, notices, packing, resampling, simhash, suffixes, topk, tree, trie, warc
from framewright.llm.resampling_sql import OP12_SQL
from framewright.llm.trie_sql import OP11_SQL
from framewright.session import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    languages, model = langid.train_languages(docs.where(~langid.held_out()))
    found = langid.predict_languages(docs, languages, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"), kept_text=False)


def op3_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.scan_notices(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/framewright/archive-{uuid.uuid4().hex}"
    warc.write_archive(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder, records=False)


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), o AS (SELECT digest, min(page_id) AS owner FROM p GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> owner THEN owner END AS refers_to
FROM p JOIN o USING (digest)
"""


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), repeats=True)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return tree.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


#: a conversation whose texts consist of the template's own marks
MARKS_AS_TEXT = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(MARKS_AS_TEXT).alias("text"),
    )
    folder = f"{shared_folder(spark)}/framewright/chats-{uuid.uuid4().hex}"
    chat.format_chats(turns.union(extra)).write.parquet(folder)
    return chat.read_chats(spark.read.parquet(folder))


_MARKS = {r: len(m.before) + len(m.after) for r, m in chat.INSTRUCTION.roles.items()}
_OTHER = len(chat.INSTRUCTION.other.before.replace("{role}", "")) + len(chat.INSTRUCTION.other.after)
_CONTROL = r"<\\*<SYS>>|<\\*</SYS>>|\[\\*INST\]|\[\\*/INST\]|<\\*s>|<\\*/s>|\[\\*ROLE\]|\[\\*/ROLE\]|\[\\*/TURN\]"
OP10_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{MARKS_AS_TEXT}'), (-1, 1, 'assistant', '{MARKS_AS_TEXT}')
), n AS (
  SELECT *, row_number() OVER w AS k, lag(role, 1, '') OVER w AS before FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), c AS (
  SELECT *,
    len(regexp_extract_all(text, '{_CONTROL}')) AS escapes,
    CASE role WHEN 'system' THEN {_MARKS["system"]} WHEN 'user' THEN {_MARKS["user"]} WHEN 'assistant' THEN {_MARKS["assistant"]}
      ELSE {_OTHER} + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END AS marks,
    CASE role WHEN 'system' THEN before = '' WHEN 'user' THEN before IN ('', 'system', 'assistant')
      WHEN 'assistant' THEN before = 'user' ELSE FALSE END AS good
  FROM n
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum(length(text) + escapes + marks) AS BIGINT) AS formatted_chars,
  bool_and(good) AS in_order
FROM c GROUP BY conv_id
"""


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("enter", "exit")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.draw_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytebpe.encode_decode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES = {
    q.__name__: q
    for q in (
        op1_language, op2_repeats, op3_notices, op4_warc, op5_top_k, op6_nearest, op7_packing, op8_bpe, op9_simhash, op10_chat,
        op11_trie, op12_resampling, op13_byte_bpe,
    )
}
ORACLE = {"op4_warc": OP4_SQL, "op5_top_k": OP5_SQL, "op10_chat": OP10_SQL, "op11_trie": OP11_SQL, "op12_resampling": OP12_SQL}
