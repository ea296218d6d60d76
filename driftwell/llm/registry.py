"""The queries of this folder, and the SQL that states their results where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, chat, decontaminate, html, lm, packing, quality, sharding, simhash, suffix, whitening


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(read(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, distance=2)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")],
        "conv_id long, turn long, role string, text string",
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.read_back(chat.format_paths(chat.best_paths(chat.linear_threads(rows)))))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir, "documents"), length=50, with_text=False)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), shards=16)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), vocabulary_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"), order=2)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), every=20, top=20)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", scale=64.0, offset=1_000_000, components=32)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"), vocabulary_path(), capacity=4096, end=1)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.mask_counts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def queries() -> dict:
    return {
        name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()
    }


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### ') AS body,
         replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### '), ':', '\:') AS head
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(head) + length(body) + 4 + 2 + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": CHAT_SQL, "op13_audit": audit.AUDIT_SQL}
