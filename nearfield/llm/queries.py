"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, language_id, packing, quality, repeats, secrets, simhash, token_files, topk
from nearfield.llm import line_dedup as lines
from nearfield.llm.common import held_out, prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer file that the token queries name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn_profiles(docs, ~held_out(F.col("doc_id")))
    found = language_id.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.line_dedup(table(spark, sf_dir, "documents")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, out = quality.feature_table(table(spark, sf_dir, "documents")), held_out(F.col("doc_id"))
    scored = quality.score(features, quality.learn(features, table(spark, sf_dir, "labels"), ~out))
    return scored.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repeats": op1_repeats,
        "op2_language_id": op2_language_id,
        "op3_simhash": op3_simhash,
        "op4_line_dedup": op4_line_dedup,
        "op5_token_files": op5_token_files,
        "op6_quality": op6_quality,
        "op7_topk": op7_topk,
        "op8_packing": op8_packing,
        "op9_decontaminate": op9_decontaminate,
        "op10_secrets": op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_repeats": repeats.ORACLE, "op4_line_dedup": lines.ORACLE, "op7_topk": topk.ORACLE}
