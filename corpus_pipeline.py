"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

1. language_id: documents whose language cannot be told (no letter, or no text) go.
2. line_dedup: frequent lines go from all documents but the last that holds them; documents stay.
3. simhash: one document, that with the smallest doc_id, stays of each group of near-duplicates (five-word Jaccard
   similarity of 0.8 or more).
4. decontaminate: documents that overlap with a benchmark item go.
5. packing: the rest is tokenized and packed into sequences; one row for each piece.

All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, language_id, near_copies, packing
from nearfield.llm import line_dedup as lines
from nearfield.llm.common import materialize, prepare
from nearfield.llm.queries import tokenizer_path

#: No stage but the second can be expressed in SQL.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles are learned from all rows with a known lang; if there are none, nothing but letterless text goes."""
    prepare(spark)
    profiles = language_id.learn_profiles(docs, F.lit(True))
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language_id.identify(docs, profiles).where(F.col("lang_pred") != language_id.UNKNOWN).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; n_chars follows the text."""
    prepare(spark)
    return lines.drop_lines(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the smallest doc_id of their component stay, once each; rows without doc_id stay."""
    prepare(spark)
    return near_copies.drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash", drop_copies),
    ("decontaminate", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
