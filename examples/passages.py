"""Passages of a text table in a collection, with attributes taken from the text, searched by words.

    python examples/passages.py /root/testdata/sf0.001/documents.parquet "some words to look for"

The embedding is a hashed bag of words: it needs no model, and stands where a model would be called.
"""

from __future__ import annotations

import os
import sys
import tempfile
import zlib

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nearfield.engine import Engine
from nearfield.functions.vector import has_digits, word_count
from nearfield.sources.vecs import embedded

DIM = 64


def embed(texts: list[str | None]) -> np.ndarray:
    """One row a text: its words, hashed to DIM counts."""
    found = np.zeros((len(texts), DIM), np.float32)
    for row, text in zip(found, texts, strict=True):
        for word in (text or "").lower().split():
            row[zlib.crc32(word.encode()) % DIM] += 1
    return found


def main(table: str, words: str) -> list[tuple[str, float]]:
    spark = SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[*]")).config("spark.ui.enabled", "false").getOrCreate()
    documents = spark.read.parquet(table).where("text is not null").dropDuplicates(["doc_id"])
    passages = documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), "text", word_count(F.col("text")).alias("words"), has_digits(F.col("text")).alias("has_digits"))
    with tempfile.TemporaryDirectory() as root, Engine(spark, root) as engine:
        shelf = engine.create_collection("passages", DIM, metric="cosine")
        shelf.upsert_frame(embedded(passages, embed, DIM).drop("text"))
        found = engine.search("passages", embed([words])[0], 5, "words > 20 AND NOT has_digits == true", include_attributes=True)
        for id, distance, attributes in zip(found.ids, found.distances, found.attributes, strict=True):
            print(f"{id:>8}  {distance:.4f}  {attributes}")
        print(f"{found.info.strategy}, selectivity {found.info.selectivity:.3f}")
        return list(zip(found.ids, found.distances, strict=True))


if __name__ == "__main__":
    main(*sys.argv[1:3])
