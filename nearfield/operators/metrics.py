"""Measures of search results, as aggregations over result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_per_query(found: DataFrame, truth: DataFrame, k: int, id: str = "id") -> DataFrame:
    """(qid, recall): the share of each query's true neighbours that were found."""
    hit = truth.select("qid", id).join(found.select("qid", id).distinct().withColumn("hit", F.lit(1)), ["qid", id], "left")
    return hit.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("recall"))


def recall(found: DataFrame, truth: DataFrame, k: int, id: str = "id") -> DataFrame:
    """One row: the mean recall."""
    return recall_per_query(found, truth, k, id).agg(F.avg("recall").alias("recall"))


def latency_buckets(results: DataFrame, buckets: DataFrame) -> DataFrame:
    """(bucket, n, mean_ms, mean_recall) of results whose selectivity lies from low to below high of a bucket."""
    inside = results.join(F.broadcast(buckets), (F.col("selectivity") >= F.col("low")) & (F.col("selectivity") < F.col("high")))
    return inside.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms"), F.avg("recall").alias("mean_recall"))


def latency_summary(results: DataFrame) -> DataFrame:
    """One row: median, 99th percentile and mean of ms."""
    return results.agg(F.median("ms").alias("p50"), F.percentile("ms", F.lit(0.99)).alias("p99"), F.avg("ms").alias("mean"))


def strategy_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("strategy").agg(F.count("*").alias("n"))


def grid_best(grid: DataFrame, min_recall: float) -> DataFrame:
    """One row: the fastest grid point (low, high) with enough recall; the first by low, high of equal ones."""
    best = F.min(F.struct("mean_ms", "low", "high", "recall"))
    return grid.where(F.col("recall") >= min_recall).agg(best.alias("b")).where("b is not null").select("b.low", "b.high", "b.mean_ms", "b.recall")


def value_at_recall(curve: DataFrame, target: float) -> DataFrame:
    """(engine, value) at the target recall, between the two points around it on a logarithmic scale."""
    w = Window.partitionBy("engine").orderBy("recall", "value")
    step = curve.withColumn("next_recall", F.lead("recall").over(w)).withColumn("next_value", F.lead("value").over(w))
    around = step.where((F.col("recall") <= target) & (F.col("next_recall") >= target) & (F.col("next_recall") > F.col("recall")))
    part = (F.lit(target) - F.col("recall")) / (F.col("next_recall") - F.col("recall"))
    value = F.exp(F.log("value") + part * (F.log("next_value") - F.log("value")))
    return around.groupBy("engine").agg(F.min_by(value, F.col("recall")).alias("value"))
