"""Filtered-search workload: attributes, predicates from rare to common, measurement and tuning of the planner."""

from __future__ import annotations

import random
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.filters import compile_filter, parse
from nearfield.operators import metrics
from nearfield.operators.topk import top_k
from nearfield.plans.planner import Planner, filtered_search

KINDS = {"price": "num", "category": "str", "in_stock": "bool"}
CATEGORIES = 50
#: Selectivity buckets of a summary: (name, from, below).
BUCKETS = (("under 0.1 %", 0.0, 0.001), ("0.1 to 1 %", 0.001, 0.01), ("1 to 10 %", 0.01, 0.1), ("10 to 50 %", 0.1, 0.5), ("over 50 %", 0.5, 1.01))


def uniform(id: str, salt: int):
    """A number from 0 to below 1 that depends on the id and the salt only."""
    return F.pmod(F.xxhash64(F.col(id), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def with_attributes(base: DataFrame, id: str = "id") -> DataFrame:
    """`base` with a price (0 to 999, uniform), a category (Zipf over 50) and in_stock (70 % true)."""
    total, bounds = sum(1 / i for i in range(1, CATEGORIES + 1)), []
    for i in range(1, CATEGORIES + 1):
        bounds.append((bounds[-1] if bounds else 0) + 1 / i / total)
    u = F.col("_u")
    rank = F.size(F.filter(F.array(*(F.lit(b) for b in bounds[:-1])), lambda b: b <= u))
    return (
        base.withColumn("_u", uniform(id, 2))
        .withColumns({"price": F.floor(uniform(id, 1) * 1000).cast("double"), "category": F.concat(F.lit("c"), rank.cast("string")), "in_stock": uniform(id, 3) < 0.7})
        .drop("_u")
    )


def predicates(n: int, seed: int = 7) -> list[str]:
    """n filters, in turn from eight templates between about 1e-5 and 0.95 of the rows."""
    rng = random.Random(seed)
    templates: list[Callable[[], str]] = [
        lambda: f'price == {rng.randrange(1000)} AND category == "c{rng.randrange(30, CATEGORIES)}"',
        lambda: f"price == {rng.randrange(1000)}",
        lambda: f'category == "c{rng.randrange(20, CATEGORIES)}" AND in_stock == true',
        lambda: f'category == "c{rng.randrange(3, 12)}"',
        lambda: f"price < {rng.randrange(50, 150)} AND in_stock == true",
        lambda: f"price >= {rng.randrange(500, 800)}",
        lambda: 'category IN ("c0", "c1", "c2") OR in_stock == false',
        lambda: f"NOT price < {rng.randrange(30, 80)}",
    ]
    return [templates[i % len(templates)]() for i in range(n)]


def measure(records: DataFrame, queries: list[tuple[list[float], str]], k: int, planner: Planner, strategy: str | None = None, near=None, id: str = "id") -> DataFrame:
    """(strategy, selectivity, ms, recall) of each query (vector, filter); the answers are compared with exact ones."""
    rows = []
    for vector, text in queries:
        truth = {r[0] for r in top_k(records.where(compile_filter(parse(text), KINDS)), vector, k, id).select(id).collect()}
        begin = time.perf_counter()
        found = filtered_search(records, KINDS, vector, k, text, planner, strategy=strategy, near=near(vector) if near else None, id=id)
        ids = {r[0] for r in found.rows.select(id).collect()}
        ms = 1000 * (time.perf_counter() - begin)
        rows.append((found.strategy, float(found.selectivity), ms, len(ids & truth) / len(truth) if truth else 1.0))
    return records.sparkSession.createDataFrame(rows, "strategy string, selectivity double, ms double, recall double")


def buckets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BUCKETS), "bucket string, low double, high double")


def tune(records: DataFrame, queries: list[tuple[list[float], str]], k: int, lows: list[float], highs: list[float], min_recall: float = 0.95, id: str = "id") -> DataFrame:
    """One row: the fastest pair of planner thresholds with enough recall."""
    rows = []
    for low in lows:
        for high in highs:
            if low < high:
                planner = Planner(brute_force_max_selectivity=low, post_filter_min_selectivity=high)
                got = measure(records, queries, k, planner, near=lambda v: lambda rows, k, ef: top_k(rows, v, k, id), id=id).collect()
                rows.append((low, high, statistics.mean(r.ms for r in got), statistics.mean(r.recall for r in got)))
    grid = records.sparkSession.createDataFrame(rows, "low double, high double, mean_ms double, recall double")
    return metrics.grid_best(grid, min_recall)
