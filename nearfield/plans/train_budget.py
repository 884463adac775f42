"""Train a search budget for a collection and save it.

    python -m nearfield.plans.train_budget --collection hdfs:///vectors/shop --out hdfs:///models/shop.json

Queries are vectors of the collection itself, those whose ids hash lowest; a tenth of them is held out to stop early.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nearfield.collection import Collection
from nearfield.errors import InvalidArgument
from nearfield.plans import budget


def train(collection: Collection, queries: int = 1000, k: int = 10, trees: int = 40) -> budget.BudgetModel:
    """A model for the collection's snapshot."""
    cells = collection.cells()
    if cells is None:
        raise InvalidArgument("the collection has no snapshot with an index")
    rows = collection.indexed().select(F.xxhash64("id").alias("id"), "vector", "cell")
    asked = rows.orderBy(F.xxhash64("id")).limit(queries).select(F.col("id").alias("qid"), F.col("vector").alias("qv"))
    return budget.train(budget.training_rows(collection.spark, rows, cells, asked, k), trees)


def main(arguments: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    options.add_argument("--collection", required=True, help="path of the collection")
    options.add_argument("--out", required=True, help="where the model goes")
    options.add_argument("--queries", type=int, default=1000)
    options.add_argument("--k", type=int, default=10)
    options.add_argument("--trees", type=int, default=40)
    given = options.parse_args(arguments)
    spark = SparkSession.builder.appName("train_budget").getOrCreate()
    model = train(Collection.open(spark, given.collection), given.queries, given.k, given.trees)
    budget.save(spark, model, given.out)


if __name__ == "__main__":
    main()
