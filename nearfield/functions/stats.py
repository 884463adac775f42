"""Attribute statistics: one aggregation, one sort of all numbers, and one grouping per attribute that needs frequencies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.filters import NUM, STR

#: Numeric attributes with more distinct values than this have quantiles only; the values of strings are then kept in a table.
MAX_FREQUENCIES = 256
QUANTILES = 101


def null_fractions(records: DataFrame, names: list[str]) -> DataFrame:
    """(name, n, null_frac), one row an attribute."""
    counted = records.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in names))
    entries = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col("n"), (1 - F.col(c) / F.col("n")).alias("null_frac")) for c in names)))
    return counted.select(entries.alias("e")).select("e.*")


def value_frequencies(records: DataFrame, name: str) -> DataFrame:
    """(value, n) of every value present."""
    return records.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))


def order_statistics(records: DataFrame, columns: list[str], points: int = QUANTILES) -> dict[str, list[float]]:
    """Exact quantiles of each column at `points` equal steps, interpolated between the values around each.

    All columns are sorted together across partitions, which are ranges of (column, value, row), so that a value that
    very many rows have is spread over partitions as well.  Only the partitions' counts and the values at the wanted places reach
    the driver.
    """
    spark = records.sparkSession
    numbers = records.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)), F.monotonically_increasing_id().alias("id"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("attr"), F.col(f"c{i}").alias("v")) for i in range(len(columns)))))
    keys = ["attr", "v"] if len(columns) > 1 else ["v"]
    rows = numbers.select("id", each.alias("e")).select("e.attr", "e.v", "id") if len(columns) > 1 else numbers.select(F.lit(0).alias("attr"), F.col("c0").alias("v"), "id")
    ordered = rows.where("v is not null").repartitionByRange(*keys, "id").sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    placed = ordered.select("attr", "v", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")).persist()
    try:
        held = placed.groupBy("part", "attr").agg(F.count("*").alias("n"), F.min("row").alias("first")).collect()
        where, wanted = {}, []
        for attr in range(len(columns)):
            parts = sorted((r for r in held if r.attr == attr), key=lambda r: r.part)
            if not parts:
                continue
            ends = np.cumsum([r.n for r in parts])
            n = int(ends[-1])
            where[attr] = [i * (n - 1) / (points - 1) for i in range(points)]
            for place in sorted({int(w) for w in where[attr]} | {min(n - 1, int(w) + 1) for w in where[attr]}):
                k = int(np.searchsorted(ends, place, "right"))
                wanted.append((parts[k].part, parts[k].first + place - int(ends[k] - parts[k].n), place))
        picks = spark.createDataFrame(wanted, "part long, row long, place long")
        values = {(r.attr, r.place): r.v for r in placed.join(F.broadcast(picks), ["part", "row"]).select("attr", "place", "v").collect()}
    finally:
        placed.unpersist()
    found = {}
    for attr, name in enumerate(columns):
        steps = where.get(attr, [])
        found[name] = []
        for w in steps:
            low, high = values[attr, int(w)], values[attr, min(int(steps[-1]), int(w) + 1)]
            found[name].append(low + (w - int(w)) * (high - low))
    return found


def quantiles(records: DataFrame, name: str, points: int = QUANTILES, exact: bool = True) -> DataFrame:
    """(point, quantile): linear interpolation between order statistics, or a sketch's values."""
    if exact:
        found = order_statistics(records, [name], points)[name]
        return records.sparkSession.createDataFrame(list(enumerate(found)), "point int, quantile double")
    shares = F.array(*(F.lit(i / (points - 1)) for i in range(points)))
    return records.agg(F.percentile_approx(name, shares, 10_000).alias("q")).select(F.posexplode("q").alias("point", "quantile"))


def distinct_count(records: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """(n_distinct) of the values present."""
    return records.agg((F.count_distinct(name) if exact else F.approx_count_distinct(name, 0.01)).alias("n_distinct"))


def analyze(records: DataFrame, kinds: dict[str, str], exact: bool = True, tables: str | None = None) -> dict[str, dict]:
    """The statistics of all attributes, as the planner's estimator takes them.

    What reaches the driver: 101 numbers and at most 256 frequencies of an attribute.  A string attribute of more
    values has its frequencies written to a folder below `tables`, from where `resolve` takes those that a filter
    names; without `tables` such an attribute has none, and the planner counts instead.  Quantiles and
    distinct counts are exact, or, with `exact=False`, from sketches.
    """
    if not kinds:
        return {}
    n = records.count()
    shares = F.array(*(F.lit(i / (QUANTILES - 1)) for i in range(QUANTILES)))
    wanted = []
    for name, kind in kinds.items():
        column = F.col(name)
        wanted += [F.count(column).alias(f"n_{name}"), (F.count_distinct(column) if exact else F.approx_count_distinct(column, 0.01)).alias(f"d_{name}")]
        if kind == NUM and not exact:
            wanted.append(F.percentile_approx(column, shares, 10_000).alias(f"q_{name}"))
    row = records.agg(*wanted).first()
    numbers = [name for name, kind in kinds.items() if kind == NUM and row[f"n_{name}"]]
    points = order_statistics(records, numbers) if exact and numbers else {name: list(row[f"q_{name}"]) for name in numbers}
    found: dict[str, dict] = {}
    for name, kind in kinds.items():
        present, distinct = row[f"n_{name}"], row[f"d_{name}"]
        own: dict = {"kind": kind, "n": n, "null_frac": 1 - present / n if n else 0.0, "n_distinct": distinct}
        if name in points:
            own["quantiles"] = points[name]
        if distinct <= MAX_FREQUENCIES:
            own["freq"] = [[r.value, r.n] for r in value_frequencies(records, name).collect()]
        elif kind == STR:
            if tables is None:
                continue
            own["unlisted"] = f"{tables}/{name}"
            value_frequencies(records, name).sort("value").write.mode("overwrite").parquet(own["unlisted"])
        found[name] = own
    return found


def resolve(stats: dict[str, dict], values: dict[str, set], spark: SparkSession) -> dict[str, dict]:
    """The statistics with the frequencies of these values (by attribute) where they are kept in a table."""
    found = dict(stats)
    for name, some in values.items():
        if path := stats.get(name, {}).get("unlisted"):
            rows = spark.read.schema("value string, n long").parquet(path).where(F.col("value").isin(*some)).collect()
            found[name] = {k: v for k, v in stats[name].items() if k != "unlisted"} | {"freq": [[r.value, r.n] for r in rows]}
    return found
