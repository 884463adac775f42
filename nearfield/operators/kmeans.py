"""k-means: distributed assignment and update, and a seeded fit on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.topk import matrix

#: Rows that a fit on a sample reads at most.
SAMPLE = 65_536
#: Distances computed at a time.
TILE = 1 << 20


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def nearest_distances(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance to it) of each row of x, some rows at a time."""
    own, near, step = np.empty(len(x), np.int64), np.empty(len(x)), max(1, TILE // len(c))
    for begin in range(0, len(x), step):
        d = squared(x[begin : begin + step], c)
        own[begin : begin + step] = some = np.argmin(d, axis=1)
        near[begin : begin + step] = d[np.arange(len(d)), some]
    return own, near


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return nearest_distances(x, c)[0]


def fit(x: np.ndarray, k: int, iterations: int = 20, seed: int = 42) -> np.ndarray:
    """k centroids of the rows of x; an empty cluster restarts at the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float64)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(iterations):
        own, near = nearest_distances(x, c)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        new = sums / np.maximum(counts, 1)[:, None]
        if (empty := np.flatnonzero(counts == 0)).size:
            new[empty] = x[np.argsort(-near, kind="stable")[: empty.size]]
        if np.array_equal(new, c):
            break
        c = new
    return c


def sample(base: DataFrame, id: str, vector: str, rows: int = SAMPLE) -> np.ndarray:
    """Up to `rows` vectors, those whose ids have the smallest hashes."""
    found = base.select(id, vector).orderBy(F.xxhash64(id), id).limit(rows).select(vector).collect()
    return np.array([r[0] for r in found], np.float64)


def assign(base: DataFrame, centroids: np.ndarray, vector: str = "vector", name: str = "cell") -> DataFrame:
    """All columns of base and the number of the nearest centroid; equal distances go to the first."""
    shared = base.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))
    kept = base.select(*[c for c in base.columns if c != name])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{name}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = nearest_centroid(matrix(batch.column(vector)), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def update(assigned: DataFrame, by: str = "cell", vector: str = "vector") -> DataFrame:
    """(by, dim, mean): the mean of each component in each group."""
    each = assigned.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    return each.groupBy(by, "dim").agg(F.avg("x").alias("mean"))


def centroid_arrays(means: DataFrame, by: str = "cell") -> DataFrame:
    """(by, centroid) from (by, dim, mean)."""
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda p: p["mean"]).alias("centroid"))
