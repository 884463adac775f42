"""Approximate search over k-means cells.

Vectors are stored in order of their cell, so a scan of a few cells skips the row groups of all others.  A
query's budget `ef` is the number of candidates it wants: cells are probed in order of their centroids'
distance until they hold `oversample * ef` live rows, and k at least.  How many rows a unit of budget must
stand for depends on the data, so `tune` measures it on sample queries.  Filters and tombstones apply to the
candidates of the probed cells.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators import kmeans
from nearfield.operators.topk import PAGE, top_k, top_k_batch

#: Candidates for each unit of budget, where nothing was measured.
OVERSAMPLE = 8
#: Budgets' candidates that `tune` tries first (it goes on doubling), recall it wants, and queries it measures on.
TRIED = (1, 2, 4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512, 1024)
TARGET = 0.95
LEARN_QUERIES = 64
#: Cells at most, so that centroids fit a broadcast and can be fitted on a sample; from 268 million rows on, cells grow instead.
CELLS = 65_536
#: Distances to centroids computed at a time, and nearest cells looked at first.
MATRIX = 1 << 23
LOOK = 64


@dataclass
class Cells:
    """Centroids, and the live rows in each cell."""

    centroids: np.ndarray
    counts: np.ndarray
    oversample: int = OVERSAMPLE

    def ranked(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(kmeans.squared(q[None, :], self.centroids)[0], kind="stable")

    def probes(self, q: np.ndarray, ef: int, k: int, oversample: int | None = None) -> list[np.ndarray]:
        """The cells of each query (a row of q) for a budget, nearest first."""
        wanted, found = max((oversample or self.oversample) * ef, k), []
        step = max(1, MATRIX // len(self.centroids))
        for begin in range(0, len(q), step):
            d = kmeans.squared(q[begin : begin + step], self.centroids)
            own: list = [None] * len(d)
            going, look = np.arange(len(d)), min(LOOK, d.shape[1])
            while len(going):
                near = np.argpartition(d[going], look - 1, axis=1)[:, :look]
                near = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(d[going], near, 1)), axis=1), 1)
                held = np.cumsum(self.counts[near], axis=1)
                done = (held[:, -1] >= wanted) | (look == d.shape[1])
                for i in np.flatnonzero(done).tolist():
                    own[going[i]] = near[i, : int(np.searchsorted(held[i], wanted, side="left")) + 1]
                going, look = going[~done], min(4 * look, d.shape[1])
            found += own
        return found

    def probe(self, q: np.ndarray, ef: int, k: int, oversample: int | None = None) -> list[int]:
        """The cells for a budget, nearest first."""
        return self.probes(q[None, :], ef, k, oversample)[0].tolist()

    def first(self, q: np.ndarray, n: int) -> list[int]:
        return [int(c) for c in self.ranked(q)[:n]]


def cell_number(rows: int, most: int = CELLS) -> int:
    """About the square root of the rows, four times over, but no more than `most`."""
    return max(1, min(most, int(4 * np.sqrt(rows))))


def build(base: DataFrame, id: str = "id", vector: str = "vector", cells: int | None = None, seed: int = 42, iterations: int = 20, partitions: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(base with its cell, in order of cells; centroids fitted on a bounded sample)."""
    centroids = kmeans.fit(kmeans.sample(base, id, vector), cells or cell_number(base.count()), iterations, seed)
    assigned = kmeans.assign(base, centroids, vector)
    ordered = assigned.repartitionByRange(*([partitions] if partitions else []), "cell").sortWithinPartitions("cell", id)
    return ordered, centroids


def cells_of(assigned: DataFrame, centroids: np.ndarray) -> Cells:
    """The cells' row counts, one number a cell."""
    counts = np.zeros(len(centroids), np.int64)
    for row in assigned.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]
    return Cells(centroids, counts)


def tune(assigned: DataFrame, cells: Cells, k: int = 10, ef: int = 64, target: float = TARGET, id: str = "id", vector: str = "vector") -> int:
    """The smallest oversampling with which sample queries reach the target recall on average; also set on `cells`.

    The queries are vectors of the collection itself, those whose ids hash lowest.
    """
    rows = assigned.orderBy(F.xxhash64(id), id).limit(LEARN_QUERIES).select(vector).collect()
    frame = assigned.sparkSession.createDataFrame([(i, [float(x) for x in r[0]]) for i, r in enumerate(rows)], "qid long, qv array<double>")
    keyed = assigned.select(F.xxhash64(id).alias("key"), vector, "cell")
    truth: dict[int, list[int]] = {}
    for r in top_k_batch(keyed, frame, k, "key", vector).join(keyed.select("key", "cell"), "key").select("qid", "cell").collect():
        truth.setdefault(r.qid, []).append(r.cell)
    # The last step of all takes every cell, which is exact.
    x = np.array([r[0] for r in rows], np.float64)
    for tried in chain(TRIED, (TRIED[-1] << i for i in count(1))):
        probes = cells.probes(x, ef, k, tried) if len(x) else []
        found = [np.isin(own, probes[i]).mean() for i, own in truth.items()]
        if not found or np.mean(found) >= target or tried * ef >= cells.counts.sum():
            break
    cells.oversample = tried
    return tried


def search(assigned: DataFrame, cells: Cells, query: list[float], k: int, ef: int, predicate: Column | None = None, id: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest rows in the probed cells that satisfy the predicate."""
    near = assigned.where(F.col("cell").isin(cells.probe(np.asarray(query, np.float64), ef, k)))
    return top_k(near if predicate is None else near.where(predicate), query, k, id, vector)


def search_batch(assigned: DataFrame, cells: Cells, queries: DataFrame, k: int, ef: int, id: str = "id", vector: str = "vector", page: int = PAGE) -> DataFrame:
    """(qid, rank, id, distance) for every query, each over its own cells; cells that no query of a page probes are skipped.

    Probes are chosen a page of queries at a time.
    """

    def visitors(q: np.ndarray) -> dict[int, np.ndarray]:
        probes = cells.probes(q, ef, k)
        numbers, own = np.repeat(np.arange(len(q)), [len(p) for p in probes]), np.concatenate(probes)
        order = np.argsort(own, kind="stable")
        own, numbers = own[order], numbers[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        return dict(zip(own[first].tolist(), np.split(numbers, first[1:]), strict=True))

    return top_k_batch(assigned, queries, k, id, vector, page=page, by="cell", groups=visitors)
