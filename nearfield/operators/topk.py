"""Exact top-k nearest-neighbour search.

One query is an expression over the scan and a TakeOrderedAndProject.  Many queries go in pages of bounded
size to the executors, where each Arrow batch of vectors meets all of them in matrix products of bounded size;
a task keeps its k nearest a query, so what is shuffled is k rows for each task and query, and a window ranks those.
The products are of single precision and less the most that rounding can add, so they only rule rows out: what
may be nearer than the k-th so far is taken directly, in doubles.

Equal distances go to the smaller id, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.vector import l2_distance

#: Queries sent to the executors at a time, where each has its own list of groups or rows.
PAGE = 4096
#: Other queries sent at a time, and their components at most (16 MB); neighbours kept at a time in a task.
WIDE = 1 << 15
COMPONENTS = 1 << 21
KEPT = 1 << 20
#: Distances computed at a time, rows among them at least, and components of pairs taken directly at a time.
TILE = 1 << 20
ROWS = 1024
PAIRS = 1 << 20
#: The id of a place that no row has taken.
FREE = np.iinfo(np.int64).max


def literal_vector(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def distances(base: DataFrame, query: list[float], vector: str = "vector") -> DataFrame:
    """`base` with the squared distance of each row to the query."""
    return base.withColumn("distance", l2_distance(F.col(vector), literal_vector(query)))


def top_k(base: DataFrame, query: list[float], k: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest rows, nearest first; all of them if there are fewer."""
    return distances(base, query, vector).orderBy("distance", id).limit(k)


def top_k_subset(base: DataFrame, ids: DataFrame, query: list[float], k: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest among the rows whose id is listed."""
    return top_k(base.join(ids.select(id).distinct(), id, "left_semi"), query, k, id, vector)


def top_k_alive(base: DataFrame, dead: DataFrame, query: list[float], k: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest among the rows whose id is not listed."""
    return top_k(base.join(dead.select(id), id, "left_anti"), query, k, id, vector)


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long arrays as rows of doubles."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (qid, qv) as few rows of bytes."""
    for batch in batches:
        q = matrix(batch.column("qv")) if batch.num_rows else np.empty((0, 1))
        step = max(1, PAIRS // max(1, q.shape[1]))
        for begin in range(0, len(q), step):
            ids = np.asarray(batch.column("qid"))[begin : begin + step]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, q[begin : begin + step])], names=["ids", "vectors"])


def pages(queries: DataFrame, qid: str, qv: str, size: int = PAGE, components: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries in pages (ids, vectors) in order of id, of so many queries and components at most: sorted once, then a partition of them at a time on the driver."""
    rows = queries.select(F.col(qid).cast("long").alias("qid"), F.col(qv).alias("qv")).orderBy("qid").mapInArrow(packed, "ids binary, vectors binary")
    ids, q = np.empty(0, np.int64), np.empty((0, 0))
    for row in rows.toLocalIterator():
        own = np.frombuffer(row.ids, np.int64)
        more = np.frombuffer(row.vectors, np.float64).reshape(len(own), -1)
        ids, q = (np.concatenate((ids, own)), np.concatenate((q, more))) if len(ids) else (own, more)
        most = max(1, min(size, components // max(1, q.shape[1]) if components else size))
        while len(ids) >= most:
            yield ids[:most].copy(), q[:most].copy()
            ids, q = ids[most:], q[most:]
    if len(ids):
        yield ids.copy(), q.copy()


def direct(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to the same rows of q."""
    return ((x - q) ** 2).sum(axis=1)


class Nearest:
    """The k nearest rows so far of each query (a row of q), by direct distance, then id; memory does not follow the rows seen."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k, self.qq = q, k, (q * q).sum(axis=1)
        self.d, self.ids = np.full((len(q), k), np.nan), np.full((len(q), k), FREE)

    def add(self, x: np.ndarray, ids: np.ndarray, numbers: np.ndarray | None = None, allowed: np.ndarray | None = None) -> None:
        """Let the queries of these numbers (all of them, if not given) see rows, each those that `allowed` (rows, queries) has."""
        numbers, xx = np.arange(len(self.q)) if numbers is None else numbers, (x * x).sum(axis=1)
        kind = np.float32 if xx.max(initial=0) < 1e30 and self.qq.max(initial=0) < 1e30 else np.float64
        # What all roundings of a product can come to, as a share of |x|^2 + |q|^2.
        share = (x.shape[1] + 16) * float(np.finfo(kind).eps)
        left = np.concatenate((-2 * x, ((1 - 2 * share) * xx)[:, None]), axis=1).astype(kind)
        rows = max(ROWS, 8 * self.k)
        wide = max(1, TILE // min(rows, max(1, len(x))))
        for first in range(0, len(numbers), wide):
            some = numbers[first : first + wide]
            right = np.concatenate((self.q[some], np.ones((len(some), 1))), axis=1).astype(kind)
            for begin in range(0, len(x), rows):
                part = slice(begin, begin + rows)
                self.tile(right @ left[part].T, share, xx[part], x[part], ids[part], some, None if allowed is None else allowed[part, first : first + wide].T)

    def tile(self, low: np.ndarray, share: float, xx: np.ndarray, x: np.ndarray, ids: np.ndarray, some: np.ndarray, allowed: np.ndarray | None) -> None:
        """`low` (queries, rows) is less than the distance without |q|^2, by no more than the share."""
        qq, free = self.qq[some], self.ids[some, -1] == FREE
        if allowed is not None:
            low = np.where(allowed, low, np.inf)
        # The k-th distance so far; where there is none yet, what it can be after these rows.
        most = np.where(free, np.inf, self.d[some, -1]) - qq
        if free.any() and len(x) > self.k:
            most[free] = np.partition(low[free], self.k - 1, axis=1)[:, self.k - 1] + 4 * share * xx.max() + share * qq[free]
        most += share * (np.abs(most) + 2 * qq) + 1e-30
        hit = ~(low > most.astype(low.dtype)[:, None])
        if allowed is not None:
            hit &= allowed
        at, step = np.flatnonzero(hit), max(1, PAIRS // max(1, x.shape[1]))
        for begin in range(0, len(at), step):
            row, col = np.divmod(at[begin : begin + step], len(x))
            own, found = some[row], ids[col]
            d, last, last_id = direct(x[col], self.q[own]), self.d[own, -1], self.ids[own, -1]
            better = ~(d >= last) & ((d == d) | (found < last_id)) | (found < last_id) & (d == last)
            self.merge(own[better], found[better], d[better])

    def merge(self, own: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        numbers, row = np.unique(own, return_inverse=True)
        row = np.concatenate((np.repeat(np.arange(len(numbers)), self.k), row))
        ids, d = np.concatenate((self.ids[numbers].ravel(), ids)), np.concatenate((self.d[numbers].ravel(), d))
        order = np.lexsort((ids, d, row))
        row = row[order]
        keep = order[np.arange(len(row)) - np.searchsorted(row, row, side="left") < self.k]
        self.ids[numbers], self.d[numbers] = ids[keep].reshape(-1, self.k), d[keep].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, id, distance)."""
        row, place = np.nonzero(self.ids != FREE)
        return row, self.ids[row, place], self.d[row, place]


def by_value(values: np.ndarray, visitors: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each value that queries look at, and those queries."""
    order = np.argsort(values, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
        if (numbers := visitors.get(int(values[some[0]]))) is not None:
            yield some, numbers


def ranked(candidates: DataFrame, k: int, id: str = "id") -> DataFrame:
    """The k nearest of each query among candidates (qid, id, distance), with their rank from 1."""
    order = Window.partitionBy("qid").orderBy("distance", id)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", id, "distance")


def top_k_batch(base: DataFrame, queries: DataFrame, k: int, id: str = "id", vector: str = "vector", qid: str = "qid", qv: str = "qv", page: int | None = None, mask: Callable | None = None, by: str | None = None, groups: Callable | None = None, extra: tuple[str, ...] = (), spread: bool = False) -> DataFrame:
    """(qid, rank, id, distance): the k nearest rows of `base` (id: a long) for every query.

    `mask(batch, query ids)`, if given, says which rows (of a batch that also has the columns `extra`) are
    candidates of which queries, as a matrix of booleans.  `groups(vectors)`, if given, is asked on the driver for each
    page of queries: a dictionary from values of the column `by` to the numbers of the queries that look at rows
    of that value.  Rows of other values are not read, and each group is one matrix product.  `spread`, for queries as
    many as the rows: these are dealt so that all cores have work, in no more parts than that takes.
    """
    spark, parts = base.sparkSession, None
    scan = base.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"), *([by] if by else []), *extra)
    size = min(page or (PAGE if mask or groups else WIDE), max(1, KEPT // k))
    shared_pages = []
    for q_ids, q in pages(queries, qid, qv, size, COMPONENTS):
        visitors = groups(q) if groups else None
        shared_pages.append((spark.sparkContext.broadcast((q_ids, q, visitors)), None if visitors is None else sorted(visitors)))
    if spread and shared_pages:
        cores = spark.sparkContext.defaultParallelism
        scan = scan.repartition(min(cores, -(-4 * cores // len(shared_pages))))
    for shared, wanted in shared_pages:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q, visitors = shared.value
            best = Nearest(q, k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, ids = matrix(batch.column("vector")), np.asarray(batch.column("id"))
                if visitors is not None:
                    for some, numbers in by_value(np.asarray(batch.column(by)), visitors):
                        best.add(x[some], ids[some], numbers)
                else:
                    best.add(x, ids, allowed=mask(batch, q_ids) if mask else None)
            row, own, d = best.found()
            for begin in range(0, len(row), KEPT):
                part = slice(begin, begin + KEPT)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row[part]]), pa.array(own[part]), pa.array(d[part])], names=["qid", "id", "distance"])

        rows = scan if wanted is None else scan.where(F.col(by).isin(wanted))
        part = rows.mapInArrow(run, "qid long, id long, distance double")
        parts = part if parts is None else parts.union(part)
    if parts is None:
        parts = spark.createDataFrame([], "qid long, id long, distance double")
    return ranked(parts, k).withColumnRenamed("id", id)


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, id: str = "id", vector: str = "vector", qv: str = "qv") -> DataFrame:
    """The k nearest of the candidates (qid, id), by exact distance."""
    scored = candidates.select("qid", id).join(base.select(id, vector), id).join(queries.select("qid", qv), "qid")
    return ranked(scored.select("qid", id, l2_distance(F.col(vector), F.col(qv)).alias("distance")), k, id)


def with_attributes(hits: DataFrame, records: DataFrame, id: str = "id") -> DataFrame:
    """Hits with the records' columns: late, on the few rows that are left."""
    return hits.join(records, id)
