"""Product quantization: codebooks, codes, table-lookup distances, re-ranking.

A code is one byte for each of m subspaces, kept as a binary column.  Codebooks are fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.errors import InvalidArgument
from nearfield.operators import ivf, kmeans
from nearfield.operators.topk import KEPT, matrix, pages, ranked, rerank, top_k_batch

#: Centroids in a codebook: as many as a byte tells apart.
KSUB = 256


def check_split(dim: int, m: int) -> None:
    if m <= 0 or dim % m:
        raise InvalidArgument(f"{dim} dimensions do not split into {m} subspaces")


def train(x: np.ndarray, m: int, iterations: int = 20, seed: int = 42) -> np.ndarray:
    """Codebooks (m, 256, dim / m); subspace j is seeded with seed + j."""
    check_split(x.shape[1], m)
    if len(x) < KSUB:
        raise InvalidArgument(f"{KSUB} vectors are needed, there are {len(x)}")
    return np.stack([kmeans.fit(part, KSUB, iterations, seed + j) for j, part in enumerate(np.split(np.asarray(x, np.float64), m, axis=1))])


def codes_of(x: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """(n, m) bytes."""
    return np.stack([kmeans.nearest_centroid(part, book) for part, book in zip(np.split(x, len(codebooks), axis=1), codebooks, strict=True)], axis=1).astype(np.uint8)


def decode(codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    return np.concatenate([book[c] for c, book in zip(codes.T, codebooks, strict=True)], axis=1)


def tables(q: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """(queries, m, 256): squared distance of each query's part to each centroid."""
    m, _, width = codebooks.shape
    return ((q.reshape(len(q), m, 1, width) - codebooks[None]) ** 2).sum(axis=3)


def table_distances(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Distance of each code to one query, a subspace at a time (quick where the columns of `codes` are contiguous)."""
    total = np.zeros(len(codes))
    for column, own in zip(codes.T, table, strict=True):
        total += own.take(column)
    return total


def encode(base: DataFrame, codebooks: np.ndarray, vector: str = "vector") -> DataFrame:
    """All columns of base and `code`."""
    shared = base.sparkSession.sparkContext.broadcast(codebooks)
    kept = base.select(*[c for c in base.columns if c != "code"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", code binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = codes_of(matrix(batch.column(vector)), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "code"])

    return kept.mapInArrow(run, schema)


def code_arrays(encoded: DataFrame) -> DataFrame:
    """`code` as an array of integers from 0 to 255."""
    one = lambda i: F.conv(F.hex(F.substring(F.col("code"), i, F.lit(1))), 16, 10).cast("int")
    return encoded.withColumn("code", F.transform(F.sequence(F.lit(1), F.length("code")), one))


def code_matrix(column: pa.Array, m: int) -> np.ndarray:
    """The codes of a column, a row each, laid out by subspace."""
    return np.asfortranarray(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, m))


def nearest_codes(kept: tuple[np.ndarray, np.ndarray], ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest among those kept and more; equal distances by id, in no order."""
    if len(kept[1]) == k:
        some = np.flatnonzero(~(d > kept[1].max()))
        if not len(some):
            return kept
        ids, d = ids[some], d[some]
    ids, d = np.concatenate((kept[0], ids)), np.concatenate((kept[1], d))
    if len(d) > k:
        kth = np.partition(d, k - 1)[k - 1]
        below, equal = (d < kth, d == kth) if kth == kth else (d == d, d != d)
        below, equal = np.flatnonzero(below), np.flatnonzero(equal)
        some = np.concatenate((below, equal[np.argsort(ids[equal], kind="stable")[: k - len(below)]]))
        ids, d = ids[some], d[some]
    return ids, d


def scan(encoded: DataFrame, codebooks: np.ndarray, queries: DataFrame, k: int, id: str = "id", page: int = 256) -> DataFrame:
    """(qid, rank, id, distance): the k nearest codes of every query by table lookup; a task keeps its k nearest a query.

    The deeper the pool, the fewer queries make a page, so a task's memory does not follow k.  Codes are dealt once for
    all pages, in no more parts than give all cores work: each part keeps k a query.
    """
    spark, parts = encoded.sparkSession, None
    m = len(codebooks)
    shared_pages = [spark.sparkContext.broadcast((q_ids, tables(q, codebooks))) for q_ids, q in pages(queries, "qid", "qv", max(1, min(page, KEPT // k)))]
    codes_only = encoded.select(F.col(id).cast("long").alias("id"), "code")
    if shared_pages:
        cores = spark.sparkContext.defaultParallelism
        codes_only = codes_only.repartition(min(cores, -(-4 * cores // len(shared_pages))))
    for shared in shared_pages:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, luts = shared.value
            best = [(np.empty(0, np.int64), np.empty(0))] * len(luts)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, codes = np.asarray(batch.column("id")), code_matrix(batch.column("code"), m)
                best = [nearest_codes(kept, ids, table_distances(codes, lut), k) for kept, lut in zip(best, luts, strict=True)]
            for q_id, (own, d) in zip(q_ids.tolist(), best, strict=True):
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), q_id)), pa.array(own), pa.array(d)], names=["qid", "id", "distance"])

        part = codes_only.mapInArrow(run, "qid long, id long, distance double")
        parts = part if parts is None else parts.union(part)
    if parts is None:
        parts = spark.createDataFrame([], "qid long, id long, distance double")
    return ranked(parts, k).withColumnRenamed("id", id)


def pool(coded: DataFrame, codebooks: np.ndarray, query: np.ndarray, k: int, id: str = "id") -> DataFrame:
    """(id) of the k codes nearest to one query, ids of any kind; a task keeps its k nearest."""
    shared = coded.sparkSession.sparkContext.broadcast(tables(query[None, :], codebooks)[0])
    kind = coded.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, d = None, np.empty(0)
        for batch in batches:
            if batch.num_rows:
                own = batch.column("id") if ids is None else pa.concat_arrays([ids, batch.column("id")])
                d = np.concatenate((d, table_distances(code_matrix(batch.column("code"), len(shared.value)), shared.value)))
                some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                ids, d = own.take(pa.array(some)), d[some]
        if ids is not None:
            yield pa.RecordBatch.from_arrays([ids, pa.array(d)], names=["id", "distance"])

    found = coded.select(F.col(id).alias("id"), "code").mapInArrow(run, f"id {kind}, distance double")
    return found.orderBy("distance", "id").limit(k).select(F.col("id").alias(id))


def tune_depth(encoded: DataFrame, codebooks: np.ndarray, k: int = 10, target: float = ivf.TARGET, id: str = "id", vector: str = "vector") -> int:
    """How many of the nearest codes hold `target` of the true k neighbours of sample queries.

    The queries are vectors of the collection itself, those whose ids hash lowest.  Where each true neighbour stands
    among the codes is counted in one pass over them, so no pool has to be tried.
    """
    spark = encoded.sparkSession
    rows = encoded.orderBy(F.xxhash64(id), id).limit(ivf.LEARN_QUERIES).select(vector).collect()
    x = np.array([r[0] for r in rows], np.float64)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "qid long, qv array<double>")
    keyed = encoded.select(F.xxhash64(id).alias("key"), vector, "code")
    truth = top_k_batch(keyed, frame, k, "key", vector).join(keyed.select("key", "code"), "key").select("qid", "code").collect()
    if not truth:
        return k
    luts = tables(x, codebooks)
    bounds: list[list[float]] = [[] for _ in rows]
    for r in truth:
        bounds[r.qid].append(float(table_distances(np.frombuffer(r.code, np.uint8)[None, :], luts[r.qid])[0]))
    shared = spark.sparkContext.broadcast((luts, [np.sort(b) for b in bounds]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        luts, bounds = shared.value
        nearer = [np.zeros(len(b), np.int64) for b in bounds]
        for batch in batches:
            if batch.num_rows:
                codes = code_matrix(batch.column("code"), luts.shape[1])
                for lut, bound, n in zip(luts, bounds, nearer, strict=True):
                    n += np.searchsorted(np.sort(table_distances(codes, lut)), bound - 1e-9, "right")
        places = np.concatenate([np.arange(len(n)) + (i << 20) for i, n in enumerate(nearer)])
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.concatenate(nearer))], names=["place", "n"])

    ranks = sorted(r.n for r in encoded.select("code").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect())
    return max(k, int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1)


def rerank_depth(k: int, ef: int, factor: int = 2, most: int = 3000) -> int:
    """How many candidates are looked at exactly."""
    return max(k, min(most, factor * ef))


def search(encoded: DataFrame, codebooks: np.ndarray, queries: DataFrame, k: int, ef: int, id: str = "id", vector: str = "vector", factor: int = 2, most: int = 3000, depth: int = 0) -> DataFrame:
    """The k nearest of every query: a pool by codes (of `depth`, as `tune_depth` measures it, at least), then exact distances."""
    found = scan(encoded, codebooks, queries, max(depth, rerank_depth(k, ef, factor, most)), id)
    return rerank(found, encoded, queries, k, id, vector)


def reconstruction_error(encoded: DataFrame, codebooks: np.ndarray, id: str = "id", vector: str = "vector") -> DataFrame:
    """(id, error): squared distance of each vector to what its code stands for."""
    shared = encoded.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                error = ((matrix(batch.column("vector")) - decode(codes, shared.value)) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(error)], names=["id", "error"])

    return encoded.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"), "code").mapInArrow(run, "id long, error double").withColumnRenamed("id", id)
