"""Exact top-k inner-product search with block-at-a-time pruning.

Components become integers, floor(256 x).  Vectors are stored as rows of blocks: a range of vectors with their
block forward index (the matrix of their components) and each component's largest and smallest value in the
block.  Queries run in batches of bounded size over all blocks; a batch's result is written before the next batch
is collected, so the plan and the driver's memory stay the same however many there are.  A task lays its blocks' summed component
bounds out per query, takes each query's blocks in descending order of bound, scores them through the forward
index, and stops when the next bound is below the k-th score so far.  The tasks' best k per query are merged
by a ranking per query.

Vectors are ordered by their nearest pivot, some ten thousand at a time, before they are cut into blocks, which
tightens the bounds; results do not depend on the order.  How much is pruned depends on the data: vectors that form
clusters lose most blocks, independent components in 64 dimensions none.

Edge cases: vectors that are null, or hold a null or a non-finite component, take no part; vectors of another
length than the query's are no candidates; equal scores go to the smaller vec_id; fewer than k candidates are
all returned; repeated ids are candidates of their own but for the query's id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import materialize, scratch

#: Vectors in a block: in clusters, blocks of 64 are scored for a fifth of what blocks of 256 are for three fifths.
BLOCK = 64
#: Bytes of a block's forward index, and of the vectors that are ordered together, at most (but for longer vectors).
BLOCK_BYTES = 1 << 17
ORDERED_BYTES = 1 << 23
#: Queries whose vectors are sent to the executors at a time.
QUERY_BATCH = 8192
PIVOTS = 64


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): the usable vectors, with components floor(256 x) as doubles (exact)."""
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = embeddings.where(F.col("vec_id").isNotNull() & usable)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, x -> floor(cast(x as double) * 256D))").cast("array<double>").alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


def ordered(x: np.ndarray) -> np.ndarray:
    """An order that brings similar vectors together: by the nearest of some of them."""
    pivots = x[:: max(1, len(x) // PIVOTS)][:PIVOTS]
    return np.argsort(np.argmax(x @ pivots.T - 0.5 * (pivots * pivots).sum(axis=1), axis=1), kind="stable")


def blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(dim, ids, forward, upper, lower): vectors of one length a row, written to the shared folder."""
    schema = "dim int, ids binary, forward binary, upper binary, lower binary"

    def rows(dim: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
        order, size = ordered(x), max(1, min(block, BLOCK_BYTES // max(1, 8 * dim)))
        cut = [(dim, ids[own].tobytes(), x[own].tobytes(), x[own].max(axis=0).tobytes(), x[own].min(axis=0).tobytes()) for i in range(0, len(order), size) for own in [order[i : i + size]]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["dim", "ids", "forward", "upper", "lower"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch.column("x")))
            for dim in np.unique(lengths).tolist():
                some = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                held.setdefault(dim, []).append((np.asarray(some.column("vec_id")), matrix(some.column("x"), dim)))
            if sum(x.nbytes for own in held.values() for _, x in own) > ORDERED_BYTES:
                yield from (rows(dim, own) for dim, own in held.items())
                held = {}
        yield from (rows(dim, own) for dim, own in held.items())

    return materialize(vectors.mapInArrow(cut, schema), "blocks")


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles, as 64-bit integers: by BLAS where doubles are exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if most < 2.0**53:
        return (x @ q.T).astype(np.int64)
    if most < 2.0**63:
        return x.astype(np.int64) @ q.astype(np.int64).T
    exact = np.array([[int(v) for v in row] for row in x], dtype=object) @ np.array([[int(v) for v in row] for row in q], dtype=object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k] if len(scores) <= 4 * k else None
    if order is None:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        order = some[np.lexsort((ids[some], -scores[some]))[:k]]
    return scores[order], ids[order]


def search_batch(stored: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[DataFrame, Broadcast]:
    """(query_id, vec_id, score), the best k of each task for each query of a batch, and the broadcast it reads."""
    shared = stored.sparkSession.sparkContext.broadcast((q_ids, q))
    dim = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        high, low = np.maximum(q, 0), np.minimum(q, 0)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q_ids]
        kth = np.full(len(q_ids), -np.inf)
        for batch in batches:
            rows = batch.to_pylist()
            upper, lower = (np.stack([np.frombuffer(r[c]) for r in rows]) for c in ("upper", "lower"))
            # Of exact integers up to 2^53; beyond that a little is added for rounding.
            bounds = upper @ high.T + lower @ low.T
            bounds += np.abs(bounds) * 1e-12
            order = np.argsort(-bounds, axis=0, kind="stable")
            ids = [np.frombuffer(r["ids"], np.int64) for r in rows]
            forward = [np.frombuffer(r["forward"]).reshape(len(own), dim) for r, own in zip(rows, ids, strict=True)]
            going = np.ones(len(q_ids), bool)
            for at in order:
                going &= bounds[at, np.arange(len(q_ids))] >= kth
                if not going.any():
                    break
                for b in np.unique(at[going]).tolist():
                    mine = np.flatnonzero(going & (at == b))
                    scores = products(forward[b], q[mine])
                    for col, j in enumerate(mine.tolist()):
                        keep = ids[b] != q_ids[j]
                        s, i = (scores[:, col], ids[b]) if keep.all() else (scores[keep, col], ids[b][keep])
                        floor = found[j][0][-1] if len(found[j][0]) == k else None
                        if floor is not None:
                            some = s >= floor
                            s, i = s[some], i[some]
                        if len(s):
                            found[j] = best(np.concatenate((found[j][0], s)), np.concatenate((found[j][1], i)), k)
                            if len(found[j][0]) == k:
                                kth[j] = found[j][0][-1]
        sizes = [len(s) for s, _ in found]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate([i for _, i in found])), pa.array(np.concatenate([s for s, _ in found]))], names=["query_id", "vec_id", "score"])

    return stored.where(F.col("dim") == dim).select("ids", "forward", "upper", "lower").mapInArrow(run, "query_id long, vec_id long, score long"), shared


def top_k(embeddings: DataFrame, is_query, k: int = 5, query_batch: int = QUERY_BATCH, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `is_query` holds the k best of all other rows."""
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings)
    stored = blocks(vectors, block)
    queries = materialize(vectors.where(is_query).dropDuplicates(["vec_id"]).withColumn("dim", F.size("x")).sort("dim", "vec_id"), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    schema = "query_id long, vec_id long, score long, rank int"
    path, written, parts, after = scratch(spark, "found"), False, [], None
    while True:  # a batch at a time reaches the driver, in order of (dim, vec_id)
        rest = queries if after is None else queries.where(F.struct("dim", "vec_id") > F.struct(F.lit(after[0]), F.lit(after[1]).cast("long")))
        rows = rest.orderBy("dim", "vec_id").limit(query_batch).collect()
        parts = []
        for dim in sorted({r.dim for r in rows}):
            own = [r for r in rows if r.dim == dim]
            part, shared = search_batch(stored, np.array([r.vec_id for r in own], np.int64), np.array([r.x for r in own], np.float64).reshape(len(own), dim), k)
            if len(rows) < query_batch:
                parts.append(first(part))
            else:
                first(part).write.mode("append").parquet(path)
                shared.destroy()
                written = True
        if len(rows) < query_batch:
            break
        after = (rows[-1].dim, rows[-1].vec_id)
    if written:
        parts.append(spark.read.schema(schema).parquet(path))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(x) AS c, unnest(range(len(x))) AS d FROM v),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(sum(q.c * p.c) AS BIGINT) AS score
  FROM e q JOIN e p ON q.d = p.d AND q.vec_id <> p.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
