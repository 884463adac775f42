"""Proximity graphs: neighbour lists by exact search, pruned and completed with reverse edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.topk import matrix, top_k_batch


def knn_graph(base: DataFrame, m: int, id: str = "id", vector: str = "vector", page: int | None = None) -> DataFrame:
    """(src, rank, dst, distance): the m nearest others of every row."""
    queries = base.select(F.col(id).alias("qid"), F.col(vector).alias("qv"))
    near = top_k_batch(base, queries, m + 1, id, vector, page=page, spread=True).where(F.col("qid") != F.col(id))
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return near.select(F.col("qid").alias("src"), F.col(id).alias("dst"), "distance").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m).select("src", "rank", "dst", "distance")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """(dst, sources): who points to each node, in ascending order."""
    return edges.groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("sources"))


class Thinned:
    """Up to m of the candidates of a node, which come nearest first: each nearer to the node than to any kept before it; all of them if fewer than m come."""

    def __init__(self, m: int):
        self.m, self.seen, self.first, self.kept, self.vectors = m, 0, [], [], None

    def add(self, labels: np.ndarray, distances: np.ndarray, vectors: np.ndarray) -> None:
        if not self.seen:
            self.vectors = np.empty((self.m, vectors.shape[1]))
        self.first += zip(labels[: max(0, self.m - self.seen)].tolist(), distances.tolist(), strict=False)
        self.seen += len(labels)
        for label, d, v in zip(labels.tolist(), distances.tolist(), vectors, strict=True):
            n = len(self.kept)
            if n == self.m:
                break
            if not n or (((v - self.vectors[:n]) ** 2).sum(axis=1) > d).all():
                self.vectors[n] = v
                self.kept.append((label, d))

    def edges(self) -> list[tuple[int, float]]:
        return self.first if self.seen < self.m else self.kept


def diverse(base: np.ndarray, candidates: np.ndarray, distances: np.ndarray, m: int) -> list[int]:
    """Positions of up to m candidates, nearest first, each nearer to the base than to any kept before it.

    If there are fewer than m candidates, all are kept.
    """
    if len(candidates) < m:
        return list(range(len(candidates)))
    order, thinned = np.argsort(distances, kind="stable"), Thinned(m)
    thinned.add(order, distances[order], candidates[order])
    return [i for i, _ in thinned.edges()]


def prune(edges: DataFrame, base: DataFrame, m: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """(src, dst, distance): each node's edges thinned to m diverse ones.

    A node's candidates come in order of distance, in as many batches as they fill, and only what is kept is held.
    """
    ends = edges.join(base.select(F.col(id).alias("dst"), F.col(vector).alias("v")), "dst").select(F.col("src").cast("long"), F.col("dst").cast("long"), "distance", "v")
    lists = ends.repartition("src").sortWithinPartitions("src", "distance", "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ended: list[tuple[int, Thinned]]) -> pa.RecordBatch:
            found = [(src, dst, d) for src, thinned in ended for dst, d in thinned.edges()]
            columns = zip(*found, strict=True) if found else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["src", "dst", "distance"])

        nodes: list[tuple[int, Thinned]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            src, dst, d = (np.asarray(batch.column(c)) for c in ("src", "dst", "distance"))
            v, cuts = matrix(batch.column("v")), np.flatnonzero(np.diff(src)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(src)], strict=True):
                if not nodes or nodes[-1][0] != src[begin]:
                    if nodes:
                        nodes[-1][1].vectors = None
                    nodes.append((int(src[begin]), Thinned(m)))
                nodes[-1][1].add(dst[begin:end], d[begin:end], v[begin:end])
            # The last node may go on in the next batch.
            yield rows(nodes[:-1])
            del nodes[:-1]
        yield rows(nodes)

    return lists.mapInArrow(run, "src long, dst long, distance double")


def proximity_graph(base: DataFrame, m: int, candidates: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """Pruned nearest-neighbour edges with their reverses, 2 m a node at most: a layer-0 graph."""
    forward = prune(knn_graph(base, candidates, id, vector), base, m, id, vector)
    ways = F.explode(F.array(F.struct("src", "dst", "distance"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")))
    both = forward.select(ways.alias("e")).select("e.*").dropDuplicates(["src", "dst"])
    return prune(both, base, 2 * m, id, vector)
