"""Memory of the tasks of batch searches, and what their bounds could get wrong."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from nearfield.operators import graph, kmeans, pq, topk


def peak(f):
    tracemalloc.start()
    try:
        found = f()
        return found, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def task(monkeypatch, frame, make):
    """The function that `make()` gives to the last mapInArrow of its plan."""
    kept, whole = [], type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, *rest: kept.append(f) or whole(self, f, *rest))
    make()
    monkeypatch.undo()
    return kept[-1]


def batches(x, ids, **more):
    return [pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x.tolist(), pa.list_(pa.float32())), *map(pa.array, more.values())], names=["id", "vector", *more])]


def test_batch_search_memory(spark, monkeypatch):
    """A task's memory is that of its state, whatever the rows of a batch and the queries of a page."""
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(10_000, 8)).astype(np.float32), rng.normal(size=(2000, 8))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(q.tolist())], "qid long, qv array<double>")
    base = spark.createDataFrame([(0, [0.0] * 8)], "id long, vector array<float>")
    run = task(monkeypatch, base, lambda: topk.top_k_batch(base, frame, 5))
    some = batches(x, np.arange(10_000))
    found, mb = peak(lambda: [b.to_pydict() for b in run(iter(some))])
    assert mb < 60
    got = sorted(zip(found[0]["qid"], found[0]["distance"], found[0]["id"], strict=True))
    for i in (0, 1999):
        d = ((x.astype(np.float64) - q[i]) ** 2).sum(axis=1)
        assert [r[2] for r in got[5 * i : 5 * i + 5]] == np.lexsort((np.arange(10_000), d))[:5].tolist()


def test_assignment_memory():
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(10_000, 8)), rng.normal(size=(3000, 8))
    found, mb = peak(lambda: kmeans.nearest_centroid(x, c))
    assert mb < 60
    assert np.array_equal(found[:100], ((x[:100, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1))


@pytest.mark.parametrize("kind", ["equal", "near", "large", "huge", "tiny", "offset", "one far", "nan", "few"])
def test_nearest(kind, monkeypatch):
    """Exact at any scale, with ties by id, over many small steps."""
    rng = np.random.default_rng(7)
    x, q, k = rng.normal(size=(600, 6)), rng.normal(size=(37, 6)), 9
    if kind == "equal":
        x[50:500] = q[:5] = x[3]
    elif kind == "near":
        x = q[rng.integers(0, 37, 600)] + rng.normal(size=(600, 6)) * 1e-9
    elif kind in ("large", "huge", "tiny"):
        scale = {"large": 1e12, "huge": 1e30, "tiny": 1e-25}[kind]
        x, q = x * scale, q * scale
    elif kind == "offset":
        x, q = x * 1e-3 + 1000, q * 1e-3 + 1000
    elif kind == "one far":
        x[0] = 1e9
    elif kind == "nan":
        x[5:] = np.nan
    elif kind == "few":
        x = x[:4]
    ids = rng.permutation(len(x)) + 100
    monkeypatch.setattr(topk, "TILE", 1000)
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "PAIRS", 300)
    allowed = rng.random((len(x), len(q))) < 0.5
    for mask in (None, allowed):
        best = topk.Nearest(q, k)
        for begin in range(0, len(x), 170):
            part = slice(begin, begin + 170)
            best.add(x[part], ids[part], None, None if mask is None else mask[part])
        row, own, d = best.found()
        for j in range(len(q)):
            some = np.arange(len(x)) if mask is None else np.flatnonzero(mask[:, j])
            exact = topk.direct(x[some], q[j])
            first = np.lexsort((ids[some], exact))[:k]
            assert own[row == j].tolist() == ids[some][first].tolist()
            assert np.array_equal(d[row == j], exact[first], equal_nan=True)


def test_graph_pages(spark):
    """All rows are queries of the graph: they fill few pages, and the rows are dealt to all cores although one file has them."""
    x = np.random.default_rng(1).normal(size=(5000, 2))
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "id long, vector array<double>").coalesce(1)
    edges = graph.knn_graph(frame, 2)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Repartition 4" in plan
    got = {(r.src, r["rank"]): r.dst for r in edges.where("src % 500 = 0").collect()}
    for i in range(0, 5000, 500):
        near = ((x - x[i]) ** 2).sum(axis=1)
        near[i] = np.inf
        assert [got[i, 1], got[i, 2]] == np.argsort(near)[:2].tolist()


def test_prune_streams(spark):
    """A node's candidates are not gathered with their vectors, and may fill several batches."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    x[:20] = x[0] + rng.normal(size=(20, 3)) * 0.01
    base = spark.createDataFrame(list(enumerate(x.tolist())), "id long, vector array<double>")
    pairs = {i: [j for j in range(60) if i != j and (i < 3 or (i * j) % 7 == 1)] for i in range(60)}
    edges = spark.createDataFrame([(i, j, float(((x[i] - x[j]) ** 2).sum())) for i, some in pairs.items() for j in some], "src long, dst long, distance double").repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        thinned = graph.prune(edges, base, 4)
        assert "collect_list" not in thinned._jdf.queryExecution().optimizedPlan().toString()
        got = {}
        for r in thinned.collect():
            got.setdefault(r.src, []).append((r.distance, r.dst))
    finally:
        spark.conf.set(name, before)
    for i, some in pairs.items():
        near = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in some)
        kept = []
        for d, j in near:
            if len(near) < 4 or len(kept) < 4 and all(((x[j] - x[o]) ** 2).sum() > d for _, o in kept):
                kept.append((d, j))
        assert sorted(got.get(i, [])) == kept


def test_code_scan_memory(spark, monkeypatch):
    """A deep pool of many queries: a task holds what it keeps and little besides; equal distances go by id."""
    rng = np.random.default_rng(0)
    books, k = rng.integers(0, 4, (2, 256, 2)).astype(np.float64), 3000
    codes, q = rng.integers(0, 256, (30_000, 2)).astype(np.uint8), rng.normal(size=(256, 4))
    ids = rng.permutation(30_000)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(q.tolist())], "qid long, qv array<double>")
    encoded = spark.createDataFrame([(0, b"00")], "id long, code binary")
    run = task(monkeypatch, encoded, lambda: pq.scan(encoded, books, frame, k))
    some = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 10_000]), pa.array([c.tobytes() for c in codes[i : i + 10_000]], pa.binary())], names=["id", "code"]) for i in range(0, 30_000, 10_000)]
    found, mb = peak(lambda: {b.column("qid")[0].as_py(): set(b.column("id").to_pylist()) for b in run(iter(some)) if b.column("qid")[0].as_py() in (0, 255)})
    assert mb < 40
    for i in (0, 255):
        d = pq.table_distances(codes, pq.tables(q, books)[i])
        assert found[i] == set(ids[np.lexsort((ids, d))[:k]].tolist())
