import tarfile
import time

import numpy as np
import pyarrow as pa
import pytest

from nearfield.errors import InvalidArgument
from nearfield.functions.vector import adc_distance, cosine_similarity, is_vector, l2_distance, l2_normalize
from nearfield.operators import graph, ivf, kmeans, metrics, pq, topk
from nearfield.plans.planner import Planner, compare, filtered_search
from nearfield.sources import vecs
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def base(spark, clustered):
    return vecs.from_numpy(spark, clustered).withColumnRenamed("row", "id").repartition(4).persist()


@pytest.fixture(scope="module")
def queries(spark, clustered):
    rng = np.random.default_rng(1)
    q = clustered[:40] + rng.normal(size=(40, 16)).astype(np.float32) * 0.1
    return q, vecs.from_numpy(spark, q).withColumnRenamed("row", "qid").withColumnRenamed("vector", "qv").persist()


def exact(x, q, k, some=None):
    ids = np.arange(len(x)) if some is None else some
    d = ((x[ids].astype(np.float64) - q.astype(np.float64)) ** 2).sum(axis=1)
    order = np.lexsort((ids, d))[:k]
    return ids[order].tolist(), d[order]


def lists(df, id="id"):
    found = {}
    for r in df.orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append(r[id])
    return found


def test_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = df.select(l2_distance(F.col("a"), F.col("b")), l2_normalize(F.col("b")), cosine_similarity(F.lit(0.5)), is_vector(F.col("a"), 2), is_vector(F.lit(None).cast("array<float>"), 2)).collect()
    assert got[0][0] == 25 and got[0][1] == [0, 0] and got[0][2] == 0.75 and got[0][3] and not got[0][4]
    assert got[1][0] == 1 and got[1][1] == pytest.approx([5**-0.5, 2 * 5**-0.5])


def test_single_and_batch(spark, base, queries, clustered):
    q, frame = queries
    one = topk.top_k(base, q[0].tolist(), 7).collect()
    ids, d = exact(clustered, q[0], 7)
    assert [r.id for r in one] == ids and [r.distance for r in one] == pytest.approx(d)
    got = lists(topk.top_k_batch(base, frame, 7, page=16))
    assert got == {i: exact(clustered, v, 7)[0] for i, v in enumerate(q)}
    assert "TakeOrderedAndProject" in topk.top_k(base, q[0].tolist(), 7)._jdf.queryExecution().executedPlan().toString()


def test_edges(spark, base, queries, clustered):
    q, frame = queries
    assert topk.top_k(base, q[0].tolist(), 5000).count() == 2000
    assert topk.top_k_batch(base.where("id < 0"), frame, 3).count() == 0
    assert topk.top_k_batch(base, frame.where("qid < 0"), 3).count() == 0
    few = spark.range(0, 2000, 7)
    assert [r.id for r in topk.top_k_subset(base, few, q[1].tolist(), 5).collect()] == exact(clustered, q[1], 5, np.arange(0, 2000, 7))[0]
    alive = np.array([i for i in range(2000) if i % 7])
    assert [r.id for r in topk.top_k_alive(base, few, q[1].tolist(), 5).collect()] == exact(clustered, q[1], 5, alive)[0]
    twins = base.where("id < 5").withColumn("vector", F.lit(q[0].tolist()).cast("array<float>"))
    assert [r.id for r in topk.top_k(twins, q[0].tolist(), 3).collect()] == [0, 1, 2]


def test_cells(spark, base, queries, clustered):
    q, frame = queries
    ordered, centroids = ivf.build(base, cells=40)
    ordered = ordered.persist()
    cells = ivf.cells_of(ordered, centroids)
    assert cells.counts.sum() == 2000
    truth = topk.top_k_batch(base, frame, 10)
    found = ivf.search_batch(ordered, cells, frame, 10, 64)
    assert metrics.recall(found, truth, 10).first().recall >= 0.95
    everything = ivf.search_batch(ordered, cells, frame, 10, 10_000)
    assert lists(everything) == lists(truth)
    one = ivf.search(ordered, cells, q[3].tolist(), 10, 10_000, F.col("id") % 2 == 0)
    assert [r.id for r in one.collect()] == exact(clustered, q[3], 10, np.arange(0, 2000, 2))[0]


def test_probes(spark, base, queries):
    """Probes of many queries at once are those of a full ranking; pages of queries change no result."""
    q, frame = queries
    rng = np.random.default_rng(2)
    cells = ivf.Cells(rng.normal(size=(300, 16)) * 5, rng.integers(0, 9, 300))
    for ef in (1, 20, 100, 10_000):
        for one, got in zip(q.astype(np.float64), cells.probes(q.astype(np.float64), ef, 10), strict=True):
            order = cells.ranked(one)
            enough = np.searchsorted(np.cumsum(cells.counts[order]), max(8 * ef, 10)) + 1
            assert got.tolist() == order[:enough].tolist() == cells.probe(one, ef, 10)
    ordered, centroids = ivf.build(base, cells=40)
    ordered, cells = ordered.persist(), ivf.cells_of(ordered, centroids)
    assert lists(ivf.search_batch(ordered, cells, frame, 10, 4, page=7)) == lists(ivf.search_batch(ordered, cells, frame, 10, 4))
    assert lists(topk.top_k_batch(base, frame, 10, page=9)) == lists(topk.top_k_batch(base, frame, 10))
    assert [len(ids) for ids, _ in topk.pages(frame, "qid", "qv", 15)] == [15, 15, 10] and topk.top_k_batch(base, frame.limit(0), 3).count() == 0


def test_normalize_wide_vectors(spark):
    """The length is taken once for each vector, not for each component."""
    x = np.random.default_rng(0).normal(size=(300, 768)).astype(np.float32)
    x[7] = 0
    df = vecs.from_numpy(spark, x)
    begin = time.perf_counter()
    got = np.array([r.v for r in df.select("row", l2_normalize(F.col("vector")).alias("v")).orderBy("row").collect()])
    assert time.perf_counter() - begin < 20
    length = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    assert np.allclose(got, x / np.where(length == 0, 1, length))


def test_pool_depth(spark, queries):
    """Vectors that codes tell apart badly: the measured pool is deep enough, the formula's is not."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    base = vecs.from_numpy(spark, x).withColumnRenamed("row", "id")
    books = pq.train(x[:2000], 2, 4)
    encoded = pq.encode(base, books).persist()
    frame = vecs.from_numpy(spark, x[:60] + rng.normal(size=(60, 16)).astype(np.float32) * 0.1).toDF("qid", "qv")
    truth = topk.top_k_batch(base, frame, 10)
    depth = pq.tune_depth(encoded, books, 10, 0.95)
    assert 10 < depth < 6000
    shallow, deep = (metrics.recall(pq.search(encoded, books, frame, 10, 5, depth=d), truth, 10).first().recall for d in (0, depth))
    assert deep >= 0.9 > shallow
    q = x[5].astype(np.float64)
    d = pq.table_distances(pq.codes_of(x.astype(np.float64), books), pq.tables(q[None, :], books)[0])
    assert [r.id for r in pq.pool(encoded, books, q, 20).collect()] == np.lexsort((np.arange(6000), d))[:20].tolist()
    assert lists(pq.scan(encoded, books, frame, 8, page=25)) == lists(pq.scan(encoded, books, frame, 8))


def test_kmeans(spark, base, clustered):
    a, b = (kmeans.fit(clustered, 20, 10, 3) for _ in range(2))
    assert np.array_equal(a, b) and len(kmeans.fit(clustered[:5], 20)) == 5
    assigned = kmeans.assign(base, a)
    own = np.array([r.cell for r in assigned.orderBy("id").collect()])
    assert np.array_equal(own, kmeans.nearest_centroid(clustered.astype(np.float64), a))
    means = kmeans.centroid_arrays(kmeans.update(assigned)).orderBy("cell").collect()
    for row in means:
        assert row.centroid == pytest.approx(clustered[own == row.cell].astype(np.float64).mean(axis=0), abs=1e-5)


def test_quantization(spark, base, queries, clustered):
    q, frame = queries
    books = pq.train(clustered, 4, 8)
    encoded = pq.encode(base, books).persist()
    codes = pq.codes_of(clustered.astype(np.float64), books)
    assert all(list(r.code) == codes[r.id].tolist() for r in pq.code_arrays(encoded).collect())
    table = pq.tables(q[:1].astype(np.float64), books)[0]
    near = pq.table_distances(codes, table)
    assert near == pytest.approx(((pq.decode(codes, books) - q[0]) ** 2).sum(axis=1), rel=1e-6)
    lut = F.array(*(topk.literal_vector(row) for row in table))
    got = pq.code_arrays(encoded).select("id", adc_distance(F.col("code"), lut).alias("d")).orderBy("id").collect()
    assert [r.d for r in got] == pytest.approx(near)
    spread = ((clustered - clustered.mean(axis=0)) ** 2).sum(axis=1).mean()
    assert pq.reconstruction_error(encoded, books).agg(F.avg("error")).first()[0] < 0.1 * spread
    truth = topk.top_k_batch(base, frame, 10)
    assert metrics.recall(pq.search(encoded, books, frame, 10, 64), truth, 10).first().recall >= 0.9
    assert pq.rerank_depth(10, 64) == 128 and pq.rerank_depth(10, 5000) == 3000
    for bad in (lambda: pq.train(clustered, 5), lambda: pq.train(clustered[:100], 4)):
        with pytest.raises(InvalidArgument):
            bad()


def test_graph(spark, base, clustered):
    some = base.where("id < 200")
    edges = graph.knn_graph(some, 6).collect()
    x = clustered[:200]
    for src in (0, 17, 199):
        assert [e.dst for e in sorted(edges, key=lambda e: e["rank"]) if e.src == src] == [i for i in exact(x, x[src], 7)[0] if i != src][:6]
    back = {r.dst: r.sources for r in graph.reverse_edges(graph.knn_graph(some, 6)).collect()}
    assert all(sorted(e.src for e in edges if e.dst == d) == s for d, s in back.items())
    linked = graph.proximity_graph(some, 4, 10)
    assert linked.groupBy("src").count().agg(F.max("count")).first()[0] <= 8
    assert linked.where("src = dst").count() == 0 and linked.count() == linked.dropDuplicates(["src", "dst"]).count()


def test_diverse():
    near = np.array([[1.0, 0], [1.1, 0], [0, 2.0]])
    assert graph.diverse(np.zeros(2), near, (near**2).sum(axis=1), 2) == [0, 2]
    assert graph.diverse(np.zeros(2), near, (near**2).sum(axis=1), 4) == [0, 1, 2]


@pytest.fixture(scope="module")
def shop(base):
    return base.withColumns({"price": (F.col("id") * 37 % 1000).cast("double"), "cat": F.when(F.col("id") % 14 == 0, "socks").when(F.col("id") % 97 == 0, "belts").otherwise("shoes")}).persist()


SHOP = {"price": "num", "cat": "str"}


def test_strategies(shop, queries):
    q = queries[0][2].tolist()
    planner = Planner()
    run = lambda text, **kw: filtered_search(shop, SHOP, q, 10, text, planner, near=lambda rows, k, ef: topk.top_k(rows, q, k), **kw)
    assert run("price >= 0").strategy.startswith("post_filter")
    assert run("price == 7 AND cat == 'belts'").strategy == "brute_force"
    assert run("cat == 'socks'").strategy == "bitmap"
    truth = [r.id for r in topk.top_k(shop.where("cat = 'socks'"), q, 10).collect()]
    for strategy in (None, "brute_force", "bitmap"):
        assert [r.id for r in run("cat == 'socks'", strategy=strategy).rows.collect()] == truth
    some = [r.id for r in run("cat == 'socks'", strategy="post_filter").rows.collect()]
    assert some == truth[: len(some)]
    with pytest.raises(InvalidArgument):
        run("price >= 0", strategy="magic")


def test_fallback(shop, queries):
    q = queries[0][2].tolist()
    planner = Planner(post_filter_min_selectivity=0.0, brute_force_max_selectivity=0.0, post_filter_max_ef=10)
    found = filtered_search(shop, SHOP, q, 10, "cat == 'socks'", planner, near=lambda rows, k, ef: topk.top_k(rows, q, k))
    assert found.strategy == "post_filter+bitmap" and found.rows.count() == 10


def test_masks(shop):
    planner = Planner(mask_cache_size=2)
    node = lambda t: __import__("nearfield.functions.filters", fromlist=["parse"]).parse(t)
    a = planner.mask(node("price < 5 AND cat == 'socks'"), shop, SHOP, 1)
    assert planner.mask(node("cat == 'socks' AND price < 5"), shop, SHOP, 1) is a
    planner.mask(node("price < 6"), shop, SHOP, 1)
    planner.mask(node("price < 7"), shop, SHOP, 1)
    assert len(planner.masks) == 2
    planner.mask(node("price < 6"), shop, SHOP, 2)
    assert len(planner.masks) == 1
    planner.clear()


def test_compare(shop, queries):
    rows = compare(shop, SHOP, queries[0][2].tolist(), 10, "price < 500", Planner())
    assert all(r["recall"] == 1.0 for r in rows) and rows[0]["selectivity"] == pytest.approx(0.5, abs=0.02)


def test_vector_files_whole(spark, tmp_path, monkeypatch):
    """On a file system that Arrow does not know a task reads a whole file."""
    x = np.arange(40, dtype=np.float32).reshape(10, 4)
    vecs.write_vecs(list(x), str(tmp_path / "a.fvecs"))

    def unknown(path):
        raise pa.ArrowInvalid("unknown scheme")

    monkeypatch.setattr(vecs, "opened", unknown)
    assert [list(r.vector) for r in vecs.read_vecs(spark, str(tmp_path / "a.fvecs")).orderBy("row").collect()] == x.tolist()


def test_tar_member(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("".join(f"{i}\tpassage {i}\textra\n" for i in range(5000)) + "5000\n")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "a.tsv", "./a.tsv")
    rows = vecs.read_tar_tsv(spark, str(tmp_path / "t.tar.gz"), "a.tsv", ["id", "text"])
    assert rows.count() == 5001 and rows.where("text is null").first().id == "5000" and rows.where("id = '4999'").first().text == "passage 4999"
    assert vecs.read_tar_tsv(spark, str(tmp_path / "t.tar.gz"), "a.tsv", ["id", "text"], 7).count() == 7
    with pytest.raises(Exception, match="has no b.tsv"):
        vecs.read_tar_tsv(spark, str(tmp_path / "t.tar.gz"), "b.tsv", ["id"]).collect()


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    vecs.write_vecs(list(x), str(tmp_path / "a.fvecs"))
    vecs.write_vecs(list(x.astype(np.int32)), str(tmp_path / "a.ivecs"))
    for kind in "fi":
        got = vecs.read_vecs(spark, str(tmp_path / f"a.{kind}vecs"), kind).orderBy("row").collect()
        assert [list(r.vector) for r in got] == x.tolist()
        parts = vecs.read_vecs(spark, str(tmp_path / f"a.{kind}vecs"), kind, size=21)
        assert parts.rdd.getNumPartitions() == 3 and [list(r.vector) for r in parts.orderBy("row").collect()] == x.tolist()
    (tmp_path / "bad.fvecs").write_bytes(b"\x04\0\0\0" + b"\0" * 9)
    with pytest.raises(Exception, match="not a file of vectors"):
        vecs.read_vecs(spark, str(tmp_path / "bad.fvecs")).collect()
    np.save(tmp_path / "a.npy", x)
    assert vecs.load_npy(spark, str(tmp_path / "a.npy")).count() == 3
    (tmp_path / "a.tsv").write_text('1\tsome "text\n2\tmore\n')
    assert [r.text for r in vecs.read_tsv(spark, str(tmp_path / "a.tsv"), ["id", "text"], 2).orderBy("id").collect()] == ['some "text', "more"]
    texts = spark.createDataFrame([("ab",), ("abc",)], "text string")
    assert sorted(r.vector[0] for r in vecs.embedded(texts, lambda t: [[len(s), 0] for s in t], 2).collect()) == [2, 3]
