import json

import numpy as np
import pytest

from nearfield.collection import Collection
from nearfield.config import DEFAULTS, scalar, with_options
from nearfield.engine import Engine
from nearfield.errors import AlreadyExists, CollectionError, FilterError, InvalidArgument, NotFound
from nearfield.operators import ivf
from nearfield.plans import budget, train_budget
from nearfield.sources import vecs
from nearfield.streaming.ingest import upsert_stream, windowed_counts


@pytest.fixture
def make(spark, tmp_path):
    def create(dim=16, name="c", **options):
        return Collection.create(spark, str(tmp_path / name), name, dim, options)

    return create


def nearest(x, q, k, alive=None):
    d = ((x.astype(np.float64) - q.astype(np.float64)) ** 2).sum(axis=1)
    order = [i for i in np.argsort(d, kind="stable").tolist() if alive is None or i in alive]
    return [f"v{i}" for i in order[:k]]


def test_lifecycle(spark, make, clustered, tmp_path):
    c = make(index="flat")
    x = clustered[:300]
    assert c.search(x[0]).ids == []
    assert c.upsert([f"v{i}" for i in range(300)], x, [{"price": i, "cat": f"c{i % 5}", **({"hot": True} if i % 2 else {})} for i in range(300)]) == 300
    found = c.search(x[7], 5, include_attributes=True)
    assert found.ids == nearest(x, x[7], 5) and found.info.strategy == "flat" and found.info.ef == 0
    assert found.distances[0] == 0 and found.attributes[0] == {"price": 7.0, "cat": "c2", "hot": True}
    assert c.search(x[8], 1, include_attributes=True).attributes == [{"price": 8.0, "cat": "c3"}]
    some = c.search(x[7], 5, "price < 100 AND cat == 'c2'")
    assert some.ids == nearest(x, x[7], 5, set(range(2, 100, 5))) and some.info.strategy == "brute_force"
    # A record is replaced as a whole; the last of equal ids wins; the count includes the others.
    assert c.upsert(["v1", "n", "n"], x[[5, 6, 7]], [{"cat": "new"}, {"price": 1}, {"price": 2}]) == 3
    assert c.search(x[5], 2, include_attributes=True).attributes == [{"cat": "new"}, {"price": 5.0, "cat": "c0", "hot": True}]
    assert c.search(x[7], 2, "price == 2").ids == ["n", "v2"]
    # Deletes count each id once; unknown ids do nothing.
    lsn = c.lsn
    assert c.delete(["nobody"]) == 0 and c.lsn == lsn
    assert c.delete(["v0", "v0", "v2", "nobody"]) == 2
    info = c.info()
    assert (info["count"], info["deleted"], info["lsn"]) == (299, 2, lsn + 1)
    before = c.search(x[7], 20).ids
    # What is logged is there after a reopen, with and without a snapshot.
    again = Collection.open(spark, str(tmp_path / "c"))
    assert again.search(x[7], 20).ids == before and again.kinds == c.kinds and again.lsn == c.lsn
    again.close()
    assert again.store.names("log") == []
    third = Collection.open(spark, str(tmp_path / "c"))
    assert third.search(x[7], 20).ids == before and third.info()["count"] == 299
    assert third.upsert(["z"], x[:1]) == 1 and third.search(x[0], 1).ids == ["z"]


def test_torn_batch(spark, make, clustered, tmp_path):
    c = make(index="flat")
    c.upsert(["a"], clustered[:1])
    c.upsert(["b"], clustered[1:2])
    # A writer killed before the rename leaves a temporary directory, which counts for nothing.
    c.store.make("log", ".00000000000000000003.tmp")
    c.store.make("snapshot", "00000000000000000002")
    again = Collection.open(spark, str(tmp_path / "c"))
    assert again.lsn == 2 and sorted(again.search(clustered[0], 5).ids) == ["a", "b"]
    assert again.store.names("snapshot") == [] and not any(n.startswith(".") for n in again.store.names("log"))
    again.store.remove("log", "00000000000000000001")
    with pytest.raises(OSError):
        Collection.open(spark, str(tmp_path / "c"))


def test_validation(make, clustered):
    c = make(index="flat")
    c.upsert(["a"], clustered[:1], [{"p": 1.0, "s": "x", "b": True}])
    lsn = c.lsn
    bad = [
        lambda: c.upsert(["a"], clustered[:2]),
        lambda: c.upsert(["a"], clustered[:1, :3]),
        lambda: c.upsert(["a"], [[float("nan")] * 16]),
        lambda: c.upsert(["a", "b"], [[1.0] * 16, [1.0]]),
        lambda: c.upsert(["a"], clustered[:1], [{"p": "text"}]),
        lambda: c.upsert(["a", "b"], clustered[:2], [{"q": 1}, {"q": "x"}]),
        lambda: c.upsert(["a"], clustered[:1], [{"p": None}]),
        lambda: c.upsert(["a"], clustered[:1], [{"bad name": 1}]),
        lambda: c.upsert(["a"], clustered[:1], [{"name\n": 1}]),
        lambda: c.search(clustered[0], 0),
        lambda: c.search(clustered[0], 5, ef=0),
        lambda: c.search(clustered[:2], 5),
        lambda: c.search(clustered[0], 5, "p == 'x'"),
        lambda: c.search(clustered[0], 5, " "),
        lambda: c.search(clustered[0], 5, "p > 0", strategy="magic"),
        lambda: c.set_budget_model(object()),
    ]
    for call in bad:
        with pytest.raises(InvalidArgument):
            call()
    assert c.lsn == lsn and c.upsert([], []) == 0
    with pytest.raises(FilterError):
        c.search(clustered[0], 5, "nope == 1")
    c.upsert(["n"], clustered[:1], [{"p": float("nan")}])
    assert c.search(clustered[0], 5, "NOT p == 1").ids == ["n"]


@pytest.mark.parametrize("options", [{"metric": "dot"}, {"index": "tree"}, {"hnsw.nope": "1"}, {"nope": "1"}, {"index": "hnsw_pq", "pq.m": "5"}, {"pq.ksub": 16}])
def test_bad_options(make, options, tmp_path):
    with pytest.raises(CollectionError):
        make(**options)
    assert not (tmp_path / "c").exists()


def test_options():
    assert with_options(DEFAULTS, {"hnsw__M": "32", "early_stop.multiplier": "1.5", "durability.fsync": "no"})["hnsw"]["M"] == 32
    assert [scalar(x) for x in ("1", "1.5", "true", "null", "x", 3)] == [1, 1.5, True, None, "x", 3]


def test_cosine(make):
    c = make(8, metric="cosine", index="flat")
    x = np.eye(8, dtype=np.float32)[:3] * [[1], [5], [0]]
    c.upsert(["a", "b", "zero"], x)
    found = c.search(x[1] * 1000, 3)
    assert found.ids == ["b", "zero", "a"] and found.distances == pytest.approx([0, 1, 2])


def test_index(spark, make, clustered, tmp_path):
    options = {"durability.snapshot_every": 1500, "pq.train_size": 1000, "pq.m": 4, "pq.kmeans_iters": 5}
    flat, ann, codes = make(name="flat", index="flat"), make(name="ann", **options), make(name="codes", index="hnsw_pq", **options)
    ids = [f"v{i}" for i in range(2000)]
    attributes = [{"price": float(i % 1000)} for i in range(2000)]
    for c in (flat, ann, codes):
        c.upsert(ids[:1600], clustered[:1600], attributes[:1600])
        c.upsert(ids[1600:], clustered[1600:], attributes[1600:])
        c.delete(["v3"])
    assert ann.snapshot_lsn == 1 and ann.tail == [2, 3] and ann.cells() is not None and codes.codebooks().shape == (4, 256, 4)
    hits = {"ann": 0, "codes": 0}
    for i in (3, 500, 1700, 1999):
        truth = set(flat.search(clustered[i], 10).ids)
        for name, c, label in (("ann", ann, "hnsw"), ("codes", codes, "hnsw_pq")):
            found = c.search(clustered[i], 10)
            assert found.info.strategy == label and "v3" not in found.ids and found.distances == sorted(found.distances)
            hits[name] += len(truth & set(found.ids))
    assert hits["ann"] >= 38 and hits["codes"] >= 36
    filtered = ann.search(clustered[5], 10, "price < 700")
    assert filtered.info.strategy.startswith("post_filter") and len(filtered.ids) == 10
    assert ann.search(clustered[5], 3, "price < 5").ids == flat.search(clustered[5], 3, "price < 5").ids
    frame = vecs.from_numpy(spark, clustered[:20]).toDF("qid", "qv")
    rows = flat.search_batch(frame, 5).collect()
    assert len(rows) == 100 and all(r.id == f"v{r.qid}" for r in rows if r["rank"] == 1 and r.qid != 3)
    ann.snapshot()
    near = {(r.qid, r.id) for r in ann.search_batch(frame, 5).collect()}
    assert len(near & {(r.qid, r.id) for r in rows}) >= 90
    assert ann.info()["index_bytes"] > 0 and codes.info()["count"] == 1999
    # A learned budget.
    base = ann.indexed().selectExpr("xxhash64(id) AS id", "vector", "cell").persist()
    model = budget.train(budget.training_rows(spark, base, ann.cells(), vecs.from_numpy(spark, clustered[:200]).toDF("qid", "qv"), 10), trees=5)
    q = clustered[1].astype(np.float64)
    assert budget.BudgetModel.loads(model.dumps()).budget(q, ann.cells(), 10) == model.budget(q, ann.cells(), 10) >= 10
    assert len(budget.features(q, ann.cells(), 10)) == len(budget.FEATURES)
    ann.set_budget_model(model)
    found = ann.search(clustered[1], 10)
    assert found.info.strategy == "hnsw+early_stop" and len(set(found.ids) & set(flat.search(clustered[1], 10).ids)) >= 8
    assert ann.search(clustered[1], 10, ef=64).info.strategy == "hnsw"


def test_live_index(spark, make, clustered, tmp_path):
    """Rows that are logged behind a snapshot have cells and codes, and are found by single and batch search."""
    options = {"durability.snapshot_every": 0, "pq.train_size": 1000, "pq.m": 4, "pq.kmeans_iters": 5}
    ids = [f"v{i}" for i in range(2000)]
    frame = vecs.from_numpy(spark, clustered[1490:1530]).toDF("qid", "qv")
    for name in ("hnsw", "hnsw_pq"):
        c = make(name=name, index=name, **options)
        c.upsert(ids[:1500], clustered[:1500])
        assert c.tail == [1] and c.search(clustered[3], 1).ids == ["v3"]
        c.snapshot()
        c.upsert(ids[1500:], clustered[1500:], [{"n": i} for i in range(500)])
        c.upsert(["v7"], clustered[1999:] + 50)
        c.delete(["v1500", "v9"])
        tail = spark.read.parquet(f"{c.store.root}/log/00000000000000000002")
        assert tail.where("cell is null").count() == 0 and ("code" in tail.columns) == (name == "hnsw_pq")
        alive = np.array([i for i in range(2000) if i not in (7, 9, 1500)])
        d = ((clustered[1490:1530, None].astype(np.float64) - clustered[None, alive]) ** 2).sum(axis=2)
        want = {(k, f"v{alive[j]}") for k in range(40) for j in np.argsort(d[k], kind="stable")[:5]}
        got = c.search_batch(frame, 5).collect()
        assert len(got) == 200 and len(want & {(r.qid, r.id) for r in got}) >= 190
        assert all(r.distance == pytest.approx(((clustered[1490 + r.qid].astype(np.float64) - clustered[int(r.id[1:])]) ** 2).sum()) for r in got)
        found = c.search(clustered[1700], 5, include_attributes=True)
        assert found.ids[0] == "v1700" and found.attributes[0] == {"n": 200.0}
        assert 0 < found.info.stats["probes"] <= len(c.cells().counts) and found.info.stats["ndist"] <= 1500
        assert (found.info.stats.get("reranked", 0) >= 128) == (name == "hnsw_pq")
        assert sorted(r.id for r in c.get(["v7", "v9", "v10", "nobody"]).collect()) == ["v10", "v7"]
        assert c.records().count() == 1998 and "cell" not in c.records().columns
        info = c.info()
        assert info["vector_bytes"] == 1998 * 64 and info["stored_bytes"] > 0


def test_learned_budget_under_filter(spark, make, clustered, tmp_path):
    c = make(name="a", index="hnsw", **{"durability.snapshot_every": 0})
    c.upsert([f"v{i}" for i in range(2000)], clustered, [{"price": float(i % 100)} for i in range(2000)])
    c.snapshot()
    base = c.indexed().selectExpr("xxhash64(id) AS id", "vector", "cell").persist()
    model = budget.train(budget.training_rows(spark, base, c.cells(), vecs.from_numpy(spark, clustered[:100]).toDF("qid", "qv"), 10), trees=3)
    budget.save(spark, model, str(tmp_path / "model.json"))
    c.set_budget_model(model)
    found = c.search(clustered[5], 10, "price < 5")
    assert found.info.strategy == "bitmap+early_stop" and found.info.ef == found.info.stats["probes"] > 0 and len(found.ids) == 10
    assert c.search(clustered[5], 10, "price < 5", ef=64).info.strategy == "bitmap"
    assert c.search(clustered[5], 3, "price < 1").info.strategy == "brute_force"
    assert c.search(clustered[5], 3, "price < 50").info.strategy.startswith("post_filter")
    train_budget.main(["--collection", c.store.root, "--out", str(tmp_path / "trained.json"), "--queries", "60", "--trees", "2"])
    assert len(budget.load(spark, str(tmp_path / "trained.json")).trees) >= 1
    with pytest.raises(InvalidArgument):
        train_budget.train(make(name="empty"))
    saved = make(name="b", **{"early_stop.model": str(tmp_path / "model.json"), "early_stop.multiplier": 2.0})
    assert saved.budget_model.multiplier == 2.0 and saved.budget_model.dumps() == model.dumps().replace('"multiplier": 1.0', '"multiplier": 2.0')
    with pytest.raises(InvalidArgument):
        make(name="d", index="flat", **{"early_stop.model": "x"})


def test_settings_without_effect(make):
    with pytest.warns(UserWarning, match="hnsw.M, hnsw.max_batch"):
        make(**{"hnsw.M": 32, "hnsw.max_batch": 5})
    assert not make(name="d", **{"durability.fsync": "no"}).store.fsync


def test_equal_ids_need_an_order(spark, make, clustered):
    c = make(index="flat")
    twice = spark.createDataFrame([("a", clustered[0].tolist(), 1), ("a", clustered[1].tolist(), 2)], "id string, vector array<float>, seq int")
    with pytest.raises(InvalidArgument):
        c.upsert_frame(twice)
    assert c.upsert_frame(twice, "seq") == 2 and c.search(clustered[1], 1).distances == [0.0]


def test_frequencies_of_many_strings(spark, make, clustered, tmp_path):
    c = make(index="flat", **{"planner.exact_selectivity_below": 0})
    c.upsert([f"v{i}" for i in range(1200)], clustered[:1200], [{"name": f"s{i % 300}", "n": i} for i in range(1200)])
    c.snapshot()
    (tmp_path / "c").rename(tmp_path / "moved")
    again = Collection.open(spark, str(tmp_path / "moved"))
    found = again.search(clustered[6], 5, "name == 's6' OR name == 'none'")
    assert found.info.selectivity == pytest.approx(4 / 1200) and sorted(found.ids) == ["v306", "v6", "v606", "v906"]


def test_forest_equals_spark(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12))
    y = x[:, 0] * 2 + (x[:, 3] > 0)
    rows = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "qid long, " + ", ".join(f"{f} double" for f in budget.FEATURES) + ", label double")
    model = budget.train(rows, trees=8)
    guess = np.array([model.predict(r.tolist()) for r in x])
    assert np.corrcoef(guess, y)[0, 1] > 0.9
    assert all(len(vars(t)["feature"]) == len(t.value) for t in model.trees) and json.loads(model.dumps())["multiplier"] == 1.0


def test_engine(spark, tmp_path, clustered):
    with Engine(spark, str(tmp_path)) as e:
        e.create_collection("shop", 16, index="flat")
        for bad in ("", ".x", "a/b", "a\\b"):
            with pytest.raises(InvalidArgument):
                e.create_collection(bad, 4)
        with pytest.raises(AlreadyExists):
            e.create_collection("shop", 4)
        with pytest.raises(NotFound):
            e.search("none", [1.0])
        records = [{"id": f"v{i}", "vector": clustered[i], "attributes": {"n": i}} for i in range(25)]
        assert e.upsert("shop", records, batch=10) == 25 and e.upsert("shop", []) == 0
        with pytest.raises(InvalidArgument):
            e.upsert("shop", [{"id": "x", "vector": clustered[0], "attributes": {"n": None}}])
        assert len(e.search("shop", clustered[0]).ids) == 10
        assert e.search("shop", clustered[0], k=2, filter="n > 3", include_attributes=True).attributes[0]["n"] > 3
        assert e.delete("shop", ["v0"]) == 1 and e.stats("shop")["count"] == 24
        assert all(r["recall"] == 1 for r in e.compare("shop", clustered[0], 3, "n < 20"))
        assert e.names() == ["shop"]
    with Engine(spark, str(tmp_path)) as e:
        assert e.stats("shop")["count"] == 24
        e.drop_collection("shop")
        assert e.names() == []


def test_stream(spark, make, clustered, tmp_path):
    c = make(index="flat")
    rows = [(f"v{i}", clustered[i].tolist(), float(i)) for i in range(20)]
    schema = "id string, vector array<float>, price double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    upsert_stream(c, stream(), str(tmp_path / "check"), "price", once=True).awaitTermination()
    assert c.info()["count"] == 20 and c.stream_batch == 0
    lsn = c.lsn
    upsert_stream(c, stream(), str(tmp_path / "other"), "price", once=True).awaitTermination()
    assert c.lsn == lsn  # the same batch number again
    spark.createDataFrame([("v0", clustered[5].tolist(), 1.0), ("v0", clustered[6].tolist(), 2.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    upsert_stream(c, stream(), str(tmp_path / "check"), "price", once=True).awaitTermination()
    assert c.search(clustered[6], 2).ids == ["v0", "v6"] and c.info()["count"] == 20
    for bad in (spark.createDataFrame([("a", [1.0])], "id string, vector array<float>"), spark.createDataFrame([("a",)], "id string")):
        with pytest.raises(InvalidArgument):
            c.upsert_frame(bad)


def test_windows(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, IF(id % 2 = 0, 'a', 'b') AS event_type FROM range(20)")
    events.write.parquet(str(tmp_path / "e"))
    q = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("w").collect()) == 20


def test_cells_probe():
    cells = ivf.Cells(np.array([[0.0], [10.0], [20.0]]), np.array([5, 5, 5]))
    assert cells.probe(np.array([9.0]), 1, 3, oversample=1) == [1]
    assert cells.probe(np.array([9.0]), 6, 3, oversample=1) == [1, 0]
    assert cells.probe(np.array([9.0]), 1000, 3) == [1, 0, 2] and cells.first(np.array([21.0]), 2) == [2, 1]
