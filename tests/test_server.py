import os
import runpy
import threading
import urllib.request

import pytest

from nearfield.engine import Engine
from nearfield.errors import AlreadyExists, InvalidArgument, NotFound
from nearfield.server import Client, serve


@pytest.fixture
def client(spark, tmp_path):
    with Engine(spark, str(tmp_path)) as engine:
        server = serve(engine, port=0)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        yield Client(f"http://127.0.0.1:{server.server_port}")
        server.shutdown()
        server.server_close()


def test_calls(client, clustered):
    client.create_collection("shop", 16, index="flat")
    records = [{"id": f"v{i}", "vector": clustered[i].tolist(), "attributes": {"n": i, "even": i % 2 == 0}} for i in range(30)]
    assert client.upsert("shop", records, batch=20) == 30 and client.upsert("shop", []) == 0
    found = client.search("shop", clustered[4], 2, "even == true", include_attributes=True)
    assert found["hits"][0] == {"id": "v4", "distance": 0.0, "attributes": {"n": 4.0, "even": True}}
    assert found["strategy"] == "brute_force" and found["ef"] == 0 and found["selectivity"] == 0.5
    assert len(client.search("shop", clustered[4])["hits"]) == 10 and "attributes" not in client.search("shop", clustered[4])["hits"][0]
    assert client.delete("shop", ["v4", "nobody"]) == 1
    assert client.stats("shop")["count"] == 29 and client.call("GET", "") == {"collections": ["shop"]}
    assert all(r["recall"] == 1 for r in client.compare("shop", clustered[4], 3, "n < 20"))
    client.drop_collection("shop")
    with pytest.raises(NotFound):
        client.stats("shop")


def test_errors(client, clustered):
    client.create_collection("a", 16, index="flat")
    for error, call in (
        (AlreadyExists, lambda: client.create_collection("a", 16)),
        (InvalidArgument, lambda: client.create_collection("b/c", 16)),
        (InvalidArgument, lambda: client.create_collection("b", 16, nope=1)),
        (InvalidArgument, lambda: client.call("POST", "", {"name": "b"})),
        (InvalidArgument, lambda: client.search("a", [1.0])),
        (InvalidArgument, lambda: client.search("a", clustered[0], filter="nope ==")),
        (InvalidArgument, lambda: client.upsert("a", [{"id": "x", "vector": clustered[0].tolist(), "attributes": {"n": None}}])),
        (NotFound, lambda: client.search("none", clustered[0])),
        (NotFound, lambda: client.call("POST", "/a/fly", {})),
    ):
        with pytest.raises(error):
            call()
    for body in (b"[1]", b"{"):
        request = urllib.request.Request(f"{client.url}/collections", body, method="POST")
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(request)
        assert e.value.code == 400


def test_example(spark, tmp_path):
    """The walk through a collection of passages finds the text that has the words."""
    texts = [(i, " ".join(["plain", "filler"] * 12 + [f"topic{chr(97 + i)}"] * 3)) for i in range(8)] + [(90, "short topicc"), (91, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "examples", "passages.py")
    found = runpy.run_path(path)["main"](str(tmp_path / "documents.parquet"), "topicc topicc topicc")
    assert found[0][0] == "d2" and len(found) == 5 and "d90" not in [i for i, _ in found]
