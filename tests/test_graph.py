import os

import pytest

from nearfield import queries
from nearfield.operators import graph

DATA = os.environ.get("NEARFIELD_TESTDATA", "/root/testdata/sf0.001")


def test_hub_edges(spark, monkeypatch):
    """A hub keeps a diverse edge that lies behind many edges close to each other."""
    at = {0: (0.0, 0.0), 6: (-2.0, 0.0)} | {i: (1.0, 0.001 * i) for i in range(1, 6)}
    base = spark.createDataFrame([(i, list(v)) for i, v in at.items()], "id long, vector array<double>")
    edges = spark.createDataFrame([(i, 0, at[i][0] ** 2 + at[i][1] ** 2) for i in range(1, 7)], "src long, dst long, distance double")
    monkeypatch.setattr(graph, "knn_graph", lambda *args: edges)
    found = graph.proximity_graph(base, 1, 1)
    assert sorted(r.dst for r in found.where("src = 0").collect()) == [1, 6]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_whole_table(spark):
    want = {r.vec_id for r in queries.table(spark, DATA, "embeddings").collect()}
    assert len(want) > 100 and {r.src for r in queries.proximity_graph(spark, DATA).collect()} == want
