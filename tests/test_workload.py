import os
import signal
import subprocess
import sys
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from nearfield.collection import Collection
from nearfield.operators import metrics, topk, workload
from nearfield.plans.planner import Planner
from nearfield.sources import vecs


@pytest.fixture(scope="module")
def shop(spark, clustered):
    return workload.with_attributes(vecs.from_numpy(spark, clustered).withColumnRenamed("row", "id")).persist()


def test_attributes(shop):
    row = shop.agg(F.avg("price").alias("p"), F.avg(F.col("in_stock").cast("int")).alias("s"), F.count_if(F.col("category") == "c0").alias("c0"), F.count_distinct("category").alias("n")).first()
    assert row.p == pytest.approx(500, abs=30) and row.s == pytest.approx(0.7, abs=0.05) and 350 < row.c0 < 550 and row.n == 50


def test_measure_and_tune(spark, shop, clustered):
    queries = [(clustered[i].tolist(), text) for i, text in enumerate(workload.predicates(8))]
    found = workload.measure(shop, queries, 5, Planner(), near=lambda v: lambda rows, k, ef: topk.top_k(rows, v, k))
    assert found.agg(F.avg("recall")).first()[0] == 1.0 and found.select("strategy").distinct().count() >= 2
    assert metrics.latency_buckets(found, workload.buckets(spark)).agg(F.sum("n")).first()[0] == 8
    best = workload.tune(shop, queries[3:5], 5, [0.02], [0.1]).first()
    assert (best.low, best.high) == (0.02, 0.1) and best.recall >= 0.95


def test_killed_writer(spark, tmp_path):
    """What a killed writer acknowledged is there after reopening."""
    Collection.create(spark, str(tmp_path / "c"), "c", 2, {"index": "flat", "durability.snapshot_every": 7})
    script = f"""
        from pyspark.sql import SparkSession
        from nearfield.collection import Collection
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        c = Collection.open(spark, {str(tmp_path / "c")!r})
        for i in range(1000):
            c.upsert([f"v{{i}}"], [[i, 1]], [{{"seq": i}}])
            print("ACK", i, flush=True)
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    writer = subprocess.Popen([sys.executable, "-c", textwrap.dedent(script)], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, cwd=root, start_new_session=True)
    acked = -1
    for line in writer.stdout:
        if line.startswith("ACK"):
            acked = int(line.split()[1])
            if acked >= 9:
                break
    time.sleep(0.2)
    os.killpg(writer.pid, signal.SIGKILL)
    acked = max([acked, *(int(x.split()[1]) for x in writer.stdout if x.startswith("ACK") and x.endswith("\n"))])
    writer.wait()
    again = Collection.open(spark, str(tmp_path / "c"))
    seqs = sorted(int(r.seq) for r in again.records().collect())
    assert seqs[: acked + 1] == list(range(acked + 1)) and len(seqs) <= acked + 2
    assert again.upsert(["after"], [[0, 0]]) == 1
