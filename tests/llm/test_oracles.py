"""The operators' queries with SQL against DuckDB, on the smallest test tables and on a table of odd rows."""

import os

import duckdb
import pytest

from nearfield.llm import line_dedup, queries, repeats, topk

DATA = os.environ.get("NEARFIELD_TESTDATA", "/root/testdata/sf0.001")


def rows_of(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def same(df, con, sql):
    columns = sorted(df.columns)
    assert (columns, sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)) == rows_of(con, sql)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_tables(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    same(queries.queries()[name](spark, DATA), con, queries.oracle_sql()[name])


def test_odd_rows(spark, docs, rows, tmp_path):
    """Nulls, empty and long texts, repeated rows, equal ids; a cut that goes through a character."""
    wide = "é" * 300
    extra = [(300, "a" + wide + "b", "fr"), (301, "xx" + wide.encode().decode("latin-1"), "fr"), (302, wide + "ü", "fr")]
    frame = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(repeats.digest(repeats.remove_repeats(frame)), con, repeats.ORACLE)
    once = frame.where("doc_id is not null").dropDuplicates(["doc_id"])
    con.register("documents", once.toPandas())
    same(line_dedup.digest(line_dedup.line_dedup(once)), con, line_dedup.ORACLE)


def test_cut_character(spark):
    """What is left of a text that is cut inside a character is no text."""
    shared = bytes(range(97, 123)).decode() * 20
    a, b = "é" + shared, "Ã".encode().decode() + shared
    got = {r.doc_id: r for r in repeats.digest(repeats.remove_repeats(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"))).collect()}
    assert got[1].n_bytes == 522 and got[1].n_removed in (520, 521) and (got[1].kept is None) == (got[1].n_removed == 521)


@pytest.mark.parametrize("batch", [3, 8192])
def test_query_batches(spark, batch):
    """Batches of queries that are written one after another, over vectors of two lengths."""
    rows = [(i, [float((i * k) % 11 - 5) for k in range(1, 4 + i % 2)]) for i in range(40)] + [(5, None), (41, [float("nan"), 1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(frame, frame.vec_id % 4 == 0, 5, query_batch=batch).collect())
    clashes = frame.selectExpr("*", "'c' AS x", "'c' AS dim", "'c' AS rank", "'c' AS score", "'c' AS query_id", "'c' AS ids", "'c' AS forward")
    assert got == sorted(tuple(r) for r in topk.top_k(clashes, clashes.vec_id % 4 == 0, 5, query_batch=batch).collect())
    want = []
    whole = {i: [int(256 * c // 1) for c in v] for i, v in rows if v and v[0] == v[0]}
    for q, x in whole.items():
        if q % 4 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in whole.items() if i != q and len(y) == len(x))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
