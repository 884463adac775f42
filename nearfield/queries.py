"""Registered queries over the test tables, each with the DuckDB statement that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import stats as st
from nearfield.functions.filters import compile_filter, flag, parse
from nearfield.functions.vector import has_digits, l2_distance, l2_normalize, word_count
from nearfield.operators import graph, ivf, kmeans, metrics, pq, topk
from nearfield.plans.planner import Planner, filtered_search

KINDS = {"price": "num", "category": "str", "kind": "str", "in_stock": "bool", "rating": "num"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default collection: embeddings with the attributes of the part of the same number."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 10 != 0, F.col("p_retailprice")).alias("price"), F.col("p_brand").alias("category"), F.col("p_type").alias("kind"), (F.col("p_size") % 10 < 7).alias("in_stock")
    )
    base = table(spark, sf_dir, "embeddings")
    joined = base.join(parts, base.vec_id == parts.p_partkey, "left")
    return joined.select(F.concat(F.lit("p"), "vec_id").alias("id"), "vec_id", F.col("embedding").alias("vector"), "price", "category", "kind", "in_stock", F.col("label").cast("double").alias("rating"))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One query vector, as a client would send it."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


PRODUCTS = """products AS (
  SELECT 'p' || CAST(e.vec_id AS VARCHAR) AS id, e.vec_id, e.embedding AS vector,
         CASE WHEN p.p_size % 10 <> 0 THEN p.p_retailprice END AS price, p.p_brand AS category, p.p_type AS kind,
         p.p_size % 10 < 7 AS in_stock, CAST(e.label AS DOUBLE) AS rating
  FROM embeddings e LEFT JOIN part p ON e.vec_id = p.p_partkey)"""
L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"


def l2(a: str, b: str) -> str:
    return L2.format(a=a, b=b)


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns or ("distance",):
        df = df.withColumn(c, F.round(c, 6))
    return df


# ---- exact search ----

SINGLE = f"""SELECT e.vec_id, round({l2('e.embedding', 'q.embedding')}, 6) AS distance
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q {{where}} ORDER BY {l2('e.embedding', 'q.embedding')}, e.vec_id {{limit}}"""
BATCH = f"""d AS (SELECT q.vec_id AS qid, e.vec_id AS vec_id, {l2('e.embedding', 'q.embedding')} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, d FROM d)"""


@register("flat_topk", SINGLE.format(where="", limit="LIMIT 10"))
def flat_topk(spark, sf_dir):
    found = topk.top_k(table(spark, sf_dir, "embeddings"), vector_of(spark, sf_dir, 0), 10, "vec_id", "embedding")
    return rounded(found.select("vec_id", "distance"))


@register("topk_k_gt_n", SINGLE.format(where="", limit=""))
def topk_k_gt_n(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    found = topk.top_k(base, vector_of(spark, sf_dir, 0), base.count() + 1, "vec_id", "embedding")
    return rounded(found.select("vec_id", "distance"))


@register("flat_topk_batch", f"WITH {BATCH} SELECT qid, rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 10")
def flat_topk_batch(spark, sf_dir):
    return rounded(topk.top_k_batch(table(spark, sf_dir, "embeddings"), query_set(spark, sf_dir), 10, "vec_id", "embedding"))


NORMED = """n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (CASE WHEN s = 0 THEN 1 ELSE s END)) AS v
FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS s FROM embeddings) t)"""


@register("cosine_topk", f"WITH {NORMED}, q AS (SELECT v FROM n WHERE vec_id = 3) SELECT n.vec_id, round({l2('n.v', 'q.v')}, 6) AS distance FROM n, q ORDER BY {l2('n.v', 'q.v')}, n.vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings").withColumn("v", l2_normalize(F.col("embedding")))
    q = np.array(vector_of(spark, sf_dir, 3), np.float64)
    found = topk.top_k(base, (q / (np.sqrt((q * q).sum()) or 1.0)).tolist(), 10, "vec_id", "v")
    return rounded(found.select("vec_id", "distance"))


@register("subset_topk", SINGLE.format(where="WHERE e.vec_id IN (SELECT p_partkey FROM part WHERE p_size > 25)", limit="LIMIT 10"))
def subset_topk(spark, sf_dir):
    ids = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("vec_id"))
    return rounded(topk.top_k_subset(table(spark, sf_dir, "embeddings"), ids, vector_of(spark, sf_dir, 0), 10, "vec_id", "embedding").select("vec_id", "distance"))


@register("tombstone_topk", SINGLE.format(where="WHERE e.vec_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')", limit="LIMIT 10"))
def tombstone_topk(spark, sf_dir):
    dead = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("vec_id"))
    return rounded(topk.top_k_alive(table(spark, sf_dir, "embeddings"), dead, vector_of(spark, sf_dir, 0), 10, "vec_id", "embedding").select("vec_id", "distance"))


@register("with_attributes", f"WITH {PRODUCTS}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 5), t AS (SELECT vec_id, {l2('e.embedding', 'q.embedding')} AS d FROM embeddings e, q ORDER BY d, vec_id LIMIT 10) SELECT p.id, round(t.d, 6) AS distance, p.price, p.category, p.in_stock, p.rating FROM t JOIN products p ON p.vec_id = t.vec_id")
def with_attributes(spark, sf_dir):
    hits = topk.top_k(table(spark, sf_dir, "embeddings"), vector_of(spark, sf_dir, 5), 10, "vec_id", "embedding").select("vec_id", "distance")
    found = topk.with_attributes(hits, products(spark, sf_dir).drop("vector"), "vec_id")
    return rounded(found.select("id", "distance", "price", "category", "in_stock", "rating"))


@register("l2_normalize", f"WITH {NORMED} SELECT vec_id, round(list_sum(v), 6) AS total, round(list_sum(list_transform(list_zip(v, range(len(v))), lambda z: z[1] * z[2])), 6) AS weighted, len(v) AS dim FROM n")
def normalized(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("v", l2_normalize(F.col("embedding")))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x), 6).alias("weighted"), F.size("v").cast("long").alias("dim"))


# ---- filters ----


def filter_query(name: str, text: str, where: str) -> None:
    @register(name, f"WITH {PRODUCTS} SELECT id, price, category, in_stock, rating FROM products WHERE {where}")
    def run(spark, sf_dir):
        return products(spark, sf_dir).where(compile_filter(parse(text), KINDS)).select("id", "price", "category", "in_stock", "rating")


filter_query("filter_num_range", "price >= 910 AND price < 930.5", "price >= 910 AND price < 930.5")
filter_query("filter_str_eq", "category == 'Brand#11'", "category = 'Brand#11'")
filter_query("filter_bool", "in_stock == true", "in_stock")
filter_query("filter_bool_order", "in_stock < true", "in_stock IS NOT NULL AND NOT in_stock")
filter_query("filter_in", "category IN ('Brand#11', 'Brand#23', \"nothing\") OR rating in (1, 3)", "category IN ('Brand#11', 'Brand#23', 'nothing') OR rating IN (1, 3)")
filter_query("filter_not_missing", "NOT price < 930", "price IS NULL OR NOT (price < 930)")
filter_query("filter_ne_missing", "price != 920 AND category != 'Brand#11'", "price IS NOT NULL AND price <> 920 AND category IS NOT NULL AND category <> 'Brand#11'")
filter_query("filter_nested", "NOT (price > 930 OR NOT in_stock == true) AND (rating <= 4 OR kind == 'x')", "NOT (coalesce(price > 930, false) OR NOT coalesce(in_stock, false)) AND (rating <= 4 OR coalesce(kind = 'x', false))")
FILTER = "price < 930 AND in_stock == true"
FILTERED = f"""WITH {PRODUCTS}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)
SELECT id, round({l2('vector', 'q.embedding')}, 6) AS distance FROM products, q WHERE price < 930 AND in_stock ORDER BY {l2('vector', 'q.embedding')}, vec_id LIMIT 10"""


@register("filtered_topk_brute", FILTERED)
def filtered_topk_brute(spark, sf_dir):
    return planned(spark, sf_dir, "brute_force")


@register("filtered_topk_bitmap", FILTERED)
def filtered_topk_bitmap(spark, sf_dir):
    return planned(spark, sf_dir, "bitmap")


@register("filtered_topk_post", f"""WITH {PRODUCTS}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
n AS (SELECT count(*) AS n, avg(CASE WHEN price < 930 AND in_stock THEN 1.0 ELSE 0.0 END) AS s FROM products),
t AS (SELECT id, vec_id, price, in_stock, {l2('vector', 'q.embedding')} AS d, row_number() OVER (ORDER BY {l2('vector', 'q.embedding')}, vec_id) AS r FROM products, q)
SELECT id, round(d, 6) AS distance FROM t, n WHERE r <= least(1024, ceil(15.0 / greatest(s, 0.001)) + 4) AND price < 930 AND in_stock ORDER BY d, vec_id LIMIT 10""")
def filtered_topk_post(spark, sf_dir):
    return planned(spark, sf_dir, "post_filter")


@register("filtered_topk_planner", FILTERED)
def filtered_topk_planner(spark, sf_dir):
    return planned(spark, sf_dir, None)


def planned(spark, sf_dir, strategy):
    base = products(spark, sf_dir)
    found = filtered_search(base, KINDS, vector_of(spark, sf_dir, 0), 10, FILTER, Planner(), strategy=strategy, id="vec_id")
    return rounded(found.rows.select("id", "distance"))


@register("filtered_gt_batch", f"""WITH {PRODUCTS}, q AS (SELECT vec_id AS qid, embedding, (vec_id // 50 % 10) AS want FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT qid, p.vec_id, {l2('p.vector', 'q.embedding')} AS d FROM q JOIN products p ON p.rating = q.want),
r AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, d FROM d)
SELECT qid, rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 5""")
def filtered_gt_batch(spark, sf_dir):
    """A predicate for each query (rating equal to the last digit of qid / 50): ground truth over all pairs that satisfy it."""

    def allowed(batch, q_ids):
        return np.asarray(batch.column("rating"))[:, None] == (q_ids // 50 % 10)[None, :]

    return rounded(topk.top_k_batch(products(spark, sf_dir), query_set(spark, sf_dir), 5, "vec_id", "vector", mask=allowed, extra=("rating",)))


@register("selectivity_exact", f"WITH {PRODUCTS} SELECT round(avg(CASE WHEN price < 930 AND in_stock THEN 1.0 ELSE 0.0 END), 6) AS selectivity FROM products")
def selectivity_exact(spark, sf_dir):
    return products(spark, sf_dir).agg(F.round(F.avg(flag(parse(FILTER), KINDS).cast("double")), 6).alias("selectivity"))


# ---- statistics ----


@register("stats_null_frac", f"WITH {PRODUCTS} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, 1 - count({c}) / count(*) AS null_frac FROM products" for c in KINDS))
def stats_null_frac(spark, sf_dir):
    return st.null_fractions(products(spark, sf_dir), list(KINDS))


@register("stats_freq", f"WITH {PRODUCTS} SELECT category AS value, count(*) AS n FROM products WHERE category IS NOT NULL GROUP BY 1")
def stats_freq(spark, sf_dir):
    return st.value_frequencies(products(spark, sf_dir), "category")


@register("stats_freq_num", f"WITH {PRODUCTS} SELECT rating AS value, count(*) AS n FROM products WHERE rating IS NOT NULL GROUP BY 1")
def stats_freq_num(spark, sf_dir):
    return st.value_frequencies(products(spark, sf_dir), "rating")


@register("stats_freq_bool", f"WITH {PRODUCTS} SELECT in_stock AS value, count(*) AS n FROM products WHERE in_stock IS NOT NULL GROUP BY 1")
def stats_freq_bool(spark, sf_dir):
    return st.value_frequencies(products(spark, sf_dir), "in_stock")


POINTS = ", ".join(str(i / 100) for i in range(101))


@register("stats_quantiles", f"SELECT CAST(unnest(range(101)) AS INTEGER) AS point, unnest(list_transform(q, lambda x: round(x, 6))) AS quantile FROM (SELECT quantile_cont(l_extendedprice, [{POINTS}]) AS q FROM lineitem) t")
def stats_quantiles(spark, sf_dir):
    return rounded(st.quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "quantile")


@register("stats_ndv", "SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem")
def stats_ndv(spark, sf_dir):
    return st.distinct_count(table(spark, sf_dir, "lineitem"), "l_partkey")


@register("collection_stats", f"WITH {PRODUCTS} SELECT count(*) AS n, count(*) FILTER (WHERE in_stock) AS alive, CAST(count(*) * max(len(vector)) * 4 AS BIGINT) AS vector_bytes FROM products")
def collection_stats(spark, sf_dir):
    base = products(spark, sf_dir)
    return base.agg(F.count("*").alias("n"), F.count_if("in_stock").alias("alive"), (F.count("*") * F.max(F.size("vector")) * 4).cast("long").alias("vector_bytes"))


@register("text_attributes", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS DOUBLE) AS words, regexp_matches(text, '[0-9]') AS has_digits FROM documents")
def text_attributes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("words"), has_digits(F.col("text")).alias("has_digits"))


# ---- the op log ----

OPS = """ops AS (SELECT event_id + 1 AS lsn, 'u' || CAST(user_id AS VARCHAR) AS id, CASE event_type WHEN 'error' THEN 'D' ELSE 'U' END AS op, value, event_type AS kind FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS r FROM ops) t WHERE r = 1 AND op = 'U')"""


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("lsn"), F.lit(0).alias("pos"), F.concat(F.lit("u"), "user_id").alias("id"), F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"), "value", F.col("event_type").alias("kind")
    )


@register("upsert_latest_wins", f"WITH {OPS} SELECT id, lsn, value, kind FROM latest")
def upsert_latest_wins(spark, sf_dir):
    from nearfield.sources.log import live_records

    return live_records(op_log(spark, sf_dir)).select("id", "lsn", "value", "kind")


@register("live_count", f"WITH {OPS} SELECT count(*) AS live, (SELECT count(DISTINCT id) FROM ops) - count(*) AS deleted FROM latest")
def live_count(spark, sf_dir):
    from nearfield.sources.log import latest_ops

    return latest_ops(op_log(spark, sf_dir)).agg(F.count_if(F.col("op") == "U").alias("live"), F.count_if(F.col("op") == "D").alias("deleted"))


@register("replay_after", f"WITH {OPS} SELECT id, max(lsn) AS lsn, count(*) AS n FROM ops WHERE lsn > 500 GROUP BY id")
def replay_after(spark, sf_dir):
    return op_log(spark, sf_dir).where("lsn > 500").groupBy("id").agg(F.max("lsn").alias("lsn"), F.count("*").alias("n"))


@register("id_lookup", f"WITH {OPS} SELECT id, lsn FROM latest WHERE id IN ('u1', 'u2', 'u3', 'nobody')")
def id_lookup(spark, sf_dir):
    from nearfield.sources.log import live_records

    wanted = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("nobody",)], "id string")
    return live_records(op_log(spark, sf_dir)).join(F.broadcast(wanted), "id").select("id", "lsn")


@register("acked_minus_deleted", f"WITH {OPS} SELECT id FROM (SELECT DISTINCT id FROM ops WHERE op = 'U') a WHERE id NOT IN (SELECT id FROM ops WHERE op = 'D')")
def acked_minus_deleted(spark, sf_dir):
    ops = op_log(spark, sf_dir)
    return ops.where("op = 'U'").select("id").subtract(ops.where("op = 'D'").select("id"))


# ---- graph ----

KNN = f"""WITH d AS (SELECT s.vec_id AS src, e.vec_id AS dst, {l2('e.embedding', 's.embedding')} AS d FROM embeddings s, embeddings e WHERE s.vec_id <> e.vec_id),
r AS (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY d, dst) AS INTEGER) AS rank, dst, d FROM d), k AS (SELECT * FROM r WHERE rank <= 8)"""


@register("knn_graph", KNN + " SELECT src, rank, dst, round(d, 6) AS distance FROM k")
def knn_graph(spark, sf_dir):
    return rounded(graph.knn_graph(table(spark, sf_dir, "embeddings"), 8, "vec_id", "embedding"))


@register("reverse_edges", KNN + " SELECT dst, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS sources FROM k GROUP BY dst")
def reverse_edges(spark, sf_dir):
    found = graph.reverse_edges(graph.knn_graph(table(spark, sf_dir, "embeddings"), 8, "vec_id", "embedding"))
    return found.select("dst", F.array_join("sources", ",").alias("sources"))


@register("proximity_graph")
def proximity_graph(spark, sf_dir):
    return rounded(graph.proximity_graph(table(spark, sf_dir, "embeddings"), 6, 16, "vec_id", "embedding"))


# ---- quantization and cells ----

BOOKS = """c AS (SELECT vec_id AS code, embedding FROM embeddings WHERE vec_id < 16),
j AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS j),
s AS (SELECT e.vec_id, j.j, c.code, {l2} AS d FROM embeddings e, c, j {{where}}),
codes AS (SELECT vec_id, j, code, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, j ORDER BY d, code) AS r FROM s) t WHERE r = 1)""".format(l2=l2("e.embedding[8 * j.j + 1 : 8 * j.j + 8]", "c.embedding[8 * j.j + 1 : 8 * j.j + 8]"))


def fixed_codebooks(spark, sf_dir) -> np.ndarray:
    """Eight codebooks of 16: the parts of the first 16 vectors."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id < 16").orderBy("vec_id").collect()
    return np.stack(np.split(np.array([r.embedding for r in rows], np.float64), 8, axis=1))


@register("pq_codes", f"WITH {BOOKS.format(where='')} SELECT vec_id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY j) AS code FROM codes GROUP BY vec_id")
def pq_codes(spark, sf_dir):
    encoded = pq.encode(table(spark, sf_dir, "embeddings"), fixed_codebooks(spark, sf_dir), "embedding")
    return pq.code_arrays(encoded).select("vec_id", F.array_join("code", ",").alias("code"))


@register("pq_reconstruction_error", f"WITH {BOOKS.format(where='')} SELECT vec_id, round(sum(d), 6) AS error FROM codes GROUP BY vec_id")
def pq_reconstruction_error(spark, sf_dir):
    books = fixed_codebooks(spark, sf_dir)
    return rounded(pq.reconstruction_error(pq.encode(table(spark, sf_dir, "embeddings"), books, "embedding"), books, "vec_id", "embedding"), "error")


ADC = f"""WITH {BOOKS.format(where='')}, q AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 50 = 0),
a AS (SELECT q.qid, codes.vec_id, sum({l2('q.embedding[8 * codes.j + 1 : 8 * codes.j + 8]', 'c.embedding[8 * codes.j + 1 : 8 * codes.j + 8]')}) AS d FROM q, codes JOIN c ON c.code = codes.code GROUP BY 1, 2),
r AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), vec_id) AS INTEGER) AS rank, vec_id, d FROM a)"""


@register("pq_adc_topk", ADC + " SELECT qid, rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 10")
def pq_adc_topk(spark, sf_dir):
    books = fixed_codebooks(spark, sf_dir)
    encoded = pq.encode(table(spark, sf_dir, "embeddings"), books, "embedding")
    return rounded(pq.scan(encoded, books, query_set(spark, sf_dir), 10, "vec_id"))


@register("rerank_topk", f"""WITH q AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT q.qid, e.vec_id, {l2('e.embedding', 'q.embedding')} AS d FROM q JOIN embeddings e ON e.label = q.qid // 50 % 10),
r AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, d FROM d)
SELECT qid, rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 5""")
def rerank_topk(spark, sf_dir):
    """Candidates: for each query the rows labelled with the last digit of qid / 50."""
    base = table(spark, sf_dir, "embeddings")
    wanted = query_set(spark, sf_dir).select("qid", F.expr("cast(qid div 50 % 10 AS int)").alias("label"))
    candidates = base.join(wanted, "label").select("qid", "vec_id")
    return rounded(topk.rerank(candidates, base, query_set(spark, sf_dir), 5, "vec_id", "embedding"))


MEANS = """m AS (SELECT label, d, avg(x) AS mean FROM (SELECT label, CAST(unnest(range(64)) AS INTEGER) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) t GROUP BY 1, 2)"""


@register("kmeans_update", f"WITH {MEANS} SELECT label, d AS dim, round(mean, 6) AS mean FROM m")
def kmeans_update(spark, sf_dir):
    return rounded(kmeans.update(table(spark, sf_dir, "embeddings"), "label", "embedding"), "mean")


@register("ivf_assign", f"""WITH {MEANS}, c AS (SELECT label AS cell, list(mean ORDER BY d) AS v FROM m GROUP BY 1),
s AS (SELECT e.vec_id, c.cell, {l2('e.embedding', 'c.v')} AS d FROM embeddings e, c)
SELECT vec_id, CAST(cell AS INTEGER) AS cell FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cell) AS r FROM s) t WHERE r = 1""")
def ivf_assign(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    rows = kmeans.centroid_arrays(kmeans.update(base, "label", "embedding"), "label").orderBy("label").collect()
    return kmeans.assign(base.select("vec_id", "embedding"), np.array([r.centroid for r in rows]), "embedding").select("vec_id", "cell")


def cell_index(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ordered, centroids = ivf.build(base, "vec_id", "embedding")
    cells = ivf.cells_of(ordered, centroids)
    ivf.tune(ordered, cells, ef=32, id="vec_id", vector="embedding")
    return ordered, cells


@register("ivf_topk")
def ivf_topk(spark, sf_dir):
    ordered, cells = cell_index(spark, sf_dir)
    return rounded(ivf.search_batch(ordered, cells, query_set(spark, sf_dir), 10, 32, "vec_id", "embedding"))


def coded(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    books = pq.train(kmeans.sample(base, "vec_id", "embedding"), 8, 10)
    return pq.encode(base, books, "embedding"), books


@register("hnsw_pq_topk")
def hnsw_pq_topk(spark, sf_dir):
    """The pool is as deep as sample queries need for their recall."""
    encoded, books = coded(spark, sf_dir)
    depth = pq.tune_depth(encoded, books, 10, id="vec_id", vector="embedding")
    return rounded(pq.search(encoded, books, query_set(spark, sf_dir), 10, 64, "vec_id", "embedding", depth=depth))


#: What must hold of an approximate search, whatever it finds: ten hits a query, exact distances, enough recall.
QUALITY = "SELECT count(*) AS queries, 10 * count(*) AS hits, 0 AS wrong, true AS enough FROM embeddings WHERE vec_id % 50 = 0"


def quality(spark, sf_dir, found: DataFrame) -> DataFrame:
    """One row: queries, hits, hits whose distance is not the exact one, and whether recall is 0.9 or more."""
    base, queries = table(spark, sf_dir, "embeddings"), query_set(spark, sf_dir)
    truth = topk.top_k_batch(base, queries, 10, "vec_id", "embedding")
    exact = found.join(base.select("vec_id", "embedding"), "vec_id").join(queries, "qid")
    off = F.abs(l2_distance(F.col("embedding"), F.col("qv")) - F.col("distance")) > 1e-5
    hits = exact.agg(F.lit(1).alias("one"), F.count_distinct("qid").alias("queries"), F.count("*").alias("hits"), F.count_if(off).alias("wrong"))
    recall = metrics.recall(found, truth, 10, "vec_id").select(F.lit(1).alias("one"), (F.col("recall") >= 0.9).alias("enough"))
    return hits.join(recall, "one").drop("one")


@register("ivf_quality", QUALITY)
def ivf_quality(spark, sf_dir):
    return quality(spark, sf_dir, ivf_topk(spark, sf_dir))


@register("hnsw_pq_quality", QUALITY)
def hnsw_pq_quality(spark, sf_dir):
    return quality(spark, sf_dir, hnsw_pq_topk(spark, sf_dir))


# ---- measures ----

RESULTS = """res AS (SELECT event_id, user_id, value AS ms, (event_id % 100) / 100.0 AS selectivity, (event_id % 11) / 10.0 AS recall, event_type AS strategy FROM events)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a log of search results."""
    return table(spark, sf_dir, "events").select(F.col("value").alias("ms"), ((F.col("event_id") % 100) / 100.0).alias("selectivity"), ((F.col("event_id") % 11) / 10.0).alias("recall"), F.col("event_type").alias("strategy"), "user_id")


@register("recall_at_k", f"WITH {BATCH}, t AS (SELECT * FROM r WHERE rank <= 10) SELECT qid, count(*) FILTER (WHERE vec_id % 3 <> 0) / 10.0 AS recall FROM t GROUP BY qid")
def recall_at_k(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    truth = topk.top_k_batch(base, query_set(spark, sf_dir), 10, "vec_id", "embedding")
    found = topk.top_k_batch(base.where("vec_id % 3 <> 0"), query_set(spark, sf_dir), 10, "vec_id", "embedding")
    return metrics.recall_per_query(found, truth, 10, "vec_id")


@register("latency_buckets", f"""WITH {RESULTS}, b AS (SELECT * FROM (VALUES ('tiny', 0.0, 0.02), ('some', 0.02, 0.1), ('many', 0.1, 0.5), ('most', 0.5, 2.0)) t(bucket, low, high))
SELECT bucket, count(*) AS n, round(avg(ms), 6) AS mean_ms, round(avg(recall), 6) AS mean_recall FROM res JOIN b ON selectivity >= low AND selectivity < high GROUP BY bucket""")
def latency_buckets(spark, sf_dir):
    buckets = spark.createDataFrame([("tiny", 0.0, 0.02), ("some", 0.02, 0.1), ("many", 0.1, 0.5), ("most", 0.5, 2.0)], "bucket string, low double, high double")
    return rounded(metrics.latency_buckets(results(spark, sf_dir), buckets), "mean_ms", "mean_recall")


@register("latency_summary", f"WITH {RESULTS} SELECT round(median(ms), 6) AS p50, round(quantile_cont(ms, 0.99), 6) AS p99, round(avg(ms), 6) AS mean FROM res")
def latency_summary(spark, sf_dir):
    return rounded(metrics.latency_summary(results(spark, sf_dir)), "p50", "p99", "mean")


@register("strategy_counts", f"WITH {RESULTS} SELECT strategy, count(*) AS n FROM res GROUP BY strategy")
def strategy_counts(spark, sf_dir):
    return metrics.strategy_counts(results(spark, sf_dir))


GRID = f"""{RESULTS}, grid AS (SELECT user_id % 7 AS low, user_id % 5 AS high, avg(ms) AS mean_ms, avg(recall) AS recall FROM res GROUP BY 1, 2)"""


def grid(spark, sf_dir):
    return results(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("low"), (F.col("user_id") % 5).alias("high")).agg(F.avg("ms").alias("mean_ms"), F.avg("recall").alias("recall"))


@register("grid_best", f"WITH {GRID} SELECT low, high, round(mean_ms, 6) AS mean_ms, round(recall, 6) AS recall FROM grid WHERE recall >= 0.5 ORDER BY grid.mean_ms, low, high LIMIT 1")
def grid_best(spark, sf_dir):
    return rounded(metrics.grid_best(grid(spark, sf_dir), 0.5), "mean_ms", "recall")


@register("interp_at_recall", f"""WITH {RESULTS}, curve AS (SELECT strategy AS engine, recall, avg(ms) + 1 AS value FROM res GROUP BY 1, 2),
s AS (SELECT engine, recall, value, lead(recall) OVER w AS nr, lead(value) OVER w AS nv FROM curve WINDOW w AS (PARTITION BY engine ORDER BY recall, value))
SELECT engine, round(exp(ln(value) + (0.95 - recall) / (nr - recall) * (ln(nv) - ln(value))), 6) AS value FROM s WHERE recall <= 0.95 AND nr >= 0.95 AND nr > recall""")
def interp_at_recall(spark, sf_dir):
    curve = results(spark, sf_dir).groupBy(F.col("strategy").alias("engine"), "recall").agg((F.avg("ms") + 1).alias("value"))
    return rounded(metrics.value_at_recall(curve, 0.95), "value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten products nearest to the first vector that are cheap and in stock."""
    predicate = compile_filter(parse("price < 930 AND in_stock == true"), KINDS)
    found = topk.top_k(products(spark, sf_dir).where(predicate), vector_of(spark, sf_dir, 0), 10, "vec_id")
    return rounded(found.select("id", "distance", "price", "category", "in_stock", "rating"))
