from nearfield import queries


def test_k_follows_table(spark, monkeypatch):
    """The limit of topk_k_gt_n is above the table's own count, whatever that is."""
    base = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "vec_id long, embedding array<double>")
    asked = []
    monkeypatch.setattr(queries, "table", lambda *args: base)
    whole = queries.topk.top_k
    monkeypatch.setattr(queries.topk, "top_k", lambda b, q, k, *names: asked.append(k) or whole(b, q, k, *names))
    assert queries.topk_k_gt_n(spark, "").count() == 20 and asked == [21]
