import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import near_copies

WORDS = [f"w{i}" for i in range(400)]


def corpus():
    """Chains of edits, a crowd of copies with one edit each, and a passage that very many share."""
    rng = random.Random(11)
    prose = lambda n: [rng.choice(WORDS) for _ in range(n)]
    texts, passage, crowd = [], prose(40), prose(150)
    for i in range(120):
        if i % 6:
            text = list(texts[-1])
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
        else:
            text = prose(rng.randint(20, 150)) + passage
        texts.append(text)
    for _ in range(50):
        text = list(crowd)
        text[rng.randrange(150)] = "edited" + str(rng.random())
        texts.append(text)
    texts += [["one"], ["one"], ["one", "two"], [], []]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def groups(rows, similarity=0.8):
    """The smallest id of each document's group, by comparing all pairs."""
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := t.split()) else frozenset() for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = [x if k == y else k for k in label]
    return label


@pytest.mark.parametrize("crowd", [64, 4])
def test_near_copies(spark, crowd):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in near_copies.drop_near_copies(frame, crowd=crowd).collect())
    want = sorted(set(groups(rows)))
    assert got == want and 20 < len(want) < 110


def test_stage(spark):
    """The pipeline's stage removes a near copy whose fingerprint is not within two bits."""
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, frame, "").collect())
    assert got == sorted(set(groups(rows)))
    none = frame.limit(0)
    assert corpus_pipeline.drop_copies(spark, none, "").count() == 0


def test_unwanted_sets_are_not_shuffled(spark, monkeypatch):
    """Where the wanted sets are too many to be broadcast, the sets are not joined with them, and none is lost."""
    frame = spark.range(4000).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 40), k -> concat('w', id div 2 * 40 + k)), if(id % 2 = 1, 'x', 'y')) text")
    sets = near_copies.materialize(near_copies.profiles(frame, 5), "profiles")
    pairs = sets.where("doc_id < 100").groupBy(F.expr("doc_id div 2")).agg(F.min("sig").alias("u"), F.max("sig").alias("v")).select("u", "v")
    want = {(r.u, r.v) for r in pairs.collect()}
    plans, write = {}, near_copies.materialize
    monkeypatch.setattr(near_copies, "materialize", lambda df, name: write(plans.setdefault(name, df), name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = near_copies.verified(pairs, sets, sets.select("sig", "sketch", "size"), 0.8)
        assert {(r.u, r.v) for r in found.collect()} == want and len(want) == 50
        assert all("Join" not in plans[name]._jdf.queryExecution().executedPlan().toString() for name in ("slots", "sets"))
        assert plans["slots"].count() < 110
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert near_copies.among(sets, sets.select("sig").limit(0)).count() == 0


def test_simhash_spares_comparisons(spark, monkeypatch):
    """What the SimHash search ties is not compared again by the join on shingles, and the groups stay those of all pairs."""
    rng = random.Random(3)
    rows = corpus()
    for i in range(40):
        text = [rng.choice(WORDS) for _ in range(600)]
        rows += [(len(rows) + k, " ".join([*text[:-1], f"end{k}"])) for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    written, write = [], near_copies.materialize

    def keep(df, name):
        out = write(df, name)
        if name in ("pairs", "verified"):
            written.append((name, [(r.u, r.v) for r in out.select("u", "v").collect()]))
        return out

    monkeypatch.setattr(near_copies, "materialize", keep)
    got = sorted(r.doc_id for r in near_copies.drop_near_copies(frame).collect())
    assert got == sorted(set(groups(rows)))
    assert [name for name, _ in written] == ["pairs", "verified"] * 3  # SimHash, the join, its crowded shingles
    label = {}
    for u, v in written[1][1]:
        a, b = label.setdefault(u, u), label.setdefault(v, v)
        label = {k: a if c == b else c for k, c in label.items()}
    assert len(label) > 40
    assert written[2][1] and all(label.get(u, u) != label.get(v, v) for u, v in written[2][1])
