import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from nearfield.llm import queries
from nearfield.llm.common import materialize
from tests.llm.test_near_copies import groups
from tests.llm.test_text import naive_overlaps
from tests.llm.test_tokens import check_layout

pytest.importorskip("public_tokenizers")


def test_names():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and set(queries.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontaminate", "packing"]


def test_stages(spark, docs, none, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    leak = spark.createDataFrame([(200, f"Before it {item} after it", "en", "s", 1)], docs.select(columns).schema)
    kept = docs.select(columns).union(leak)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = materialize(stage(spark, kept, str(tmp_path)), name)
        seen[name] = [r.doc_id for r in kept.select("doc_id").collect()]
        if name != "packing":
            assert kept.columns == columns
    assert set(seen["language_id"]) == {*range(75), None, 200} - {63, 64, 65, 66}
    assert sorted(seen["line_dedup"], key=repr) == sorted(seen["language_id"], key=repr)
    assert 60 not in seen["simhash"] and 74 not in seen["simhash"] and {3, 7, 8, 200} <= set(seen["simhash"])
    assert set(seen["simhash"]) - set(seen["decontaminate"]) == {200}
    assert set(seen["packing"]) == set(seen["decontaminate"])


def test_run_brute_force(spark, tmp_path):
    """The whole pipeline over a small corpus against plain loops for every stage."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    words = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    line, items = "This very line stands in many of the documents here.", [(i, prose(14)) for i in range(2)]
    rows = []
    for i in range(36):
        body = prose(rng.randint(5, 40))
        if i % 6 == 1:
            body = [*prose(10), *items[i % 2][1], *prose(5)]
            body[15] = "substituted"
        text = " ".join(body)
        if i % 3 == 0:
            text += "\n" + line + "\n" + " ".join(prose(6))
        rows.append([i, text])
    for i, k in ((36, 2), (37, 5), (38, 8)):
        copy = rows[k][1].split(" ")
        copy[-1] = "edited"
        rows.append([i, " ".join(copy)])
    rows += [[39, "123 ..."], [40, None], [41, rows[3][1]], [42, prose(9000)]]
    rows[-1][1] = " ".join(rows[-1][1])
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    holders = {}
    for i, t in kept:
        for x in t.split("\n"):
            holders.setdefault(x.strip().lower(), set()).add(i)
    frequent = {k: max(ids) for k, ids in holders.items() if len(k) >= 40 and len(ids) >= 5}
    kept = [(i, "\n".join(x for x in t.split("\n") if frequent.get(x.strip().lower(), i) == i)) for i, t in kept]
    label = groups(kept)
    kept = [row for k, row in enumerate(kept) if label[k] == k]
    tokens = lambda t: re.findall(r"\w+", t.lower())
    clean = [(i, t) for i, t in kept if not naive_overlaps(tokens(t)[:200], items, 13)]
    assert len(rows) - 2 > len(kept) + 2 and len(clean) == len(kept) - 6
    whole = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in clean:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, at, len(own), zlib.crc32(own.tobytes())) for k, at in enumerate(range(0, len(ids), 4096)) for own in [ids[at : at + 4096]]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    check_layout(got, 4096)


def test_empty_tables(spark, none, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
