import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nearfield.llm import line_dedup, repeats, simhash
from nearfield.llm.components import connected_components
from nearfield.llm.suffix_array import suffix_array


@pytest.mark.parametrize("letters", [1, 2, 3, 30])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for n in [0, 1, 2, *(rng.randint(3, 60) for _ in range(150))]:
        s = [rng.randint(0, letters) for _ in range(n)]
        if rng.random() < 0.3 and n:
            s = (s[: max(1, n // 4)] * 5)[:n]
        assert suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def expected_removal(rows):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t, _ in rows]
    for _, b in data:
        seen.update(b[p : p + 400] for p in range(len(b) - 399))
    found = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        found.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(found, key=repr)


@pytest.mark.parametrize("crowd", [repeats.CROWD, 1])
def test_repeats(docs, rows, crowd):
    got = repeats.remove_repeats(docs, crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = expected_removal(rows)
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(w[2] > 0 for w in want) > 8


def test_kept_text_of_many_lines(spark):
    """Time follows the number of lines, with half of them dropped."""
    lines = [f"line {i}" for i in range(200_000)]
    frame = spark.createDataFrame([("\n".join(lines), list(range(0, 200_000, 2))), ("a\nb", [0, 1]), ("a\n\nb\n", [1]), ("", []), ("x", None)], "text string, dropped array<int>")
    begin = time.perf_counter()
    got = [r.kept for r in frame.select(line_dedup.kept_text(F.col("text"), F.col("dropped")).alias("kept")).collect()]
    assert time.perf_counter() - begin < 10
    assert got == ["\n".join(lines[1::2]), "", "a\nb\n", "", "x"]


def test_repeats_of_equal_rows(spark):
    """A thousand rows that are equal, doc_id included, some hundred with a null doc_id, and one that shares a part."""
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    rows = [(7, text, None)] * 1000 + [(None, text, None)] * 100 + [(8, "before " + text[300:900] + " after", None), (9, text[:399], None)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    by_id = {r.doc_id: tuple(r)[1:5] for r in got.collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got.count() == 1102
    assert by_id[7] == by_id[None] == (1500, 1500, 1, empty)
    assert by_id[8] == (613, 600, 1, hashlib.sha256(b"before  after").hexdigest())
    assert by_id[9][1:3] == (0, 0)


def test_repeats_across_edits(spark):
    """Windows whose flanks differ, at every distance from an edit."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(900)
    rows = [(i, letters(rng.randint(0, 90)) + passage[: 400 + 7 * i] + letters(50) + passage[rng.randint(0, 500) :], None) for i in range(25)]
    rows += [(99, passage[:399], None), (98, passage[:400], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = expected_removal(rows)
    for crowd in (repeats.CROWD, 3):
        got = repeats.remove_repeats(df, crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_repeats_empty(none):
    assert repeats.remove_repeats(none).count() == 0


def expected_lines(rows, chars=40, docs=5):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    for i, t, _ in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                holders[key(x)].add(i)
    frequent = {k: max(v) for k, v in holders.items() if len(k) >= chars and len(v) >= docs}
    found = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or frequent.get(key(x), i) == i]
        found.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(found, key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_lines(docs, rows, batches):
    got = line_dedup.digest(line_dedup.line_dedup(docs, n_batches=batches)).collect()
    want = expected_lines(rows)
    assert sorted(map(tuple, got), key=repr) == want and sum(w[2] for w in want) > 8


def test_lines_native(docs):
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_drop_lines(docs, none, rows):
    got = line_dedup.drop_lines(docs)
    assert got.schema == docs.schema and got.count() == len(rows)
    assert all(r.n_chars == len(r.text or "") for r in got.collect())
    assert line_dedup.drop_lines(none).count() == 0 and line_dedup.line_dedup(none).count() == 0


def print_of(text, n=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprint(monkeypatch, rows):
    monkeypatch.setattr(simhash, "STRETCH", 7)
    assert all(simhash.fingerprint(t or "") == print_of(t) for _, t, _ in rows if len(t or "") < 5000)


def parts(prints, distance):
    """Smallest id reachable, by brute force."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(docs, rows, none):
    prints = {i: print_of(t) for i, t, _ in rows if i is not None}
    want = parts(prints, 2)
    by_print = {prints[i]: c for i, c in want.items()}
    got = simhash.digest(simhash.near_duplicates(docs)).collect()
    assert len(got) == len(rows)
    for r, (i, text) in zip(sorted(got, key=lambda r: (repr(r.doc_id), r.fingerprint)), sorted(((i, t) for i, t, _ in rows), key=lambda x: (repr(x[0]), f"{print_of(x[1]):016x}")), strict=True):
        assert (r.doc_id, r.fingerprint, r.component_id) == (i, f"{print_of(text):016x}", by_print.get(print_of(text)))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_duplicates(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert simhash.drop_duplicates(none).count() == 0


@pytest.mark.parametrize("bucket_rows", [2048, 1])
@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links(spark, distance, bucket_rows):
    """Chains and crowds of fingerprints a few bits apart."""
    rng = random.Random(distance)
    prints, value = {}, rng.getrandbits(64)
    for i in range(150):
        value = rng.getrandbits(64) if i % 10 == 0 else value ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        prints[i] = value
    rep = {v: min(i for i in prints if prints[i] == v) for v in prints.values()}
    frame = spark.createDataFrame([(simhash.signed(v), i) for v, i in rep.items()], "fp long, rep long")
    found = {r.node: r.component for r in connected_components(simhash.links(frame, distance, bucket_rows=bucket_rows)).collect()}
    want = parts(prints, distance)
    assert {i: found.get(rep[v], rep[v]) for i, v in prints.items()} == want and len(set(want.values())) < 140


def test_thresholds():
    groups = [list(range(0, 20)), list(range(20, 40)), list(range(40, 64))]
    chosen = simhash.thresholds([10, 10**9, 10], np.full(64, 0.5), groups, 2, 1000)
    assert sum(chosen) == 0 and chosen[1] == -1
    assert sorted(b for g in simhash.group_bits(100, np.diag([50] * 64), 3) for b in g) == list(range(64))


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 900), (900, 3), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 7: 3, 900: 3}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
