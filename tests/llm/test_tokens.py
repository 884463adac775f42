import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import packing, token_files, tokens, topk

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    return [(i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")) for i, t, _ in rows]


def test_words_equal_whole(rows, ids):
    odd = ["it's we've 'tis 's x's'll", "a_b __ c-d 1a2b 3.14", "tab\tnew\nline\r\n", "çÀÿ× ÷ ß ¼ ª", "“quotes” – dash… • a‧b", "nb sp é", "<|startoftext|> x <| y", "ﬁ Ǆ Σ", "x" * 500]
    whole = tokens.WordTokenizer(PATH).whole
    for words in (tokens.WordTokenizer(PATH), tokens.WordTokenizer(PATH, cache_words=20)):
        assert all(np.array_equal(words.ids(t or ""), own[:-1]) for (_, t, _), (_, own) in zip(rows, ids, strict=True))
        assert all(words.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids for t in odd)
    assert [("ab cd ef"[a:b]) for a, b in tokens.cuts("ab cd ef", 3)] == ["ab cd", " ef"]


def test_other_file(rows):
    """A file whose split is another goes to the library whole."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    words = tokens.WordTokenizer(path)
    assert words.known is None
    for _, text, _ in rows:
        assert words.ids(text or "").tolist() == words.whole.encode(text or "", add_special_tokens=False).ids


def test_long_text():
    """Texts that are cut into several chunks here."""
    rng = random.Random(3)
    words = tokens.WordTokenizer(PATH)
    for text in (" ".join(rng.choice(["it's", "plain", "Text,", "of", "42", "words\n"]) for _ in range(500_000)), "x" * (3 << 19) + " y" + "z1" * (1 << 20)):
        assert len(tokens.cuts(text)) > 1
        assert words.ids(text).tolist() == words.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("values", [[0], [5] * 700, list(range(1024)), [2**32 - 1, 0], [1, 2, 3, 2**31, 9, 9, 9, 9, 9, 9, 9]])
def test_block(values):
    data = np.array(values, np.uint32)
    for percentile in (0.01, 0.9, 1.0):
        assert np.array_equal(token_files.unpack_block(memoryview(token_files.pack_block(data, percentile))), data)


def test_shard():
    rng = np.random.default_rng(1)
    own = [rng.integers(0, 50_000, n, dtype=np.uint32) for n in (0, 1, 3000, 17, 1024)]
    image = token_files.pack_shard([5, 6, 7, 8, -9], own)
    shard = token_files.Shard(image)
    assert shard.doc_ids.tolist() == [5, 6, 7, 8, -9] and all(np.array_equal(shard.document(k), x) for k, x in enumerate(own))
    assert len(image) < 4 * sum(map(len, own))
    with pytest.raises(ValueError):
        token_files.Shard(b"nope" + image[4:])


def test_token_files(docs, none, ids):
    want, start = [], 0
    for i, own in sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1].tobytes()))):
        want.append((i, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    for size in (token_files.SHARD_IDS, 300):
        got = sorted(token_files.read_documents(token_files.write_shards(docs, PATH, shard_ids=size)).collect(), key=lambda r: r.start)
        assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
        order = [r.doc_id for r in got]
        assert order == sorted(order, key=lambda i: (i is not None, i or 0))
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert token_files.read_documents(token_files.write_shards(none, PATH)).count() == 0
    shards = token_files.write_shards(docs, PATH, shard_ids=300)
    held = {i: own.tolist() for i, own in ids}
    assert {r.doc_id: r.ids for r in token_files.lookup(shards, [3, 68, 40, 999]).collect()} == {i: held[i] for i in (3, 68, 40)}
    assert token_files.lookup(shards, [74]).count() == 2 and token_files.lookup(shards, []).count() == 0


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(docs, none, ids, capacity):
    got = packing.pack_documents(docs, PATH, capacity).collect()
    want = [(i, k, a, len(own[a : a + capacity]), zlib.crc32(own[a : a + capacity].tobytes())) for i, own in ids for k, a in enumerate(range(0, len(own), capacity))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    check_layout(got, capacity)
    assert packing.pack_documents(none, PATH).count() == 0


def check_layout(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= capacity
    return len(held)


def first_fit(counts, capacity):
    """Bins of first fit, longest first."""
    gaps = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            at = next((i for i, g in enumerate(gaps) if g >= n), None)
            if at is None:
                gaps.append(capacity - n)
            else:
                gaps[at] -= n
    return len(gaps)


def test_plan():
    rng = random.Random(6)
    for capacity in (10, 100, 500):
        for _ in range(30):
            counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 40))}
            patterns = packing.plan(dict(counts), capacity)
            used = {}
            for p in patterns:
                assert 0 < sum(p.lengths) <= capacity and p.times > 0
                for n in p.lengths:
                    used[n] = used.get(n, 0) + p.times
            assert used == counts
            total = sum(n * c for n, c in counts.items())
            bins = sum(p.times for p in patterns)
            assert -(-total // capacity) <= bins <= 1.05 * first_fit(counts, capacity) + 1
    assert packing.plan({}, 10) == []
    exact = packing.plan({7: 5, 3: 5, 4: 4, 2: 2, 5: 2}, 10)
    assert all(sum(p.lengths) == 10 for p in exact) and sum(p.times for p in exact) == 8


def test_sum_index():
    """What the index finds, against all combinations, while pieces are used up."""
    rng = random.Random(9)
    for _ in range(60):
        left = np.zeros(41, np.int64)
        for _ in range(rng.randint(1, 12)):
            left[rng.randint(1, 40)] = rng.randint(1, 3)
        index = packing.SumIndex(left)
        while left.any():
            length = rng.choice(np.flatnonzero(left).tolist())
            for most in (1, 2, 3):
                gap = 40 - length
                pieces = Counter({n: int(left[n]) for n in np.flatnonzero(left).tolist()})
                pieces[length] -= 1
                own = list(pieces.elements())
                possible = gap == 0 or any(sum(some) == gap for n in range(1, most + 1) for some in combinations(own, n))
                found = index.fill(gap, length, most)
                assert (found is not None) == possible
                if found is not None:
                    assert sum(found) == gap and len(found) <= most and not Counter(found) - pieces
            left[rng.choice(np.flatnonzero(left).tolist())] -= 1


def test_plan_is_exact():
    """Complements fill what they can: with all sums at hand no sequence of the plan has a gap."""
    for counts in ({5: 4, 3: 4, 2: 4}, {9: 3, 1: 3}, {6: 2, 2: 4}, {4: 3, 3: 6}):
        assert all(sum(p.lengths) == 10 for p in packing.plan(dict(counts), 10))


def test_place_numbers():
    found = packing.places([packing.Pattern((3, 3, 4), 2), packing.Pattern((3,), 1)])
    assert [x.tolist() for x in found[3]] == [[0, 2, 4], [0, 0, 2], [0, 3, 0]] and [x.tolist() for x in found[4]] == [[0], [0], [6]]


def brute(vectors, k):
    usable = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    found = []
    for i in usable:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(usable[i], usable[j], strict=True)), j) for j in usable if j != i and len(usable[j]) == len(usable[i]))
            found += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(found)


@pytest.mark.parametrize("scale", [1.0, 2.0**19])
def test_topk(spark, scale):
    rng = np.random.default_rng(2)
    x = (rng.integers(-3, 4, (400, 8)) / 7 * scale).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(450, None), (451, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (501, [float("inf")] * 8), (550, [1.0, 2.0]), (551, [0.5, 0.5]), (600, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"score": F.lit("clash"), "ids": F.lit("clash")}).repartition(3)
    want = brute(vectors, 5)
    for batch, block in ((8192, 256), (3, 16)):
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, query_batch=batch, block=block).collect()
        assert sorted(map(tuple, got)) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
