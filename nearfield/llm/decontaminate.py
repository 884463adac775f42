"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some token positions of a stretch and ignore the others, so a stretch with substitutions at
ignored positions hashes like its original.  The hashes of all stretches of the test items are joined with
those of every stretch of the training texts; each hit puts a test item alongside a text, and the tokens on
that diagonal are compared: a stretch of which at least four fifths match counts as an overlap if it has `least`
matching tokens, or four fifths of the item's if those are fewer.  Of such stretches that with the most matches
is taken.

Every overlap holds a run of equal tokens, since substitutions that are a fifth at most cannot cut it up further:
of four tokens, but of three for items of 6, 7, 10, 11 and 15 tokens, and two for those of five.  Runs of that length
are masks too, so no overlap is missed (with the default of `least`).

Tokens are lower-cased words; words that no test item has are unknown and match nothing.  Test items are taken
in blocks of about `block_chars` characters, each sent to the executors and joined there as a sorted table of hashes,
with one pass over the texts a block, so texts are never shuffled.  A block's result is written before the next block is
collected, and its broadcast is given up, so one block at a time is in memory however large the test set.
A single item is never cut: the bound is that of the block and of the longest item.

A hit whose neighbours before it hit too lies on the same diagonal as they do, so only hits that begin such a run are
laid out, in slices of bounded size; a text and an item that repeat one word throughout have a hit for each diagonal,
not for each pair of places.

Edge cases: null or empty texts and items without words overlap with nothing; equal items are all reported; a
repeated row is reported each time; a null item_id or doc_id is reported as null; items of up to four
tokens are looked up whole; an empty table on either side gives no overlaps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import doc_texts, drop_scratch, materialize

TOKEN = re.compile(r"\w+")
#: 1: the token counts, 0: it is ignored.
MASKS = ("1111", "1111111", "1101100111", "1110011011", "11001010010111")
#: Masks of items of a few lengths, whose overlaps may have no run of four.
SHORT_MASKS = {5: "11", 6: "111", 7: "111", 10: "111", 11: "111", 15: "111"}
#: Matching tokens of an overlap.
LEAST = 13
SUBSTITUTION = 4
#: Characters of test items in a block.
BLOCK_CHARS = 8 << 20
#: Hits laid out at a time.
SLICE = 1 << 20
FACTORS = np.random.default_rng(9).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seed_hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each stretch whose counted tokens are all known (not 0)."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    counted = [i for i, c in enumerate(mask) if c == "1"]
    known, one = np.ones(n, bool), ids > 0
    for i in counted:
        known &= one[i : i + n]
    places = np.flatnonzero(known)
    if not len(places):
        return places, np.empty(0, np.uint64)
    hashes = np.zeros(len(places), np.uint64)
    for k, i in enumerate(counted):
        hashes += ids[places + i].astype(np.uint64) * FACTORS[k]
        hashes ^= hashes >> np.uint64(29)
    return places, hashes


def fullest_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(begin, end, matches) of the stretch with the most matches of which at least four fifths match; the first of equal ones."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -SUBSTITUTION))))
    matched = np.concatenate(([0], np.cumsum(same)))
    # For each end the earliest begin: the first place where the score so far was no higher.
    begins = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    end = int(np.argmax(matched - matched[begins]))
    begin = int(begins[end])
    while begin < end and not same[begin]:
        begin += 1
    return begin, end, int(matched[end] - matched[begin])


def needed(tokens: int, least: int = LEAST) -> int:
    """The matching tokens that an overlap with an item of so many tokens has at least."""
    return min(least, -(-SUBSTITUTION * tokens // (SUBSTITUTION + 1)))


class SeedTable:
    """The seed hashes of a block's items under one mask, ordered by hash and by the hash at the place before."""

    def __init__(self, mask: str, items: list[tuple[int, np.ndarray]]):
        self.mask = mask
        parts = [(number, *seed_hashes(ids, mask)) for number, ids in items]
        self.hashes, group = np.unique(np.concatenate([h for _, _, h in parts] or [np.empty(0, np.uint64)]), return_inverse=True)
        self.width = len(self.hashes) + 2
        numbers = np.repeat([n for n, _, _ in parts], [len(p) for _, p, _ in parts]).astype(np.int64)
        places = np.concatenate([p for _, p, _ in parts] or [np.empty(0, np.int64)])
        # The group at the place before in the same item, from 1; 0 if there is none.
        before = np.zeros(len(places), np.int64)
        if len(places) > 1:
            follows = np.flatnonzero((numbers[1:] == numbers[:-1]) & (places[1:] == places[:-1] + 1)) + 1
            before[follows] = group[follows - 1] + 1
        keys = group * self.width + before
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers, self.places = keys[order], numbers[order], places[order]
        self.starts = np.searchsorted(self.keys, np.arange(len(self.hashes) + 1) * self.width)

    def ranges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, first row, last row) of the runs of rows that hit there and not at the places before."""
        at, hashes = seed_hashes(ids, self.mask)
        if not len(at) or not len(self.hashes):
            return (np.empty(0, np.int64),) * 3
        group = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        some = np.flatnonzero(self.hashes[group] == hashes)
        if not len(some):
            return (np.empty(0, np.int64),) * 3
        at, group = at[some], group[some]
        # A text's place without a hit before it has a number that no item has.
        before = np.full(len(at), self.width - 1, np.int64)
        follows = np.flatnonzero(at[1:] == at[:-1] + 1) + 1
        before[follows] = group[follows - 1] + 1
        keys = group * self.width + before
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        place, first, last = np.tile(at, 2), np.concatenate((self.starts[group], high)), np.concatenate((low, self.starts[group + 1]))
        some = last > first
        return place[some], first[some], last[some]


class TestItems:
    """A block of test items with its tables of seed hashes."""

    __test__ = False  # not a test class

    def __init__(self, items: list[tuple[int | None, str]], least: int = LEAST):
        self.least, self.words = least, {}
        kept = [(item, np.array([self.words.setdefault(w, len(self.words) + 1) for w in TOKEN.findall(text.lower())], dtype=np.int64)) for item, text in items]
        kept = [(item, ids) for item, ids in kept if len(ids)]
        self.items, self.ids = [x for x, _ in kept], [x for _, x in kept]
        self.longest = max(map(len, self.ids), default=0)
        short = {n: SHORT_MASKS.get(n, "1" * n) for n in {len(ids) for ids in self.ids} if n < len(MASKS[0]) or n in SHORT_MASKS}
        self.tables = [
            SeedTable(mask, [(number, ids) for number, ids in enumerate(self.ids) if mask in MASKS or short.get(len(ids)) == mask])
            for mask in [*MASKS, *sorted(set(short.values()) - set(MASKS))]
        ]

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """The distinct (item number, diagonal) pairs that some mask hits."""
        width, found = len(ids) + self.longest + 1, np.empty(0, np.int64)
        for table in self.tables:
            place, first, last = table.ranges(ids)
            if not len(place):
                continue
            size = last - first
            total = np.concatenate(([0], np.cumsum(size)))
            for begin in range(0, int(total[-1]), SLICE):
                # The rows from `begin` on: some runs of rows, the first and the last perhaps in part.
                hit = np.arange(begin, min(begin + SLICE, int(total[-1])))
                run = np.searchsorted(total, hit, "right") - 1
                row = first[run] + hit - total[run]
                found = np.union1d(found, table.numbers[row] * width + place[run] - table.places[row] + self.longest)
        return np.stack((found // width, found % width - self.longest), axis=1)

    def alongside(self, text: str) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
        """(item number, (first token in the text, tokens, matching tokens, tokens of the item)) of every diagonal with an overlap fuller than those before."""
        ids = np.fromiter(map(self.words.get, TOKEN.findall(text.lower()), repeat(0)), dtype=np.int64)
        best: dict[int, int] = {}
        for number, diagonal in self.hits(ids).tolist():
            item = self.ids[number]
            low, high = max(0, diagonal), min(len(ids), diagonal + len(item))
            if high - low < max(needed(len(item), self.least), best.get(number, 0) + 1):
                continue
            begin, end, matches = fullest_stretch(ids[low:high] == item[low - diagonal : high - diagonal])
            if matches >= needed(len(item), self.least) and matches > best.get(number, 0):
                best[number] = matches
                yield number, (low + begin, end - begin, matches, len(item))

    def overlaps(self, text: str) -> list[tuple[int | None, int, int, int, int]]:
        """(item_id, first token in the text, tokens, matching tokens, tokens of the item), the best overlap for each item."""
        return [(self.items[number], *x) for number, x in sorted(dict(self.alongside(text)).items())]

    def overlap(self, text: str) -> bool:
        """Whether the text overlaps with any item."""
        return next(self.alongside(text), None) is not None


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[bool, list[tuple[int | None, str]]]]:
    """(whether it is the last, test items) in blocks of about `block_chars` characters."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // block_chars + 1
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield k == n - 1, [(r.item_id, r.text) for r in own.collect()]


def overlaps(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, n_tokens, n_match, n_item): the best overlap of each text and test item that overlap."""
    schema = "doc_id long, item_id long, start long, n_tokens long, n_match long, n_item long"
    docs, parts = doc_texts(documents), []
    for last, block in item_blocks(benchmark, block_chars):
        shared = documents.sparkSession.sparkContext.broadcast(TestItems(block, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc, *x) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for x in shared.value.overlaps(text.as_py())]
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "n_tokens", "n_match", "n_item"])

        found = docs.mapInArrow(run, schema)
        if not last:
            found = materialize(found, "overlaps")
            shared.destroy()
        parts.append(found)
    return reduce(DataFrame.union, parts)


def clean(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `documents`, all columns, that overlap with no test item."""
    written = None
    for last, block in item_blocks(benchmark, block_chars):
        shared = documents.sparkSession.sparkContext.broadcast(TestItems(block, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.overlap(x.as_py() or "") for x in batch.column("text")], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
        if not last:
            documents = materialize(documents, "clean")
            shared.destroy()
            if written is not None:
                drop_scratch(written)
            written = documents
    return documents
