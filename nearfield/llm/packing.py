"""Packing of token pieces into sequences by exact-complement hashing, then best fit.

The plan is made on the counts of piece lengths (as many as the capacity), so its size does not depend on the
corpus.  An index holds, for each sum up to the capacity, the single length, the pairs and the triples of lengths that
add up to it; entries are made when a sum is first asked for and are left behind once their pieces are used up.  For
each length, longest first, the gap it leaves in a sequence is looked up among single lengths, pair sums and
triple sums; a combination with pieces left that fills the gap exactly is consumed as often as its counts allow.
What is left is packed best fit, longest first: into the open sequences with the smallest gap that takes the
length, all equal pieces at once.

Filling gaps with single lengths never costs a sequence, since an optimal packing with that pair exists.  Pairs and
triples use up short pieces that the residuals may need more; so plans with complements of up to one, two and three
pieces are made, and the one with the fewest sequences is taken.

A pattern is a list of lengths and the number of sequences so filled.  Pieces of one length are numbered
0, 1, 2, ... across the corpus (numbers within hash buckets of doc_id plus the counts of the buckets before)
and the k-th takes the k-th place that the plan has for its length.

Edge cases: null text is empty, and a document's end id makes it a piece of one; equal rows are packed each,
numbered apart by the hash of the text; null doc_ids are packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import doc_texts, materialize, partitions
from nearfield.llm.tokens import END_ID, tokenizer

CAPACITY = 4096


@dataclass
class Pattern:
    lengths: tuple[int, ...]
    times: int


class SumIndex:
    """Single, pair and triple sums of the lengths with pieces left.

    `left` holds the count of each length and only goes down.  For each sum the larger member of its pairs and the
    largest of its triples are listed, longest first, with a mark behind those that are used up for good.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.lengths = np.flatnonzero(left)[::-1]
        self.pairs: dict[int, list] = {}
        self.triples: dict[int, list] = {}

    def listed(self, index: dict[int, list], total: int, share: int) -> list:
        """[members, mark] for a sum: the lengths of at least a `share`-th of it and below it, longest first."""
        if total not in index:
            some = self.lengths[(share * self.lengths >= total) & (self.lengths < total)]
            if share == 2:
                some = some[self.left[total - some] > 0]
            index[total] = [some.tolist(), 0]
        return index[total]

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.left[total] > 0 else None

    def pair(self, total: int, taken: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """Two lengths of that sum with pieces left besides those taken."""
        if total < 2:
            return None
        entry, left = self.listed(self.pairs, total, 2), self.left
        members = entry[0]
        for at in range(entry[1], len(members)):
            a, b = members[at], total - members[at]
            twice = int(a == b)
            if left[a] <= twice or left[b] < 1:
                if at == entry[1]:
                    entry[1] += 1
            elif left[a] - taken.count(a) > twice and left[b] - taken.count(b) > 0:
                return a, b
        return None

    def triple(self, total: int, taken: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """Three lengths of that sum with pieces left besides those taken."""
        if total < 3:
            return None
        entry, left = self.listed(self.triples, total, 3), self.left
        members = entry[0]
        for at in range(entry[1], len(members)):
            a = members[at]
            rest = self.listed(self.pairs, total - a, 2) if total - a > 1 else None
            if left[a] < 1 or rest is None or rest[1] == len(rest[0]):
                if at == entry[1]:
                    entry[1] += 1
            elif left[a] > taken.count(a) and (found := self.pair(total - a, (*taken, a))):
                return a, *found
        return None

    def fill(self, gap: int, length: int, most: int) -> tuple[int, ...] | None:
        """Up to `most` lengths that fill the gap beside one piece of `length`."""
        if gap == 0:
            return ()
        if most > 0 and self.left[gap] > int(gap == length):
            return (gap,)
        return (self.pair(gap, (length,)) if most > 1 else None) or (self.triple(gap, (length,)) if most > 2 else None)


def complements(left: np.ndarray, capacity: int, most: int = 3) -> list[Pattern]:
    """Sequences filled exactly by a piece and up to `most` others; `left` (count of each length) is reduced."""
    patterns, index = [], SumIndex(left)
    for length in np.flatnonzero(left)[::-1].tolist():
        while left[length] and (found := index.fill(capacity - length, length, most)) is not None:
            lengths = (length, *found)
            need = Counter(lengths)
            times = min(int(left[x]) // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= times * n
            patterns.append(Pattern(lengths, times))
    return patterns


def best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """The remaining pieces, longest first, each into the fullest open sequence that takes it."""
    by_gap: dict[int, list[Pattern]] = {}
    gaps: list[int] = []

    def put(pattern: Pattern, gap: int) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append(pattern)

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    put(Pattern((length,) * each, whole), capacity - each * length)
                if rest:
                    put(Pattern((length,) * rest, 1), capacity - rest * length)
                break
            gap = gaps[at]
            pattern = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], gaps[at]
            fits = gap // length
            whole, rest = divmod(n, fits)
            if whole >= pattern.times:
                whole, rest = pattern.times, 0
            n -= whole * fits + rest
            if whole:
                put(Pattern(pattern.lengths + (length,) * fits, whole), gap - fits * length)
            if rest:
                put(Pattern(pattern.lengths + (length,) * rest, 1), gap - rest * length)
            if over := pattern.times - whole - bool(rest):
                put(Pattern(pattern.lengths, over), gap)
        left[length] = 0
    return [p for found in by_gap.values() for p in found]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use every piece of the counted lengths exactly once: the shortest of the plans with complements of up to one, two and three pieces."""
    plans = []
    for most in (3, 2, 1):
        left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            left[length] = n
        plans.append(complements(left, capacity, most) + best_fit(left, capacity))
    return min(plans, key=lambda patterns: sum(p.times for p in patterns))


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length (first number, first sequence, offset) of the runs of places the plan has for it."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern in patterns:
        offset = 0
        for length in pattern.lengths:
            runs.setdefault(length, []).append((taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + pattern.times
            offset += length
        sequence += pattern.times
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) for length, found in runs.items()}


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, version, piece, start, length, ids_crc32): every text with its end id, cut only where longer than the capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                ids = np.append(words.ids(text), np.uint32(END_ID)).astype("<u4")
                version = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                rows += [(doc_id, version, k, at, len(own := ids[at : at + capacity]), zlib.crc32(own.tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "version", "piece", "start", "length", "ids_crc32"])

    return doc_texts(documents).mapInArrow(cut, "doc_id long, version long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with doc_id, version, piece, length up to the capacity) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = materialize(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "version"), F.lit(4 * partitions(spark)))), "pieces")
    counts = materialize(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = places(plan({x.length: x.n for x in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "version", "piece")) - 1
    numbered = pieces.withColumn("number", number).join(bases, ["length", "bucket"]).withColumn("number", F.col("number") + F.col("base")).drop("bucket", "base")
    shared = spark.sparkContext.broadcast(found)  # bounded: some patterns a length, and lengths up to the capacity
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields if f.name != "number") + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = (np.asarray(batch.column(c)) for c in ("length", "number"))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(some):
                    first, base, at = shared.value[int(lengths[some[0]])]
                    run = np.searchsorted(first, numbers[some], side="right") - 1
                    sequence[some], offset[some] = base[run] + numbers[some] - first[run], at[run]
            kept = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return numbered.mapInArrow(place, schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    packed = pack(token_pieces(documents, tokenizer_path, capacity), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
