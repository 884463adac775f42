"""Language identification by rank-order n-gram profiles.

A profile is a language's most frequent n-grams (one to three letters, within words padded by a space) in
order of frequency.  A document's own most frequent n-grams are compared with each profile by the
out-of-place distance: the sum of the differences in rank, and the largest difference where an n-gram is
missing.  The nearest profile wins; equal distances go to the language that sorts first.

N-grams are 63-bit integers made of up to three code points, so counting is sorting; a very long text is
counted in chunks that are merged, each with the two letters before it, so that chunks may end anywhere.  Training counts are summed per task, then per (language, n-gram).

Edge cases: null text, or text without a letter, is `und` with score 0, as is every text when nothing was
learned; rows with null lang or null doc_id teach nothing; repeated rows count as often as they occur.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: N-grams in a profile.
PROFILE = 400
CHUNK = 1 << 20
SPACE = 32


@cache
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    table = np.full(sys.maxunicode + 1, SPACE, dtype=np.uint64)
    for point in range(0x32400):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def run_lengths(ordered: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and how often (or with which weight) each occurs."""
    if not len(ordered):
        return ordered, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(first, len(ordered))) if weights is None else np.add.reduceat(weights, first)
    return ordered[first], counts


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    return run_lengths(codes[order], counts[order])


def chunk_grams(letters: np.ndarray) -> np.ndarray:
    """The codes of the n-grams that end at the third or a later place of an array of letters and spaces."""
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    two = (b << np.uint64(21)) | c
    three = (a << np.uint64(42)) | two
    return np.concatenate((c[c != SPACE], two[(b != SPACE) | (c != SPACE)], three[b != SPACE]))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a text, sorted, with their counts; both empty if it has no letter."""
    table, parts, last = letter_table(), [], np.full(2, SPACE, np.uint64)
    for begin in range(0, len(text), CHUNK):
        points = np.frombuffer(text[begin : begin + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        end = np.full(int(begin + CHUNK >= len(text)), SPACE, np.uint64)
        letters = np.concatenate((last, table[points], end))
        last = letters[-2:]
        grams = chunk_grams(letters)
        if len(grams):
            grams.sort()
            parts.append(run_lengths(grams))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return parts[0] if len(parts) == 1 else merge(parts)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent codes, most frequent first; equal counts by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(documents: DataFrame, teaches: Column, size: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language among the rows where `teaches` holds and lang is known.

    What reaches the driver is `size` n-grams a language.
    """
    pairs = documents.where(teaches & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                held.setdefault(lang, []).append(gram_counts(text.as_py()))
            for lang, parts in held.items():
                held[lang] = [merge(parts)]
            if sum(len(parts[0][0]) for parts in held.values()) > 1 << 21:
                yield from rows(held)
                held = {}
        yield from rows(held)

    def rows(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, [(codes, counts)] in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    grams = pairs.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for lang, gram in top.orderBy("lang", "rank").select("lang", "gram").collect():
        profiles.setdefault(lang, []).append(gram)
    return profiles


class Ranker:
    """Profiles laid out for lookup: the sorted n-grams of all of them, and the rank of each in every one."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.languages, self.size = sorted(profiles), size
        self.codes = np.array(sorted({g for grams in profiles.values() for g in grams}), dtype=np.uint64)
        self.ranks = np.full((len(self.languages), len(self.codes) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.codes, np.array(profiles[lang], dtype=np.uint64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and how near it is from 0 (nothing in common) to 1."""
        codes, counts = gram_counts(text or "")
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.ranks[:, at]
        distance = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))), self.size).sum(axis=1)
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (len(own) * self.size))


def identify(documents: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """All columns of `documents` with lang_pred and score; columns of these names are replaced."""
    kept = documents.select(*[c for c in documents.columns if c not in ("lang_pred", "score")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", lang_pred string, score double"
    ranker = Ranker(profiles, size)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ranker.predict(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"]
            )

    return kept.mapInArrow(predict, schema)
