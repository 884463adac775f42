"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least `similarity`.

SimHash alone cannot find these: at similarity 0.8 fingerprints of 64 bits differ in up to 14 bits (sf0.1), a distance
at which chance pairs abound.  So the SimHash search at a small distance goes first: its pairs are compared, and what they
tie into one component is not compared again.  A join on shingles completes them, for pairs that are not tied yet.  Under one order of all shingles, common ones last, two sets of that similarity share one of
their first n - ceil(similarity n) + 1 shingles, and the first one they share is among fewer still of the smaller set's (its
short prefix, of n - ceil(2 similarity / (1 + similarity) n) + 1); documents meet on those.  A sketch then tells most candidates apart: the parity of the number of shingles in each
of 1,024 slots, in which two sets never differ by more bits than they do in shingles.  For the rest these numbers themselves
are compared, which tells large sets apart too, and whole sets for what is left then.  No pair is missed, whatever the order; the order only decides how many candidates there are.

A shingle that more than `crowd` sets have among their first gives a star at first, which ties together the members of
a group of near copies without all its pairs; then, where its sets are not all in one component, those pairs that lie in
different ones and whose sketches allow that similarity.  These pairs are compared in the task that has the shingle; its time grows with the square of such a group, the
rows it gives do not where the members differ or are tied already.

Shingles are hashed from the hashes of their words, so a text is hashed word by word and its shingles are sums of arrays.
Tables in the shared folder are deleted as soon as nothing reads them; what stays is one row a kept document.

Edge cases: fewer words than a shingle are one shingle; texts without words (or null) have equal, empty sets; a row
without doc_id is no candidate and stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from nearfield.llm.common import doc_texts, drop_scratch, materialize, partitions
from nearfield.llm.components import connected_components
from nearfield.llm.simhash import SEED, SMALL, WORD, bit_counts, links, signed

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of the SimHash search that gives the first links.
DISTANCE = 2
CROWD = 4
#: The most frequent shingles, whose counts are sent to the executors, and hashes counted at a time.
COMMON = 1 << 18
COUNTED = 1 << 21
BLOCK = 512
#: Groups whose pairs are laid out at a time (of at most `crowd` sets each), and words whose hashes a task keeps.
GROUPS = 512
CACHE_WORDS = 1 << 17
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(5).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words of 64 bits in a sketch.
SKETCH = 16
#: Bits of the bitmap that tells which sets are wanted (8 MB), and those of one row of it.
BITMAP, PART = 1 << 26, 1 << 15


class WordHashes(dict):
    """The hashes of words, taken at their first use; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxh64_intdigest(word, SEED)
        return found


def shingle_hashes(text: str, shingle: int = SHINGLE, hashes_of: WordHashes | None = None) -> np.ndarray:
    """The hashes of a text's shingles, repeated ones included; `hashes_of` keeps the words' hashes from text to text."""
    words = WORD.findall(text.translate(SMALL) if not text.isascii() else text.lower())
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map((hashes_of if hashes_of is not None else WordHashes()).__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    hashes = np.full(n, width, np.uint64)
    for k in range(width):
        hashes += own[k : k + n] * FACTORS[k]
    hashes ^= hashes >> np.uint64(31)
    hashes *= MIX
    return hashes ^ (hashes >> np.uint64(29))


def packed(own: np.ndarray) -> bytes:
    """Shingles as six bytes each."""
    return np.ascontiguousarray(own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    found = np.zeros((len(data) // 6, 8), np.uint8)
    found[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return found.view("<u8").ravel()


def profiles(documents: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, version, fp, sig, size, sketch, own): own has the distinct shingles (48 bits of their hashes) in ascending order, sig is its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()  # of one task: workers live on
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py(), shingle, known)
                own = np.unique(hashes >> np.uint64(16))
                ones = np.flatnonzero(2 * bit_counts(hashes) > len(hashes)).tolist() if len(hashes) else []
                data = packed(own)
                rows.append((signed(sum(1 << i for i in ones)), signed(xxh64_intdigest(data, SEED)), len(own), sketch(own).tobytes(), data))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), *columns], names=["doc_id", "version", "fp", "sig", "size", "sketch", "own"])

    schema = "doc_id long, version long, fp long, sig long, size long, sketch binary, own binary"
    return doc_texts(documents).where("doc_id is not null").withColumn("version", F.xxhash64("text")).mapInArrow(run, schema)


def common_shingles(sets: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in ascending order, counts) of the most frequent ones, about; at most `most`."""

    def counts(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for own in batch.column("own"):
                held.append(unpacked(own.as_py()))
                total += len(held[-1])
                if total >= COUNTED:
                    yield counts(held)
                    held, total = [], 0
        if held:
            yield counts(held)

    found = materialize(sets.select("own").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 3"), "common")
    cut, room = 1 << 62, most
    for r in sorted(found.groupBy("n").agg(F.count("*").alias("held")).collect(), key=lambda r: -r.n):
        room -= r.held
        if room < 0:
            break
        cut = r.n
    rows = found.where(F.col("n") >= cut).toArrow()
    drop_scratch(found)
    values, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(values)
    return values[order], n[order]


def first_shingles(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The shingles of which two similar sets share one: n - ceil(similarity n) + 1, rare ones first."""
    values, counts = common
    count = np.zeros(len(own), np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        count = np.where(values[at] == own, counts[at], 0)
    return own[np.lexsort((own, count))][: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1]


def slot_counts(own: np.ndarray) -> np.ndarray:
    """The number of shingles in each slot, up to 255."""
    return np.minimum(np.bincount((own % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH), 255).astype(np.uint8)


def sketch(own: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each slot, as words of 64 bits."""
    return np.packbits(np.bincount((own % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1).view(np.uint64)


def ordered_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows in chunks that end where the value of the first column ends; batches arrive in its order."""
    held: list[list[np.ndarray]] = []
    names: list[str] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            if not len(batch):
                continue
            names = batch.schema.names
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if held[0][0][0] == held[-1][0][-1]:  # all of one value so far
                continue
        if held:
            own = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = len(own[0]) if batch is None else int(np.searchsorted(own[0], own[0][-1], "left"))
            yield dict(zip(names, (x[:cut] for x in own), strict=True))
            held = [[x[cut:] for x in own]]


def group_starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the end of the last."""
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))


def by_shingle(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "h").sortWithinPartitions("h", "sig")


def may_be_similar(s: np.ndarray, p: np.ndarray, t: np.ndarray, q: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of sizes s and t fit, and the shingle they share is in the short prefix (p, q: 1 if so) of the smaller one."""
    return (np.minimum(s, t) >= similarity * np.maximum(s, t) - 1e-6) & ((p == 1) | (s > t)) & ((q == 1) | (t > s))


def within_groups(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all pairs of rows of the same group, later row first."""
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    later = np.repeat(np.repeat(start, size) + inner, inner)
    return later, later - 1 - (np.arange(len(later)) - np.repeat(np.cumsum(inner) - inner, inner))


#: Rows of `meetings`: a pair (u, v) to be verified, or a set (u) of size v that has the crowded shingle h, in its short prefix or not.
PAIR, CROWDED = 0, 1


def meetings(sets: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """(kind, h, u, v, short): pairs of sets that share a first shingle and fit; of shingles that more than `crowd` sets have, a star, and those sets."""
    common = sets.sparkSession.sparkContext.broadcast(common_shingles(sets))
    names = ["kind", "h", "u", "v", "short"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for sig, own in zip(batch.column("sig").to_pylist(), batch.column("own"), strict=True):
                x = unpacked(own.as_py())
                if len(x):
                    some = first_shingles(x, common.value, similarity).view(np.int64)
                    short = len(x) - int(np.ceil(2 * similarity / (1 + similarity) * len(x) - 1e-9)) + 1
                    out.append((some, np.full(len(some), sig), 2 * len(x) + (np.arange(len(some)) < short)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["h", "sig", "place"])

    def rows(kind: int, h: np.ndarray, u: np.ndarray, v: np.ndarray, short: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (h, u, v, short))], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in ordered_batches(batches):
            h, sig = x["h"], x["sig"]
            once = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]))))
            h, sig, n, p = h[once], sig[once], x["place"][once] >> 1, x["place"][once] & 1
            bounds = group_starts(h)
            start, size = bounds[:-1], np.diff(bounds)
            few = np.flatnonzero((size > 1) & (size <= crowd))
            for k in range(0, len(few), GROUPS):
                i, j = within_groups(start[few[k : k + GROUPS]], size[few[k : k + GROUPS]])
                fit = may_be_similar(n[i], p[i], n[j], p[j], similarity)
                if fit.any():
                    i, j = i[fit], j[fit]
                    yield rows(PAIR, h[i], np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j]), p[i])
            for k in np.flatnonzero(size > crowd).tolist():
                own = slice(start[k], start[k] + size[k])
                yield rows(PAIR, h[own][1:], np.full(size[k] - 1, sig[start[k]]), sig[own][1:], p[own][1:])
                yield rows(CROWDED, h[own], sig[own], n[own], p[own])

    first = sets.select("sig", "own").mapInArrow(emit, "h long, sig long, place long")
    return by_shingle(first).mapInArrow(meet, "kind int, h long, u long, v long, short long")


def crowded_candidates(crowded: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of sets that share a crowded first shingle, lie in different components and may be similar by size, prefix and sketch."""

    def pairs(x: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sig, size, short, component = x["sig"], x["size"], x["short"], x["component"]
        if (component == component[0]).all():
            return
        words = np.frombuffer(b"".join(x["sketch"]), np.uint64).reshape(len(sig), SKETCH)
        for a in range(0, len(sig), BLOCK):
            for b in range(a, len(sig), BLOCK):
                one, two = (slice(a, a + BLOCK), None), (None, slice(b, b + BLOCK))
                fit = may_be_similar(size[one], short[one], size[two], short[two], similarity)
                fit &= (sig[one] < sig[two]) & (component[one] != component[two])
                i, j = np.nonzero(fit)
                i, j = i + a, j + b
                near = sketches_near(words, words, size[i] + size[j], similarity, i, j)
                if near.any():
                    yield sig[i[near]], sig[j[near]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in ordered_batches(batches):
            bounds = group_starts(x["h"]).tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                for u, v in pairs({name: column[a:b] for name, column in x.items()}):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return by_shingle(crowded).mapInArrow(run, "u long, v long")


def sketches_near(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, similarity: float, i: np.ndarray | slice = slice(None), j: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Whether the sets with the sketches a[i] and b[j] (a row each) and these sums of sizes can be similar; a word of the sketches at a time."""
    differ = np.zeros(len(sizes), np.int64)
    for k in range(SKETCH):
        differ += np.bitwise_count(a[i, k] ^ b[j, k])
    return differ <= (1 - similarity) / (1 + similarity) * sizes + 1e-6


def ends(table: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """A table by sig for the joins with either end of a pair: (u, column_u...) and (v, column_v...)."""
    return tuple(table.select(F.col("sig").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)) for end in ("u", "v"))


def sigs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("sig")).union(pairs.select("v")).distinct()


def among(sets: DataFrame, some: DataFrame) -> DataFrame:
    """The (sig, own) of `sets` whose sig is in `some`, and few others: a bitmap of fixed size leaves the rest out, so that they are not shuffled."""
    place = F.col("sig").bitwiseAND(F.lit(BITMAP - 1))
    parts = some.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place % PART).alias("bits")).toArrow()
    bits = np.zeros((BITMAP // PART, PART // 8), np.uint8)
    for part, own in zip(parts.column("part").to_pylist(), parts.column("bits"), strict=True):
        bits[part] = np.frombuffer(own.as_py(), np.uint8)
    wanted = sets.sparkSession.sparkContext.broadcast(bits.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("sig")) & (BITMAP - 1)
            yield batch.filter(pa.array((wanted.value[at >> 3] >> (at & 7)) & 1 == 1))

    return sets.select("sig", "own").mapInArrow(run, "sig long, own binary")


def apart(pairs: DataFrame, tied: DataFrame) -> DataFrame:
    """The pairs (u, v) that `tied` (node, component) has not in one component."""
    one, two = (tied.select(F.col("node").alias(end), F.col("component").alias(f"in_{end}")) for end in ("u", "v"))
    return pairs.join(one, "u", "left").join(two, "v", "left").where(F.coalesce("in_u", "u") != F.coalesce("in_v", "v")).select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, similarity: float, tied: DataFrame | None = None) -> DataFrame:
    """The pairs whose sets are that similar: by sketches, then by slot counts, then by the sets that are left; those that are `tied` already are left out."""
    share = (1 - similarity) / (1 + similarity)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, SKETCH) for c in ("sketch_u", "sketch_v"))
            total = np.asarray(batch.column("size_u")) + np.asarray(batch.column("size_v"))
            own = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(total)], names=["u", "v", "total"])
            yield own.filter(pa.array(sketches_near(a, b, total, similarity)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slot_counts(unpacked(x.as_py())).tobytes() for x in batch.column("own")]
            yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array(found, pa.binary())], names=["sig", "counts"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 64 * SKETCH).astype(np.int16) for c in ("counts_u", "counts_v"))
            near = np.abs(a - b).sum(axis=1) <= share * np.asarray(batch.column("total")) + 1e-6
            yield batch.select(["u", "v"]).filter(pa.array(near))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("own_u"), batch.column("own_v"), strict=True):
                a, b = unpacked(a.as_py()), unpacked(b.as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # Written, so that their size is known to the planner: few pairs are sent to the sketches, not the sketches to them.
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    pairs = materialize(pairs if tied is None else apart(pairs, tied), "pairs")
    one, two = ends(sketches, "sketch", "size")
    near = materialize(pairs.join(one, "u").join(two, "v").select("u", "v", "sketch_u", "sketch_v", "size_u", "size_v").mapInArrow(sketched, "u long, v long, total long"), "near")
    slots = among(sets, sigs(near)).mapInArrow(counted, "sig long, counts binary")
    one, two = ends(slots := materialize(slots.dropDuplicates(["sig"]), "slots"), "counts")
    left = materialize(near.join(one, "u").join(two, "v").select("u", "v", "total", "counts_u", "counts_v").mapInArrow(close, "u long, v long"), "close")
    drop_scratch(pairs, near, slots)
    one, two = ends(own := materialize(among(sets, sigs(left)).dropDuplicates(["sig"]), "sets"), "own")
    found = materialize(left.join(one, "u").join(two, "v").select("u", "v", "own_u", "own_v").mapInArrow(compared, "u long, v long"), "verified")
    drop_scratch(left, own)
    return found


def similar_pairs(sets: DataFrame, similarity: float, distance: int, crowd: int) -> DataFrame:
    """Links (u, v) between sets whose connected parts are those of all pairs of that similarity."""
    prints = materialize(sets.groupBy("fp").agg(F.min("sig").alias("rep")), "prints")
    sketches = materialize(sets.select("sig", "sketch", "size").dropDuplicates(["sig"]), "sketches")
    equal = sets.select("fp", "sig").distinct().join(prints, "fp").select(F.col("sig").alias("u"), F.col("rep").alias("v")).where("u <> v")
    found = verified(links(prints, distance).union(equal), sets, sketches, similarity)
    tied = connected_components(found)
    met = materialize(meetings(sets, similarity, crowd), "meetings")
    found = found.union(verified(met.where(F.col("kind") == PAIR).select("u", "v"), sets, sketches, similarity, tied))
    crowded = met.where(F.col("kind") == CROWDED).select("h", F.col("u").alias("sig"), F.col("v").alias("size"), "short")
    if not crowded.isEmpty():
        so_far = connected_components(found).withColumnRenamed("node", "sig")
        crowded = materialize(crowded.join(so_far, "sig", "left").withColumn("component", F.coalesce("component", "sig")), "crowded")
        mixed = crowded.groupBy("h").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("h")
        rest = crowded.join(mixed, "h", "left_semi").join(sketches.select("sig", "sketch"), "sig").select("h", "sig", "size", "short", "component", "sketch")
        found = found.union(verified(crowded_candidates(rest, similarity), sets, sketches, similarity))
        drop_scratch(crowded, so_far)
    drop_scratch(prints, sketches, met, tied)
    return found


def drop_near_copies(documents: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """The rows of `documents`, all columns, but one for each group of near copies: that with its smallest doc_id, once.

    Rows without a doc_id stay.
    """
    sets = materialize(profiles(documents, shingle), "profiles")
    links_found = similar_pairs(sets, similarity, distance, crowd)
    found = connected_components(links_found).withColumnRenamed("node", "sig")
    firsts = sets.groupBy("sig").agg(F.min(F.struct("doc_id", "version")).alias("first"))
    groups = firsts.join(found, "sig", "left").groupBy(F.coalesce("component", "sig").alias("component")).agg(F.min("first").alias("first"))
    keep = materialize(groups.select(F.col("first.doc_id").alias("_nf_doc"), F.col("first.version").alias("_nf_version")), "keep")
    drop_scratch(sets, links_found)
    rows = documents.where("doc_id is not null").withColumn("_nf_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(keep, (F.col("doc_id") == F.col("_nf_doc")) & (F.col("_nf_hash") == F.col("_nf_version")), "left_semi")
    once = rows.withColumn("_nf_row", F.row_number().over(Window.partitionBy("doc_id", "_nf_hash").orderBy(F.lit(0)))).where("_nf_row = 1")
    return once.select(*documents.columns).union(documents.where("doc_id is null"))
