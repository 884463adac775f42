"""SimHash near-dedup with generalised pigeonhole search.

A fingerprint bit is 1 if it is set in over half the hashes of a text's word shingles.  Pairs of fingerprints
at Hamming distance up to d are found exactly: the 64 bits are grouped into partitions of correlated bits
(correlations counted over all fingerprints), and each partition i gets a threshold t_i, -1 to skip it, with
sum d - m + 1 over the m partitions; two fingerprints within d then agree up to t_i bits in some partition i.
Dynamic programming picks the thresholds with the smallest estimated number of candidates: the pairs equal in
a partition, counted over all fingerprints, times the bits' own odds of differing.

Index and probes meet in buckets by partition value.  A bucket's candidates are verified there and leave as
a spanning star for each linked part, never as all pairs.  Buckets over `bucket_rows` rows are not gathered:
their fingerprints meet on the values within half the distance of each, where a minimum per value replaces
the group (two fingerprints within d share such a value, and all that share one are within d).

Links lie between distinct fingerprints, each represented by its smallest doc_id; the components of the links
come from star contraction, so documents of one component share its smallest doc_id.

Edge cases: a text without words (or null) has fingerprint zero, linked like any other; fewer words than a
shingle are one shingle; repeated rows and copies share a fingerprint; a row with a null doc_id gets the
component of an equal fingerprint, or null; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from nearfield.llm.common import doc_texts, materialize, partitions
from nearfield.llm.components import connected_components
from nearfield.llm.line_dedup import LOWER, UPPER

BITS = 64
SEED = 42
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans(UPPER, LOWER)
#: For each byte value eight lanes of 0 or 1, lowest bit first.
LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)
STRETCH = 1 << 16
BUCKET_ROWS = 2048


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    lanes = LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    sums = [lanes[i : i + 255].sum(axis=0, dtype=np.uint64).view(np.uint8) for i in range(0, len(lanes), 255)]
    return np.sum(sums, axis=0, dtype=np.int64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The SimHash of a text, unsigned."""
    words = (m[0] for m in WORD.finditer(text.translate(SMALL) if not text.isascii() else text.lower()))
    held: list[str] = []
    ones, total = np.zeros(BITS, np.int64), 0
    while True:
        more = list(islice(words, STRETCH))
        stretch = held + more
        if not more:
            if total == 0 and held:  # fewer words than a shingle
                return xxh64_intdigest(" ".join(held), SEED)
            break
        if len(stretch) >= shingle:
            hashes = [xxh64_intdigest(" ".join(s), SEED) for s in zip(*(stretch[i:] for i in range(shingle)), strict=False)]
            ones += bit_counts(np.array(hashes, dtype=np.uint64))
            total += len(hashes)
        held = stretch[max(0, len(stretch) - shingle + 1) :] if len(stretch) >= shingle else stretch
    if not total:
        return 0
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, version, fp): fp holds the 64 bits as a signed long, version is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(x.as_py(), shingle)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(found, pa.int64())], names=["doc_id", "version", "fp"])

    return doc_texts(documents).withColumn("version", F.xxhash64("text")).mapInArrow(run, "doc_id long, version long, fp long")


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def co_occurrence(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each two bits how many have both; summed by Spark to 4,096 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = bit_matrix(np.asarray(batch.column("fp"))).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS), pa.int32()), pa.array(total.ravel())], names=["cell", "n"])

    rows = distinct.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS, np.int64)
    for row in rows:
        both[row.cell] = row.n
    return distinct.count(), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size; each takes the free bit most correlated with those it has."""
    p = both.diagonal() / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, groups))) // (m - k)
        inner = correlation[np.ix_(free, free)].sum(axis=1)
        group = [free.pop(int(np.argmax(inner)))]
        while len(group) < size:
            group.append(free.pop(int(np.argmax(correlation[np.ix_(free, group)].sum(axis=1)))))
        groups.append(sorted(group))
    return groups


def thresholds(equal_pairs: list[int], p: np.ndarray, groups: list[list[int]], distance: int, n: int) -> list[int]:
    """The thresholds, -1 to `distance` each and distance - m + 1 in all, with the fewest estimated candidates and probes."""
    from math import comb

    cost: list[dict[int, float]] = []
    for pairs, group in zip(equal_pairs, groups, strict=True):
        differ = 2 * p[group] * (1 - p[group])
        odds = np.zeros(distance + 1)
        odds[0] = 1  # elementary symmetric polynomials of the odds of each bit to differ
        for r in differ / (1 - np.minimum(differ, 0.999)):
            odds[1:] = odds[1:] + r * odds[:-1]
        own = {-1: 0.0}
        for t in range(distance + 1):
            own[t] = pairs * odds[: t + 1].sum() + n * sum(comb(len(group), j) for j in range(t + 1))
        cost.append(own)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, chosen) in best.items():
            for t, c in own.items():
                if used + t not in step or so_far + c < step[used + t][0]:
                    step[used + t] = (so_far + c, [*chosen, t])
        best = step
    return best[distance - len(groups) + 1][1]


def gather_bits(fp, group: list[int]):
    """The bits of a partition as one long, in runs of neighbouring bits."""
    value, at, k = F.lit(0).cast("long"), 0, 0
    while k < len(group):
        end = k
        while end + 1 < len(group) and group[end + 1] == group[end] + 1:
            end += 1
        length = end - k + 1
        mask = (1 << length) - 1
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, group[k]).bitwiseAND(F.lit(signed(mask))), at))
        at, k = at + length, end + 1
    return value


def star_edges(reps: np.ndarray, fps: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning star for each part of a bucket that the symmetric matrix `near` connects."""
    edges, free = [], np.ones(len(reps), bool)
    for start in np.argsort(reps, kind="stable").tolist():
        if not free[start]:
            continue
        reached = np.zeros(len(reps), bool)
        reached[start] = True
        front = reached
        while front.any():
            grown = near[front].any(axis=0) & ~reached
            reached |= grown
            front = grown
        free &= ~reached
        edges += [(int(r), int(reps[start])) for r in np.unique(reps[reached]) if r != reps[start]]
    return edges


def hamming(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ fps[None, :])


def verified(rows: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) inside buckets (part, key); buckets arrive whole and of bounded size."""

    def bucket(reps: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        if len(reps) < 2:
            return []
        near = hamming(fps) <= distance
        return star_edges(reps, fps, near) if near.sum() > len(reps) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                part, key, rep, fp = (np.asarray(batch.column(c)) for c in ("part", "key", "rep", "fp"))
                own = (part, key, rep, fp.view(np.uint64))
                held = own if held is None else tuple(np.concatenate(x) for x in zip(held, own, strict=True))
            if held is None:
                return
            part, key, rep, fp = held
            cut = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = [0, *cut.tolist()] + ([len(part)] if batch is None else [])
            edges = [e for a, b in zip(bounds[:-1], bounds[1:], strict=True) for e in bucket(rep[a:b], fp[a:b])]
            held = tuple(x[bounds[-1] :] for x in held)
            if edges:
                u, v = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.select("part", "key", "rep", "fp").mapInArrow(run, "u long, v long")


def variants(value, bits: list[int], radius: int):
    """The values within `radius` of `value`, flipping single bits of those given."""
    masks = [signed(sum(1 << b for b in some)) for r in range(radius + 1) for some in combinations(bits, r)]
    return F.transform(F.array(*[F.lit(x).cast("long") for x in masks]), lambda x: x.bitwiseXOR(value))


def crowded_links(rows: DataFrame, distance: int) -> DataFrame:
    """Links among fingerprints of buckets too large to gather: by values that lie between, with minima only."""
    fps = rows.select("fp", "rep").distinct()
    near = fps.select(F.explode(variants(F.col("fp"), list(range(BITS)), distance // 2)).alias("key"), "rep")
    far = near if distance % 2 == 0 else fps.select(F.explode(variants(F.col("fp"), list(range(BITS)), distance - distance // 2)).alias("key"), "rep")
    centres = near.groupBy("key").agg(F.min("rep").alias("v"))
    return far.join(centres, "key").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()


def links(distinct: DataFrame, distance: int = 2, m: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) between representatives whose connected parts are those of all pairs within `distance`.

    `distinct` has one row (fp, rep) for each fingerprint.
    """
    n, both = co_occurrence(distinct)
    groups = group_bits(n, both, m)
    values = [gather_bits(F.col("fp"), group) for group in groups]
    index = distinct.select("fp", "rep", F.posexplode(F.array(*values)).alias("part", "key"))
    sizes = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    pairs = {r.part: int(r.n) for r in sizes.groupBy("part").agg(F.sum(F.col("n") * F.col("n")).alias("n")).collect()}
    chosen = thresholds([pairs.get(i, 0) for i in range(m)], both.diagonal() / max(1, n), groups, distance, n)
    rows = None
    for part, (group, t) in enumerate(zip(groups, chosen, strict=True)):
        if t < 0:
            continue
        own = index.where(F.col("part") == part)
        if t:
            own = own.select("fp", "rep", "part", F.explode(variants(F.col("key"), list(range(len(group))), t)).alias("key"))
        rows = own if rows is None else rows.unionByName(own)
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["part", "key"])
    gathered = rows.where(F.col("n") <= bucket_rows).repartition(partitions(distinct.sparkSession), "part", "key").sortWithinPartitions("part", "key")
    return verified(gathered, distance).union(crowded_links(rows.where(F.col("n") > bucket_rows), distance))


def near_duplicates(documents: DataFrame, shingle: int = 3, distance: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, version, fp, component_id) of every document."""
    prints = materialize(fingerprints(documents, shingle), "fingerprints")
    distinct = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = connected_components(links(distinct, distance, bucket_rows=bucket_rows))
    labels = distinct.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(labels, "fp", "left").select("doc_id", "version", "fp", "component_id")


def drop_duplicates(documents: DataFrame, **limits) -> DataFrame:
    """The rows of `documents`, all columns, but one for each component: that with its smallest doc_id, once.

    Rows without a doc_id stay.
    """
    found = near_duplicates(documents, **limits).where("doc_id = component_id")
    keep = found.groupBy("doc_id", "fp").agg(F.min("version").alias("version")).select(F.col("doc_id").alias("_nf_doc"), F.col("version").alias("_nf_version"))
    rows = documents.where("doc_id is not null").withColumn("_nf_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(keep, (F.col("doc_id") == F.col("_nf_doc")) & (F.col("_nf_hash") == F.col("_nf_version")), "left_semi")
    once = rows.withColumn("_nf_row", F.row_number().over(Window.partitionBy("doc_id", "_nf_hash").orderBy(F.lit(0)))).where("_nf_row = 1")
    return once.select(*documents.columns).union(documents.where("doc_id is null"))


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of `near_duplicates`."""
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
