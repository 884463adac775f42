"""Suffix-array dedup: removal of bytes covered by long strings that occur elsewhere.

A 400-byte window holds a 32-byte string of smallest hash, its anchor; equal windows have it at the same
place.  Windows that share an anchor form a segment (in steps of 64 starts, counted from the anchor): all of a
segment's windows contain its core, and differ only in up to 63 bytes on either side, its flanks.

1. Anchors of all windows, one row for each run of windows with the same anchor.
2. Anchors whose string occurs once are dropped; segments of the others are cut out of the texts.
3. Equal segments are counted, and one of them stands for all.  A core that always has the same flanks has one
   context, so there is nothing to order: its windows repeat if the segment does.
4. Other cores: flanks are written as 8-byte symbols around one symbol for the core, all contexts of a run of
   cores go into one string, and its suffix array (by linear grouping) brings equal runs of symbols together;
   the up to seven bytes at the ends of each window are then compared exactly.
5. The windows found are united per document and their bytes removed.

Hot anchors: only counts, minima and joins see them until equal segments have become one row; the flanks of that
row are fetched by the number of the segment, so no join meets a hot core.  A core with more than `crowd` different
flanks is not gathered: its windows are counted by hash instead.

Edge cases: null text is empty; texts shorter than a window keep everything; repeated rows are documents of
their own and so lose all their windows (what is known of a text is kept once for all its rows); rows with a null
doc_id are treated like others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from nearfield.llm.common import drop_scratch, materialize, partitions, raw_bytes, slices
from nearfield.llm.suffix_array import suffix_array

WIDTH = 400
GRAM = 32
#: Window starts in a segment; flanks are one byte shorter.
STEP = 64
#: Different flanks of one core that are gathered in one task (16 symbols each).
CROWD = 1 << 15
#: Contexts in one suffix array, but for a larger group.
AT_ONCE = 20_000
NULL_ID = -(1 << 63)

_random = np.random.default_rng(20240229)
BYTE_HASH = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _random.integers(0, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each position on, built by doubling; the last 31 positions have none."""
    h = BYTE_HASH[data]
    for k, factor in enumerate(FACTORS):
        h = h[: -(1 << k)] * factor + h[1 << k :]
    h ^= h >> np.uint64(33)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """For texts laid end to end: (text, hash, anchor, first window, last window) of each run of windows; places from the start of the text."""
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    if len(data) < width:
        return none
    hashes = gram_hashes(data)
    places = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (sliding_min(places, width - GRAM + 1) & LOW).astype(np.int64)
    lengths = np.diff(bounds)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(anchors)]
    start = np.arange(len(anchors))
    inside = start + width <= bounds[1:][text]
    start, text, anchors = start[inside], text[inside], anchors[inside]
    if not len(start):
        return none
    new = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    base = bounds[:-1][text[first]]
    return text[first], hashes[anchors[first]].view(np.int64), anchors[first] - base, start[first] - base, start[last] - base


def anchor_table(docs: DataFrame) -> DataFrame:
    """(doc, version, key, anchor, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b) for b in batches):
            data, bounds = raw_bytes(batch.column("text"))
            text, key, anchor, low, high = anchor_runs(data, bounds)
            own = batch.select(["doc", "version"]).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(key), *(pa.array(x.astype(np.int32)) for x in (anchor, low, high))], names=["doc", "version", "key", "anchor", "low", "high"])

    return docs.mapInArrow(run, "doc long, version long, key long, anchor int, low int, high int")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments_of(text: bytes, runs: list[tuple[int, int, int]], width: int = WIDTH, step: int = STEP) -> Iterator[tuple[int, bytes, int, int, bytes, bytes]]:
    """(place of the core, core key, context key, mask of its windows, left flank, right flank) of each segment of the runs (anchor, low, high)."""
    for anchor, low, high in runs:
        for k in range((anchor - high) // step, (anchor - low) // step + 1):
            begin = anchor - k * step
            end = begin + width - step + 1
            left = text[max(low, begin - step + 1) : begin]
            right = text[end : min(high, begin) + width]
            valid = (1 << (len(left) + 1)) - (1 << (step - 1 - len(right)))
            yield begin, xxh3_128_digest(text[begin:end], k), signed(xxh3_64_intdigest(left, len(left)) ^ (xxh3_64_intdigest(right, 1000 + len(right)) >> 1)), signed(valid), left, right


def segment_table(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(segment, doc, version, place, core, context, valid, left, right) of the windows whose anchors repeat; `segment` numbers the rows."""
    schema = "doc long, version long, place int, core binary, context long, valid long, left binary, right binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, limit=1 << 20) for b in batches):
            rows = []
            for doc, version, text, runs in zip(*(batch.column(c) for c in ("doc", "version", "text", "runs")), strict=True):
                doc, version, found = doc.as_py(), version.as_py(), {(r["anchor"], r["low"], r["high"]) for r in runs.as_py()}
                data = text.as_py().encode("utf-8")
                rows += [(doc, version, *segment) for segment in segments_of(data, sorted(found))]
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc", "version", "place", "core", "context", "valid", "left", "right"])

    found = docs.join(spans, ["doc", "version"]).select("doc", "version", "text", "runs").mapInArrow(run, schema)
    return found.select(F.monotonically_increasing_id().alias("segment"), *found.columns)


def pad(flanks: list[bytes], reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Flanks as rows of 64 bytes, nearest to the core first, and their lengths."""
    rows = np.frombuffer(b"".join((f[::-1] if reverse else f).ljust(STEP, b"\0") for f in flanks), np.uint8).reshape(-1, STEP)
    return rows, np.array([len(f) for f in flanks])


def repeated_windows(cores: np.ndarray, left: list[bytes], right: list[bytes], times: np.ndarray) -> np.ndarray:
    """For each context a mask of its windows that occur more than once; bit t: t bytes of the left flank, 63 - t of the right.

    `cores` numbers the contexts' cores; `times` says how often each context occurs.
    """
    n, per = len(left), STEP // 8
    (l_bytes, l_len), (r_bytes, r_len) = pad(left, True), pad(right, False)
    l_block, r_block = (np.ascontiguousarray(b).view("<u8") for b in (l_bytes, r_bytes))
    table, ranks = np.unique(np.concatenate((l_block[:, : per - 1].ravel(), r_block[:, : per - 1].ravel())), return_inverse=True)
    ranks = ranks.reshape(2, n, per - 1) + 1
    whole = 8 * np.arange(1, per)
    string = np.zeros((n, 2 * per), np.int64)
    string[:, 1:per] = np.where(l_len[:, None] >= whole, ranks[0], 0)[:, ::-1]
    string[:, per] = cores + len(table) + 1
    string[:, per + 1 :] = np.where(r_len[:, None] >= whole, ranks[1], 0)
    flat = string.ravel()
    order = suffix_array(flat)
    order = order[(order % (2 * per) >= 1) & (order % (2 * per) <= per)]
    runs = flat[order[:, None] + np.arange(per)]
    complete = (runs > 0).all(axis=1)
    order, runs = order[complete], runs[complete]
    classes = np.full((n, per + 1), -1, np.int64)
    if len(order):
        classes[order // (2 * per), order % (2 * per)] = np.concatenate(([0], np.cumsum((runs[1:] != runs[:-1]).any(axis=1))))
    masks = np.zeros(n, np.uint64)
    low = [np.uint64((1 << (8 * k)) - 1) for k in range(8)]
    for x in range(per):
        cls = classes[:, per - x]
        for y in range(8):
            t = 8 * x + y
            some = np.flatnonzero((cls >= 0) & (l_len >= t) & (r_len >= STEP - 1 - t))
            if not len(some):
                continue
            ends = (l_block[some, x] & low[y]) | ((r_block[some, per - 1 - x] & low[7 - y]) << np.uint64(8 * y))
            by = np.lexsort((ends, cls[some]))
            a, b = cls[some][by], ends[by]
            first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            total = np.add.reduceat(times[some][by], first)
            again = np.repeat(total > 1, np.diff(np.append(first, len(by))))
            masks[some[by[again]]] |= np.uint64(1 << t)
    return masks


def arrayed(rows: DataFrame) -> DataFrame:
    """(core, context, mask) of contexts (core, context, left, right, times), which arrive core by core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held += zip(*(batch.column(c).to_pylist() for c in ("core", "context", "left", "right", "times")), strict=True)
                if len(held) < AT_ONCE:
                    continue
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
            else:
                cut = len(held)
            own, held = held[:cut], held[cut:]
            if own:
                core, context, left, right, times = zip(*own, strict=True)
                numbers = np.cumsum([False] + [a != b for a, b in zip(core[1:], core[:-1], strict=True)])
                masks = repeated_windows(numbers, left, right, np.array(times))
                yield pa.RecordBatch.from_arrays([pa.array(core, pa.binary()), pa.array(context, pa.int64()), pa.array(masks.view(np.int64))], names=["core", "context", "mask"])

    return rows.mapInArrow(run, "core binary, context long, mask long").where("mask <> 0")


def counted(rows: DataFrame) -> DataFrame:
    """As `arrayed`, for crowded cores: each window's own bytes are hashed and counted."""
    t = F.col("t")
    windows = rows.select("core", "context", "left", "right", "times", F.explode(F.sequence(F.lit(0), F.lit(STEP - 1))).alias("t"))
    windows = windows.where((F.length("left") >= t) & (F.length("right") >= STEP - 1 - t))
    ends = [F.substring("left", F.length("left") - t + 1, t), F.substring("right", F.lit(1), F.lit(STEP - 1) - t)]
    windows = windows.select("core", "context", "times", "t", F.xxhash64(*ends).alias("e1"), F.xxhash64(F.lit(7), *ends).alias("e2"))
    by = ["core", "t", "e1", "e2"]
    again = windows.groupBy(*by).agg(F.sum("times").alias("n")).where("n > 1")
    return windows.join(again, by).groupBy("core", "context").agg(F.expr("bit_or(shiftleft(1L, t))").alias("mask"))


def repeated_segments(segments: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(core, context, mask) of every segment with windows that occur elsewhere."""
    same = [F.count("*").alias("times"), F.max("valid").alias("valid"), F.min("segment").alias("segment")]
    distinct = materialize(segments.groupBy("core", "context").agg(*same), "contexts")
    cores = materialize(distinct.groupBy("core").agg(F.count("*").alias("flanks"), F.max("times").alias("most")).where("flanks > 1 or most > 1"), "cores")
    known = distinct.join(cores, "core")
    alone = known.where("flanks = 1").select("core", "context", F.col("valid").alias("mask"))
    various = known.where("flanks > 1").select("segment", "core", "context", "times", "flanks")
    one = materialize(various.join(segments.select("segment", "left", "right"), "segment").drop("segment"), "flanks")
    few = one.where(F.col("flanks") <= crowd).repartition(partitions(segments.sparkSession), "core").sortWithinPartitions("core")
    found = materialize(alone.union(arrayed(few)).union(counted(one.where(F.col("flanks") > crowd))), "windows")
    drop_scratch(distinct, cores, one)
    return found


def remove(docs: DataFrame, windows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans): documents without the windows (place, mask)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, limit=1 << 20) for b in batches):
            rows = []
            for doc, text, found in zip(*(batch.column(c) for c in ("doc", "text", "windows")), strict=True):
                doc, data, spans = doc.as_py(), text.as_py().encode("utf-8"), []
                n = len(data)
                if found.is_valid and len(data) >= width:
                    starts = set()
                    for w in found.as_py():
                        place, mask = w["place"], w["mask"] & ((1 << 64) - 1)
                        if mask == (1 << 64) - 1:
                            starts.update(range(place - STEP + 1, place + 1))
                        else:
                            starts.update(place - t for t in range(STEP) if mask >> t & 1)
                    at = np.array(sorted(starts))
                    change = np.zeros(n + 1, np.int32)
                    change[at] += 1
                    change[at + width] -= 1
                    gone = np.cumsum(change[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
                    data = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((None if doc == NULL_ID else doc, n, n - len(data), len(spans), hashlib.sha256(data).hexdigest(), data, [{"start": a, "end": b} for a, b in spans]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return docs.join(windows, ["doc", "version"], "left").select("doc", "text", "windows").mapInArrow(run, schema)


def remove_repeats(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Every document without the bytes that a 400-byte string occurring elsewhere covers."""
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    anchors = materialize(anchor_table(docs), "anchors")
    repeated = materialize(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    # Sets, not lists: equal rows share one entry, however many they are.
    spans = anchors.join(repeated, "key", "left_semi").groupBy("doc", "version").agg(F.collect_set(F.struct("anchor", "low", "high")).alias("runs"))
    segments = materialize(segment_table(docs, spans), "segments")
    drop_scratch(anchors, repeated)
    found = repeated_segments(segments, crowd)
    windows = segments.select("doc", "version", "place", "core", "context").join(found, ["core", "context"])
    windows = windows.groupBy("doc", "version").agg(F.collect_set(F.struct("place", "mask")).alias("windows"))
    return remove(docs, windows)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of `remove_repeats`, and the remaining text: null where a cut went through a character."""
    text = F.try_validate_utf8(F.col("kept").cast("string"))
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text.alias("kept"))


#: By the digest of every window; n numbers the rows, so repeated rows are documents of their own.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT n, unnest(range(1, octet_length(b) - 398)) AS i, b FROM d WHERE octet_length(b) >= 400),
h AS (SELECT n, i, md5(array_slice(b, i, i + 399)) AS k FROM w),
again AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
s AS (SELECT n, i, i - coalesce(lag(i) OVER (PARTITION BY n ORDER BY i) + 400, -1) > 0 AS fresh FROM h SEMI JOIN again USING (k)),
g AS (SELECT n, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY n ORDER BY i) AS g FROM s),
r AS (SELECT n, g, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY 1, 2),
cut AS (SELECT n, count(*) AS n_spans, sum(z - a) AS n_removed FROM r GROUP BY 1),
p AS (
  SELECT n, z AS a, lead(a) OVER (PARTITION BY n ORDER BY a) AS z FROM r
  UNION ALL SELECT n, 1, min(a) FROM r GROUP BY n
  UNION ALL SELECT n, 1, NULL FROM d WHERE n NOT IN (SELECT n FROM r)),
kept AS (SELECT n, unhex(coalesce(string_agg(hex(array_slice(b, p.a, coalesce(p.z - 1, octet_length(b)))), '' ORDER BY p.a), '')) AS b FROM p JOIN d USING (n) GROUP BY n)
SELECT d.doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(kept.b) AS kept_sha256, TRY(decode(kept.b)) AS kept
FROM d JOIN kept USING (n) LEFT JOIN cut USING (n)
"""
