"""Token-ID output in patched frame-of-reference blocks.

A shard is one binary image that holds the ids of consecutive documents:

    magic "PFOR" | version u2 | block length u2 | ids u8 | blocks u4 | documents u4
    block starts  u8 x (blocks + 1)   byte offset of each block after this index
    document ids  i8 x documents
    id counts     u4 x documents
    blocks

and a block of up to 1024 ids is

    minimum u4 | width u1 | ids u2 | exceptions u2 | the differences from the minimum, low `width` bits each,
    packed | exception positions u2 | exception high parts u4

The width is the one at which a given share of the block's differences fits (a percentile); what does not
fit keeps its low bits in place and its high part in the exception list.  Block starts make every block
readable alone, so a document is read without decoding those before it.

Shards are rows of a Parquet table (part, shard, first, n_ids, low, high, image; low and high are its smallest and
largest doc_id, so that Parquet's statistics lead a lookup to the shards that hold a document), written by Spark's writers: any store that
Spark reaches will do, and a lost task is simply run again.  Documents are range-partitioned by doc_id, so
parts, shards and documents are in ascending order throughout.

Edge cases: null text is empty; an empty document holds the end id only; equal doc_ids stay together in one
part; an empty table gives no shards; null doc_ids come first and are written as the smallest 64-bit integer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import doc_texts, materialize, partitions, slices
from nearfield.llm.tokens import END_ID, tokenizer

BLOCK = 1024
HEAD = struct.Struct("<4sHHQII")
BLOCK_HEAD = struct.Struct("<IBHH")
#: Share of a block's differences that must fit its width.
PERCENTILE = 0.9
#: Ids in a shard, but for a longer document.
SHARD_IDS = 1 << 20
NULL_ID = -(1 << 63)


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One patched frame-of-reference block."""
    low = int(ids.min())
    diff = (ids - np.uint32(low)).astype(np.uint32)
    at = min(len(diff) - 1, int(np.ceil(percentile * len(diff))) - 1)
    width = int(np.partition(diff, at)[at]).bit_length()
    exceptions = np.flatnonzero(diff >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = np.unpackbits(diff.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    high = diff[exceptions] >> np.uint32(width) if width < 32 else diff[:0]
    return b"".join((BLOCK_HEAD.pack(low, width, len(ids), len(exceptions)), np.packbits(bits.ravel(), bitorder="little").tobytes(), exceptions.astype("<u2").tobytes(), high.astype("<u4").tobytes()))


def unpack_block(data: memoryview) -> np.ndarray:
    low, width, n, n_exceptions = BLOCK_HEAD.unpack_from(data)
    at = BLOCK_HEAD.size
    packed = (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, packed, at), count=n * width, bitorder="little").reshape(n, width)
    diff = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel().copy()
    at += packed
    if n_exceptions:
        where = np.frombuffer(data, "<u2", n_exceptions, at)
        high = np.frombuffer(data, "<u4", n_exceptions, at + 2 * n_exceptions)
        diff[where] |= high << np.uint32(width)
    return diff + np.uint32(low)


def pack_shard(doc_ids: list[int], ids: list[np.ndarray], block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The image of a shard with these documents."""
    flat = np.concatenate(ids).astype(np.uint32) if ids else np.empty(0, np.uint32)
    blocks = [pack_block(flat[i : i + block], percentile) for i in range(0, len(flat), block)]
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    counts = np.array([len(x) for x in ids], dtype="<u4")
    return b"".join((HEAD.pack(b"PFOR", 1, block, len(flat), len(blocks), len(ids)), starts.tobytes(), np.array(doc_ids, dtype="<i8").tobytes(), counts.tobytes(), *blocks))


class Shard:
    """A shard image, read through its index."""

    def __init__(self, image: bytes):
        magic, version, self.block, self.n_ids, n_blocks, n_docs = HEAD.unpack_from(image)
        if magic != b"PFOR" or version != 1:
            raise ValueError("not a shard of version 1")
        at = HEAD.size
        self.starts = np.frombuffer(image, "<u8", n_blocks + 1, at)
        at += 8 * (n_blocks + 1)
        self.doc_ids = np.frombuffer(image, "<i8", n_docs, at)
        counts = np.frombuffer(image, "<u4", n_docs, at + 8 * n_docs)
        self.bounds = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.body = memoryview(image)[at + 12 * n_docs :]

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from begin to end, from the blocks that hold them."""
        if begin >= end:
            return np.empty(0, np.uint32)
        first, last = begin // self.block, (end - 1) // self.block
        flat = np.concatenate([unpack_block(self.body[int(self.starts[b]) : int(self.starts[b + 1])]) for b in range(first, last + 1)])
        return flat[begin - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.bounds[k]), int(self.bounds[k + 1]))


def write_shards(documents: DataFrame, tokenizer_path: str, shard_ids: int = SHARD_IDS, block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """(part, shard, first, n_ids, low, high, image): the documents' ids, each document closed by the end id, written and read back.

    `first` counts the part's ids before the shard.
    """
    spark = documents.sparkSession
    docs = doc_texts(documents).repartitionByRange(max(1, partitions(spark)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, first, words = TaskContext.get().partitionId(), 0, 0, tokenizer(tokenizer_path)
        doc_ids, ids, total = [], [], 0

        def image() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([total], pa.int64()), pa.array([doc_ids[0]], pa.int64()), pa.array([doc_ids[-1]], pa.int64()), pa.array([pack_shard(doc_ids, ids, block, percentile)], pa.binary())], names=["part", "shard", "first", "n_ids", "low", "high", "image"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = np.append(words.ids(text.as_py()), np.uint32(END_ID))
                if ids and total + len(own) > shard_ids:
                    yield image()
                    shard, first, doc_ids, ids, total = shard + 1, first + total, [], [], 0
                doc_ids.append(NULL_ID if doc_id is None else doc_id)
                ids.append(own)
                total += len(own)
        if ids:
            yield image()

    return materialize(docs.mapInArrow(encode, "part int, shard int, first long, n_ids long, low long, high long, image binary"), "shards")


def lookup(shards: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents with these ids, as a trainer fetches them: only shards that may hold one are read, and only the blocks that do are decoded."""
    wanted = sorted(set(doc_ids))
    near = reduce(or_, [F.lit(i).between(F.col("low"), F.col("high")) for i in wanted], F.lit(False))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.column("image"):
                shard = Shard(image.as_py())
                at = np.flatnonzero(np.isin(shard.doc_ids, wanted)).tolist()
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[at].astype(np.int64)), pa.array([shard.document(k).astype(np.int64) for k in at], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return shards.where(near).select("image").mapInArrow(fetch, "doc_id long, ids array<long>")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the shards.

    Only the parts' sizes are summed up across parts; there are as many as shuffle partitions when the shards were
    written, so their table is small whatever the documents, and images stay where they are.
    """
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, image in zip(batch.column("base").to_pylist(), batch.column("image"), strict=True):
                shard = Shard(image.as_py())
                flat = shard.ids(0, shard.n_ids).astype("<u4")
                bounds = shard.bounds.tolist()
                crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids.astype(np.int64), mask=shard.doc_ids == NULL_ID), pa.array(shard.bounds[:-1] + base), pa.array(np.diff(shard.bounds)), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = shards.join(F.broadcast(offsets), "part").select((F.col("base") + F.col("first")).alias("base"), "image")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
