"""Readers for vector files and passages."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file that one task reads, about, and rows that it decodes at a time.
RANGE = 64 << 20
ROWS = 4096


def decoded(file: str, words: np.ndarray, dim: int, first: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Batches (file, row, vector) of rows of 32-bit words, each the length and the components."""
    dtype, arrow = {"f": ("<f4", pa.float32()), "i": ("<i4", pa.int32())}[kind]
    rows = words.reshape(-1, dim + 1)
    if (rows[:, 0] != dim).any():
        raise ValueError(f"{file} has vectors of several lengths")
    for at in range(0, len(rows), ROWS):
        own = np.ascontiguousarray(rows[at : at + ROWS, 1:]).view(dtype)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, dim), pa.int32()), pa.array(own.ravel(), arrow))
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(own)), pa.array(np.arange(first + at, first + at + len(own)), pa.int64()), vectors], names=["file", "row", "vector"])


def dimension(file: str, head: bytes, length: int) -> int:
    """The vectors' length, from the file's first word."""
    dim = int(np.frombuffer(head, "<i4")[0])
    if dim <= 0 or length % (4 * (dim + 1)):
        raise ValueError(f"{file} is not a file of vectors")
    return dim


def opened(path: str):
    """(file system, path) for pyarrow; an error where it knows none for the path."""
    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def read_vecs(spark: SparkSession, path: str, kind: str = "f", size: int = RANGE) -> DataFrame:
    """(file, row, vector) of .fvecs ('f': float32) or .ivecs ('i': int32) files: each vector is its length and its components.

    Files are read in ranges of about `size` bytes, a task each, where Arrow can open them (local and mounted folders,
    HDFS, object stores); on other file systems a task reads a whole file, of 2 GB at most.
    """
    schema = f"file string, row long, vector array<{'float' if kind == 'f' else 'int'}>"
    files = spark.read.format("binaryFile").load(path)
    listed = files.select("path", "length").where("length > 0").collect()
    try:
        for scheme in {r.path.split(":")[0]: r.path for r in listed}.values():
            opened(scheme)
    except (pa.ArrowException, OSError):

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    data = content.as_buffer()
                    if len(data):
                        yield from decoded(file, np.frombuffer(data, "<i4"), dimension(file, data[:4], len(data)), 0, kind)

        return files.select("path", "content").mapInArrow(whole, schema)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, name = opened(r["path"])
                with system.open_input_file(name) as f:
                    dim = dimension(r["path"], f.read_at(4, 0), r["length"])
                    width = 4 * (dim + 1)
                    rows = r["length"] // width
                    first, last = rows * r["part"] // r["parts"], rows * (r["part"] + 1) // r["parts"]
                    yield from decoded(r["path"], np.frombuffer(f.read_at((last - first) * width, first * width), "<i4"), dim, first, kind)

    parts = [(r.path, r.length, k, n) for r in listed for n in [-(-r.length // size)] for k in range(n)]
    ranges = spark.createDataFrame(parts, "path string, length long, part long, parts long")
    return ranges.repartition(max(1, len(parts))).mapInArrow(ranged, schema)


def write_vecs(rows: list[np.ndarray], path: str) -> None:
    """Write vectors of one length to an .fvecs or .ivecs file (by their type)."""
    with open(path, "wb") as f:
        for row in rows:
            f.write(np.int32(len(row)).tobytes() + np.ascontiguousarray(row).tobytes())


def read_tsv(spark: SparkSession, path: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """Tab-separated text, gzipped or not."""
    schema = ", ".join(f"{c} string" for c in columns)
    rows = spark.read.csv(path, sep="\t", schema=schema, quote="")
    return rows if limit is None else rows.limit(limit)


def read_tar_tsv(spark: SparkSession, path: str, member: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """The tab-separated member of a tar file, compressed or not: streamed by one task, which stops behind `limit` rows.

    Lines with too few fields get nulls, further fields are dropped.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive in chain.from_iterable(b.column("path").to_pylist() for b in batches):
            system, name = opened(archive)
            with system.open_input_stream(name, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
                found = next((tar.extractfile(m) for m in tar if m.name.removeprefix("./") == member), None)
                if found is None:
                    raise FileNotFoundError(f"{archive} has no {member}")
                lines = (line.decode().rstrip("\r\n").split("\t") for line in found)
                while rows := list(islice(lines, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], pa.string()) for i in range(len(columns))], names=columns)

    files = spark.read.format("binaryFile").load(path).select("path")
    rows = files.mapInArrow(stream, ", ".join(f"{c} string" for c in columns))
    return rows if limit is None else rows.limit(limit)


def from_numpy(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """(row, vector) of a matrix that the driver holds."""
    x = np.asarray(x, np.float32)
    table = pa.table({"row": np.arange(len(x)), "vector": pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))})
    return spark.createDataFrame(table)


def load_npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, vector) of an .npy file that the driver can read."""
    return from_numpy(spark, np.load(path))


def embedded(texts: DataFrame, embed, dim: int, text: str = "text") -> DataFrame:
    """All columns and `vector`: `embed(list of texts)` is called on each Arrow batch and returns a matrix."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields) + ", vector array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(embed(batch.column(text).to_pylist()), np.float32).reshape(batch.num_rows, dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float32()))], names=[*batch.schema.names, "vector"])

    return texts.mapInArrow(run, schema)
