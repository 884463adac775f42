"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch sent to Python workers.  Documents are kilobytes, so the default of 10,000 rows
#: would hold tens of megabytes at once.
ARROW_ROWS = 500
ARROW, BEFORE = "spark.sql.execution.arrow.maxRecordsPerBatch", "nearfield.arrow.before"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that the operators' Python stages receive; `restore` gives the session its own size back."""
    before = spark.conf.get(ARROW, None)
    if before != str(ARROW_ROWS):
        spark.conf.set(BEFORE, before or "")
        spark.conf.set(ARROW, str(ARROW_ROWS))


def restore(spark: SparkSession) -> None:
    """Undo `prepare`; results of the operators that are still to be computed then get larger batches."""
    before = spark.conf.get(BEFORE, None)
    if before is not None:
        spark.conf.unset(BEFORE)
        if before:
            spark.conf.set(ARROW, before)
        else:
            spark.conf.unset(ARROW)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="nearfield-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/nearfield-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the files of tables that `materialize` wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/nearfield-" in f}:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def doc_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text) only, whatever other columns there are; null text becomes empty."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id):
    """True where crc32(doc_id as text) mod 4 is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes of `column`; a longer row comes alone."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    first, total = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > first and total + n > limit:
            yield batch.slice(first, k - first)
            first, total = k, 0
        total += n
    if len(lengths) > first:
        yield batch.slice(first)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A null-free string or binary column as (all bytes, offsets from 0)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]
