"""The op log: append-only batches of upserts and deletes, and the live state they amount to.

A batch is a Parquet directory `log/<lsn>`, written under a temporary name and renamed: it is there whole or
not at all.  Renames go through the file system that Spark itself uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIGITS = 20


class Store:
    """Files and directories below a root, by Hadoop's file system interface: local paths, HDFS, object stores."""

    def __init__(self, spark: SparkSession, root: str, fsync: bool = True):
        self.spark, self.root, self.fsync = spark, root.rstrip("/"), fsync
        jvm = spark._jvm
        self.to_path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.to_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.to_path("/".join((self.root, *parts)))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.at(*parts))

    def names(self, *parts: str) -> list[str]:
        path = self.at(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def make(self, *parts: str) -> None:
        self.fs.mkdirs(self.at(*parts))

    def move(self, old: tuple[str, ...], new: tuple[str, ...]) -> None:
        if not self.fs.rename(self.at(*old), self.at(*new)):
            raise OSError(f"{'/'.join(old)} could not be renamed")

    def remove(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)

    def read_text(self, *parts: str) -> str:
        stream = self.fs.open(self.at(*parts))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, text: str, *parts: str) -> None:
        """Replace a small file: written aside, flushed to disk, then renamed over the old one."""
        aside = (*parts[:-1], f".{parts[-1]}.tmp")
        stream = self.fs.create(self.at(*aside), True)
        stream.write(bytearray(text.encode()))
        if self.fsync:
            stream.hsync()
        stream.close()
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at().toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        context.rename(context.makeQualified(self.at(*aside)), context.makeQualified(self.at(*parts)), options)

    def size(self, *parts: str) -> int:
        path = self.at(*parts)
        return self.fs.getContentSummary(path).getLength() if self.fs.exists(path) else 0


def batch_name(lsn: int) -> str:
    return f"{lsn:0{DIGITS}d}"


def batches(store: Store, after: int = 0) -> list[int]:
    """The LSNs of the batches behind `after`, without a gap."""
    found = [int(n) for n in store.names("log") if n.isdigit() and int(n) > after]
    if found and found != list(range(after + 1, after + 1 + len(found))):
        raise OSError(f"the log has a gap behind {after}: {found[:5]}")
    return found


def read(store: Store, lsns: list[int], schema) -> DataFrame | None:
    """The ops of these batches, with the columns of `schema` (missing ones null)."""
    if not lsns:
        return None
    return store.spark.read.schema(schema).parquet(*(f"{store.root}/log/{batch_name(n)}" for n in lsns))


def latest_ops(ops: DataFrame) -> DataFrame:
    """The last op of each id by (lsn, pos)."""
    order = Window.partitionBy("id").orderBy(F.desc("lsn"), F.desc("pos"))
    return ops.withColumn("_last", F.row_number().over(order)).where("_last = 1").drop("_last")


def live_records(ops: DataFrame) -> DataFrame:
    """The records whose last op is an upsert."""
    return latest_ops(ops).where("op = 'U'")
