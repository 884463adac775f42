"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

Documents are taken in batches of falling doc_id.  A batch's lines become one row per key (documents that
hold it, largest doc_id).  The batch is merge-joined against the keys of the runs written so far: a key
that no run has (the anti-join) gets this batch's largest doc_id as its holder, which is final because
later batches hold smaller ids only; a known key adds to its count.  Either way the batch adds its own
sorted run, and as soon as `fan` runs stand on a level they are compacted into one run of the next level.
The last compaction gives the keys that lose their lines.

Edge cases: null or empty text is one empty line; a null doc_id keeps all its lines and counts for no key;
repeated rows of one doc_id count as one document and are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import doc_texts, drop_scratch, materialize, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters [\x20\x09-\x0D].
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def line_table(documents: DataFrame, min_chars: int, n_batches: int) -> DataFrame:
    """(batch, doc_id, version, pos, k1, k2) of every line whose key is long enough; 128 bits identify a key.

    `version` is a hash of the text, so that rows that repeat a doc_id with another text stay apart.
    """
    low, high = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    width = (high - low) // n_batches + 1
    lines = documents.where(F.col("doc_id").isNotNull()).select(
        ((F.col("doc_id") - low) / width).cast("int").alias("batch"), "doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    keyed = lines.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    keyed = keyed.select("batch", "doc_id", "version", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(7), "key").alias("k2"))
    spark, path = documents.sparkSession, scratch(documents.sparkSession, "lines")
    keyed.write.partitionBy("batch").parquet(path)
    return spark.read.schema("doc_id long, version long, pos int, k1 long, k2 long, batch int").parquet(path)


def compact(runs: list[DataFrame]) -> DataFrame:
    """One run out of several: counts add up, the holder is the largest that any run names."""
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    return merged.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))


def line_runs(lines: DataFrame, n_batches: int, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2, n_docs, holder) of every key, built batch by batch through levelled runs; and the runs it reads."""
    levels: list[list[DataFrame]] = []
    for batch in range(n_batches - 1, -1, -1):
        own = lines.where(F.col("batch") == batch).groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("one"))
        own = own.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
        if held := [run for level in levels for run in level]:
            known = compact(held).select("k1", "k2", F.lit(True).alias("known"))
            own = own.join(known.hint("merge"), ["k1", "k2"], "left").withColumn("holder", F.when(F.col("known").isNull(), F.col("last")))
        else:
            own = own.withColumn("holder", F.col("last"))
        run, level, merged = own.select("k1", "k2", "n_docs", "holder"), 0, []
        while True:
            run = materialize(run.sortWithinPartitions("k1", "k2"), f"run{level}")
            drop_scratch(*merged)
            if level == len(levels):
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) < fan:
                break
            run, merged, levels[level] = compact(levels[level]), levels[level], []
            level += 1
    last = [run for level in levels for run in level]
    return compact(last), last


def lost_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4, fan: int = 2) -> DataFrame:
    """(doc_id, version, dropped): the positions of the lines that go, of the texts that lose any."""
    lines = line_table(docs, min_chars, n_batches)
    keys, runs = line_runs(lines, n_batches, fan)
    frequent = materialize(keys.where(F.col("n_docs") >= min_docs).select("k1", "k2", "holder"), "frequent")
    lost = lines.join(frequent, ["k1", "k2"]).where(F.col("doc_id") != F.col("holder"))
    lost = materialize(lost.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("dropped")), "lost")
    drop_scratch(lines, frequent, *runs)
    return lost


def kept_text(text: Column, dropped: Column) -> Column:
    """The text without the lines at these positions; all of it where dropped is null.

    The positions that stay are a set difference, and each line is then taken by its position, so the time follows
    the number of lines.  The array of one struct binds the split text, which would be split anew for each line.
    """
    lines = F.split(text, "\n", -1)
    parts = F.array(F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped).alias("stay")))
    joined = F.transform(parts, lambda x: F.array_join(F.transform(x["stay"], lambda i: F.get(x["lines"], i)), "\n"))
    return F.when(dropped.isNull(), text).otherwise(joined[0])


def line_dedup(documents: DataFrame, **limits) -> DataFrame:
    """(doc_id, lines, dropped, kept): the lines of each text, the positions that go, the text that stays.

    A key of at least `min_chars` code points found in at least `min_docs` documents loses all its lines
    except those in the largest doc_id that holds it.
    """
    docs = doc_texts(documents)
    found = docs.withColumn("version", F.xxhash64("text")).join(lost_lines(docs, **limits), ["doc_id", "version"], "left")
    kept = kept_text(F.col("text"), F.col("dropped"))
    return found.select("doc_id", F.split("text", "\n", -1).alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), kept.alias("kept"))


def drop_lines(documents: DataFrame, **limits) -> DataFrame:
    """All rows and columns of `documents`, the texts without the lines that go; n_chars, if there, follows the text."""
    lost = lost_lines(doc_texts(documents), **limits).select(F.col("doc_id").alias("_nf_doc"), F.col("version").alias("_nf_version"), F.col("dropped").alias("_nf_dropped"))
    found = documents.join(lost, (F.col("doc_id") == F.col("_nf_doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_nf_version")), "left")
    found = found.withColumn("text", kept_text(F.col("text"), F.col("_nf_dropped")))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col("_nf_dropped").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return found.select(*documents.columns)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of `line_dedup`."""
    return result.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) s),
k AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM l),
f AS (
  SELECT k, max(doc_id) AS holder FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (
  SELECT k.doc_id, k.i, k.line, f.holder IS NOT NULL AND f.holder <> k.doc_id AS gone
  FROM k LEFT JOIN f ON k.k = f.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
