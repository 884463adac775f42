"""A collection: records (id, vector, attributes) in Parquet, changed by logged batches, searched by top-k.

Directory layout, below any path that Spark can write:

    collection.json   name, dim and settings; never changes
    log/<lsn>/        one batch of ops each, with the cell and code that the snapshot's index gives their vectors
    snapshot/<lsn>/   records/ (the live rows, in order of their cell), cells/ and codebooks/ (small Parquet tables)
    stats/<lsn>/      frequencies of string attributes with many values
    MANIFEST          the snapshot's LSN, kinds, statistics and stream position; replaced atomically

The live state is the snapshot with the ops behind it: the last op of each id wins.  A batch is acknowledged
once its directory has its final name.  There is one writer; readers hold the immutable files they began with.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield import config as settings
from nearfield.errors import AlreadyExists, InvalidArgument, NotFound
from nearfield.functions import stats as st
from nearfield.functions.filters import BOOL, NUM, STR, parse
from nearfield.functions.vector import is_vector, l2_distance, l2_normalize
from nearfield.operators import ivf, kmeans, pq
from nearfield.operators.topk import ranked, top_k, top_k_batch
from nearfield.plans import budget
from nearfield.plans.planner import Found, Planner, filtered_search
from nearfield.sources import log

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
TYPES = {NUM: T.DoubleType(), STR: T.StringType(), BOOL: T.BooleanType()}
#: Columns of a batch besides the attributes.
OWN = ("lsn", "pos", "op", "id", "row_id", "vector", "cell", "code", "distance", "qid", "rank")
#: Live rows from which an index is built; below that an exact scan is as cheap.
INDEX_ROWS = 1000


@dataclass
class SearchInfo:
    """How a search was done."""

    strategy: str
    ef: int
    selectivity: float | None = None
    stats: dict[str, Any] = field(default_factory=dict)


@dataclass
class SearchResult:
    """Hits (id, distance, attributes), nearest first, and how they were found."""

    ids: list[str]
    distances: list[float]
    info: SearchInfo
    attributes: list[dict[str, Any]] | None = None


class Collection:
    """Open or create with `Collection.open` and `Collection.create`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, log.Store(spark, path)
        if not self.store.exists("collection.json"):
            raise NotFound(path)
        head = json.loads(self.store.read_text("collection.json"))
        self.name, self.dim, self.config = head["name"], head["dim"], head["config"]
        self.manifest = {"lsn": 0, "row_id": 0, "kinds": {}, "stats": {}, "stream_batch": -1, "rows": 0}
        if self.store.exists("MANIFEST"):
            self.manifest |= json.loads(self.store.read_text("MANIFEST"))
        self.kinds: dict[str, str] = dict(self.manifest["kinds"])
        self.stats: dict[str, dict] = self.manifest["stats"]
        for own in self.stats.values():
            if "unlisted" in own:  # wherever the collection is now
                own["unlisted"] = "/".join((self.store.root, "stats", *own["unlisted"].rsplit("/", 2)[1:]))
        self.snapshot_lsn: int = self.manifest["lsn"]
        self.stream_batch: int = self.manifest["stream_batch"]
        self.next_row: int = self.manifest["row_id"]
        self.version, self.churn, self.logged, self.budget_model = 0, 0, 0, None
        self.store.fsync = self.config["durability"]["fsync"]
        self.tail: list[int] = log.batches(self.store, self.snapshot_lsn)
        self.lsn = self.tail[-1] if self.tail else self.snapshot_lsn
        options = self.config["planner"]
        self.planner = Planner(**{k: options[k] for k in ("brute_force_max_selectivity", "post_filter_min_selectivity", "post_filter_max_ef", "exact_selectivity_below", "mask_cache_size")})
        for lsn in self.tail:
            self.__learn_batch(lsn)
        self.__clean()
        if model := self.config["early_stop"]["model"]:
            self.set_budget_model(budget.load(spark, model))
            self.budget_model.multiplier = self.config["early_stop"]["multiplier"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str, dim: int, options: dict[str, Any] | None = None) -> Collection:
        """A new, empty collection; everything is checked before anything is written."""
        config = settings.with_options(settings.DEFAULTS, options or {})
        settings.check(config, dim)
        store = log.Store(spark, path)
        if store.exists("collection.json"):
            raise AlreadyExists(path)
        store.make("log")
        store.make("snapshot")
        store.write_text(settings.dumps({"name": name, "dim": dim, "config": config}), "collection.json")
        return cls(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Collection:
        return cls(spark, path)

    # ---- state ----

    def __schema(self, extra: str = "") -> T.StructType:
        base = T._parse_datatype_string("lsn long, pos int, op string, id string, row_id long, vector array<float>" + extra)
        return T.StructType([*base.fields, *(T.StructField(k, TYPES[v]) for k, v in sorted(self.kinds.items()))])

    def __learn_batch(self, lsn: int) -> None:
        """Kinds, row numbers and stream position as of a batch in the log."""
        note = json.loads(self.store.read_text("log", log.batch_name(lsn), "_note.json"))
        self.kinds |= note["kinds"]
        self.next_row = note["row_id"]
        self.stream_batch = note["stream_batch"]
        self.logged += note["rows"]

    def __clean(self) -> None:
        """Remove what an interrupted writer left, and what the snapshot has replaced."""
        for n in self.store.names("log"):
            if n.startswith(".") or n.isdigit() and int(n) <= self.snapshot_lsn:
                self.store.remove("log", n)
        for n in self.store.names("snapshot"):
            if n != log.batch_name(self.snapshot_lsn):
                self.store.remove("snapshot", n)
        used = {own["unlisted"].rsplit("/", 2)[-2] for own in self.stats.values() if "unlisted" in own}
        for n in self.store.names("stats"):
            if n not in used:
                self.store.remove("stats", n)

    def __snapshot(self, part: str) -> str | None:
        where = ("snapshot", log.batch_name(self.snapshot_lsn), part)
        return f"{self.store.root}/{'/'.join(where)}" if self.store.exists(*where) else None

    def indexed(self) -> DataFrame | None:
        """The snapshot's rows, with their cell and code if there is an index."""
        path = self.__snapshot("records")
        return self.spark.read.schema(self.__schema(", cell int, code binary")).parquet(path) if path else None

    def ops(self) -> DataFrame:
        """The snapshot's rows as upserts, and the ops behind it."""
        tail = log.read(self.store, self.tail, self.__schema())
        base = self.indexed()
        if base is None:
            return tail if tail is not None else self.spark.createDataFrame([], self.__schema())
        base = base.drop("cell", "code")
        return base if tail is None else base.unionByName(tail)

    def records(self) -> DataFrame:
        """The live records."""
        return self.__candidates().drop("cell", "code")

    def get(self, ids: list[str]) -> DataFrame:
        """The live records with these ids; unknown ids have none."""
        return self.records().where(F.col("id").isin([str(i) for i in ids]))

    @cached_property
    def __index(self) -> dict[str, Any]:
        return {}

    def cells(self) -> ivf.Cells | None:
        """The snapshot's cells; read once a snapshot."""
        if self.__index.get("lsn") != self.snapshot_lsn:
            self.__index.clear()
            self.__index["lsn"] = self.snapshot_lsn
            if path := self.__snapshot("cells"):
                rows = self.spark.read.parquet(path).orderBy("cell").collect()
                self.__index["cells"] = ivf.Cells(np.array([r.centroid for r in rows]), np.array([r.n for r in rows]), self.manifest.get("oversample", ivf.OVERSAMPLE))
            if path := self.__snapshot("codebooks"):
                rows = self.spark.read.parquet(path).orderBy("subspace").collect()
                self.__index["codebooks"] = np.array([np.array(r.centroids) for r in rows])
        return self.__index.get("cells")

    def codebooks(self) -> np.ndarray | None:
        self.cells()
        return self.__index.get("codebooks")

    # ---- writes ----

    def upsert(self, ids: list[str], vectors: Any, attributes: list[dict[str, Any]] | None = None) -> int:
        """Insert or replace records; the last of equal ids wins.  Returns how many were given."""
        ids = [str(i) for i in ids]
        attributes = attributes if attributes is not None else [{}] * len(ids)
        if not len(ids) == len(vectors) == len(attributes):
            raise InvalidArgument(f"{len(ids)} ids, {len(vectors)} vectors, {len(attributes)} attribute sets")
        if not ids:
            return 0
        x = self.__vectors(vectors)
        kinds = kinds_of(attributes)
        self.__check_kinds(kinds)
        last = {name: k for k, name in enumerate(ids)}
        keep = sorted(last.values())
        all_kinds = self.kinds | kinds
        rows = [(k, ids[k], x[k].tolist(), *(clean(attributes[k].get(a)) for a in sorted(all_kinds))) for k in keep]
        schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), *(T.StructField(a, TYPES[all_kinds[a]]) for a in sorted(all_kinds))])
        self.__log(self.spark.createDataFrame(rows, schema).withColumn("op", F.lit("U")), kinds, len(rows))
        return len(ids)

    def upsert_frame(self, df: DataFrame, order: str | None = None, stream_batch: int | None = None) -> int:
        """Upsert the rows (id, vector, attributes) of a DataFrame; `order` says which of equal ids is last, without it they are refused."""
        for c in ("id", "vector"):
            if c not in df.columns:
                raise InvalidArgument(f"no column {c!r}")
        df = df.withColumn("id", F.col("id").cast("string")).withColumn("vector", F.col("vector").cast("array<float>"))
        kinds = {}
        for f in df.schema.fields:
            if f.name in ("id", "vector", order):
                continue
            kind = BOOL if isinstance(f.dataType, T.BooleanType) else STR if isinstance(f.dataType, T.StringType) else NUM if isinstance(f.dataType, T.NumericType) else None
            if kind is None:
                raise InvalidArgument(f"{f.name!r} is {f.dataType.simpleString()}: attributes are numbers, strings or booleans")
            kinds[f.name] = kind
        self.__check_kinds(kinds)
        for name, kind in kinds.items():
            value = F.col(name).cast(TYPES[kind])
            df = df.withColumn(name, F.when(~F.isnan(value), value) if kind == NUM else value)
        bad = F.col("id").isNull() | ~is_vector(F.col("vector"), self.dim)
        seen = df.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), *([] if order else [F.count_distinct("id").alias("ids")])).first()
        if seen.bad:
            raise InvalidArgument(f"every record needs an id and {self.dim} finite components")
        if not order and seen.ids != seen.n:
            raise InvalidArgument("ids occur more than once: `order` must name the column that says which is last")
        n = seen.n
        if not n:
            return 0
        if self.config["metric"] == "cosine":
            df = df.withColumn("vector", l2_normalize(F.col("vector")).cast("array<float>"))
        last = df
        if order:
            value = F.struct(F.col(order).alias("_order"), *(c for c in df.columns if c not in ("id", order)))
            last = df.groupBy("id").agg(F.max_by(value, F.col(order)).alias("r")).select("id", "r.*").drop("_order")
        self.__log(last.withColumn("pos", F.lit(0)).withColumn("op", F.lit("U")), kinds, n, stream_batch)
        return n

    def delete(self, ids: list[str]) -> int:
        """Delete records; unknown ids are passed over.  Returns how many there were."""
        wanted = self.spark.createDataFrame([(i,) for i in sorted({str(i) for i in ids})], "id string")
        found = sorted(r.id for r in self.records().select("id").join(wanted, "id", "left_semi").collect())
        if not found:
            return 0
        ops = self.spark.createDataFrame([(k, i) for k, i in enumerate(found)], "pos int, id string").withColumn("op", F.lit("D"))
        self.__log(ops, {}, len(found))
        return len(found)

    def __vectors(self, vectors: Any) -> np.ndarray:
        try:
            x = np.asarray(vectors, dtype=np.float32)
        except (TypeError, ValueError) as e:
            raise InvalidArgument(f"vectors are not numbers in rows of one length: {e}") from None
        if x.ndim == 1:
            x = x[None, :]
        if x.ndim != 2 or x.shape[1] != self.dim or not np.isfinite(x).all():
            raise InvalidArgument(f"vectors must have {self.dim} finite components")
        if self.config["metric"] == "cosine":
            size = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
            x = (x / np.where(size == 0, 1, size)).astype(np.float32)
        return x

    def __check_kinds(self, kinds: dict[str, str]) -> None:
        for name, kind in kinds.items():
            if not NAME.fullmatch(name) or name in OWN:
                raise InvalidArgument(f"bad attribute name {name!r}")
            if self.kinds.get(name, kind) != kind:
                raise InvalidArgument(f"{name!r} is {self.kinds[name]}, not {kind}")

    def __log(self, ops: DataFrame, kinds: dict[str, str], n: int, stream_batch: int | None = None) -> None:
        lsn, all_kinds = self.lsn + 1, self.kinds | kinds
        name = log.batch_name(lsn)
        numbered = ops.withColumn("lsn", F.lit(lsn).cast("long")).withColumn("row_id", F.xxhash64("id"))
        if "vector" in ops.columns and (cells := self.cells()) is not None:
            numbered = kmeans.assign(numbered, cells.centroids)
            if (books := self.codebooks()) is not None:
                numbered = pq.encode(numbered, books)
        self.store.remove("log", f".{name}.tmp")
        numbered.write.parquet(f"{self.store.root}/log/.{name}.tmp")
        note = {"kinds": all_kinds, "row_id": self.next_row + n, "rows": n, "stream_batch": self.stream_batch if stream_batch is None else stream_batch}
        self.store.write_text(json.dumps(note), "log", f".{name}.tmp", "_note.json")
        self.store.move(("log", f".{name}.tmp"), ("log", name))
        self.lsn, self.kinds, self.next_row, self.stream_batch = lsn, all_kinds, note["row_id"], note["stream_batch"]
        self.tail.append(lsn)
        self.version, self.churn, self.logged = self.version + 1, self.churn + n, self.logged + n
        every = self.config["durability"]["snapshot_every"]
        if every and self.logged >= every:
            self.snapshot()
        elif self.churn >= self.config["planner"]["stats_refresh_fraction"] * max(1, self.manifest["rows"]) and self.next_row >= self.config["planner"]["exact_selectivity_below"]:
            self.refresh_stats()

    def refresh_stats(self) -> dict[str, dict]:
        """New attribute statistics for the planner."""
        self.stats, self.churn = st.analyze(self.records(), self.kinds, tables=f"{self.store.root}/stats/{log.batch_name(self.lsn)}"), 0
        return self.stats

    def snapshot(self) -> None:
        """Compact: live rows, index and statistics in one place, published by replacing the manifest."""
        name, rows = log.batch_name(self.lsn), self.records()
        if self.lsn == self.snapshot_lsn:
            return
        target = f"{self.store.root}/snapshot/{name}"
        self.store.remove("snapshot", name)
        n = rows.count()
        cells = codebooks = None
        if self.config["index"] != "flat" and n >= INDEX_ROWS:
            x = kmeans.sample(rows, "id", "vector", self.config["pq"]["train_size"])
            cells = kmeans.fit(x, ivf.cell_number(n), self.config["pq"]["kmeans_iters"], self.config["hnsw"]["seed"])
            rows = kmeans.assign(rows, cells)
            if self.config["index"] == "hnsw_pq" and n >= max(pq.KSUB, self.config["pq"]["train_size"]):
                codebooks = pq.train(x, self.config["pq"]["m"], self.config["pq"]["kmeans_iters"], self.config["pq"]["seed"])
                rows = pq.encode(rows, codebooks)
            rows = rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
        rows.write.parquet(f"{target}/records")
        written = self.spark.read.parquet(f"{target}/records")
        if cells is not None:
            built = ivf.cells_of(written, cells)
            counts, self.manifest["oversample"] = built.counts, ivf.tune(written, built, ef=self.config["hnsw"]["ef_search"])
            self.spark.createDataFrame([(i, c.tolist(), int(k)) for i, (c, k) in enumerate(zip(cells, counts, strict=True))], "cell int, centroid array<double>, n long").write.parquet(f"{target}/cells")
        if codebooks is not None:
            self.spark.createDataFrame([(j, b.tolist()) for j, b in enumerate(codebooks)], "subspace int, centroids array<array<double>>").write.parquet(f"{target}/codebooks")
            self.manifest["pool"] = pq.tune_depth(written, codebooks)
        self.stats = st.analyze(written, self.kinds, tables=f"{self.store.root}/stats/{name}")
        self.manifest |= {"lsn": self.lsn, "row_id": self.next_row, "kinds": self.kinds, "stats": self.stats, "stream_batch": self.stream_batch, "rows": n}
        self.store.write_text(json.dumps(self.manifest), "MANIFEST")
        self.snapshot_lsn, self.tail, self.churn, self.logged = self.lsn, [], 0, 0
        self.planner.clear()
        self.__clean()

    def close(self) -> None:
        """Leave a snapshot behind, so that the next open has nothing to replay."""
        self.planner.clear()
        if self.tail:
            self.snapshot()

    # ---- search ----

    def __budget(self, ef: int | None) -> int:
        return ef if ef is not None else self.config["hnsw"]["ef_search"]

    def near(self, query: list[float], rows: DataFrame | None = None) -> tuple[DataFrame, CellSearch]:
        """The index's search as the planner wants it: candidates from the probed cells, of snapshot and log."""
        return (rows if rows is not None else self.__candidates()), CellSearch(self.cells(), query)

    def __candidates(self) -> DataFrame:
        """Live rows with their cell and code: the snapshot's but for ids in the tail, and the tail's last upserts.

        Only the tail is ranked; the snapshot's rows meet its ids in an anti-join, which is broadcast where it is small.
        """
        base, schema = self.indexed(), self.__schema(", cell int, code binary")
        if not self.tail:
            return base if base is not None else self.spark.createDataFrame([], schema)
        tail = log.latest_ops(log.read(self.store, self.tail, schema))
        if base is None:
            return tail.where("op = 'U'")
        return base.join(tail.select("id"), "id", "left_anti").unionByName(tail.where("op = 'U'"))

    def query(self, vector: Any, k: int = 10, filter: str | None = None, ef: int | None = None, strategy: str | None = None) -> Found:
        """The k nearest records as a DataFrame (all columns and `distance`), nearest first."""
        if not isinstance(k, int) or k <= 0:
            raise InvalidArgument(f"k must be positive, not {k!r}")
        if ef is not None and ef <= 0:
            raise InvalidArgument(f"ef must be positive, not {ef!r}")
        if np.ndim(vector) != 1:
            raise InvalidArgument("a query is one vector")
        q = [float(v) for v in self.__vectors(vector)[0]]
        wanted = self.__budget(ef)
        cells = self.cells() if self.config["index"] != "flat" else None
        learned = self.budget_model if ef is None and cells is not None else None
        node = parse(filter) if filter else None
        if node is not None:
            live, near = (self.records(), None) if cells is None else self.near(q)
            ef_for = (lambda share: learned.budget(np.asarray(q), cells, k, share)) if learned is not None else None
            return filtered_search(live, self.kinds, q, k, filter, self.planner, self.stats, self.manifest["rows"], strategy, wanted, near, self.version, learned=ef_for)
        if cells is None:
            label = "flat" if self.config["index"] == "flat" else "hnsw"
            return Found(top_k(self.records(), q, k), label, 0 if label == "flat" else wanted, None, {"ndist": self.manifest["rows"] + self.logged})
        live, near = self.near(q)
        if learned is not None:
            rows = near(live, k, learned.budget(np.asarray(q), cells, k))
            return Found(rows, "hnsw+early_stop", near.stats["probes"], None, near.stats)
        if (books := self.codebooks()) is None:
            return Found(near(live, k, wanted), "hnsw", wanted, None, near.stats)
        return self.__by_codes(live, q, k, wanted, cells, books)

    def __by_codes(self, live: DataFrame, q: list[float], k: int, ef: int, cells: ivf.Cells, books: np.ndarray) -> Found:
        """A pool by table lookup in the probed cells, and all rows without a code; then exact distances of those alone."""
        options = self.config["pq"]
        depth = max(pq.rerank_depth(k, ef, options["rerank_factor"], options["rerank_max"]), self.manifest.get("pool", 0))
        probes = cells.probe(np.asarray(q, np.float64), ef, depth)
        coded = live.where(F.col("cell").isin(probes) & F.col("code").isNotNull())
        chosen = coded.join(F.broadcast(pq.pool(coded, books, np.asarray(q, np.float64), depth)), "id", "left_semi")
        rows = top_k(chosen.unionByName(live.where("code is null")).drop("code"), q, k)
        return Found(rows, "hnsw_pq", ef, None, {"probes": len(probes), "ndist": int(cells.counts[probes].sum()), "reranked": depth})

    def search(self, vector: Any, k: int = 10, filter: str | None = None, ef: int | None = None, include_attributes: bool = False, strategy: str | None = None) -> SearchResult:
        """The k nearest records, collected."""
        found = self.query(vector, k, filter, ef, strategy)
        kinds = sorted(self.kinds) if include_attributes else []
        rows = found.rows.select("id", "distance", *kinds).orderBy("distance", "id").collect()
        attributes = [{a: r[a] for a in kinds if r[a] is not None} for r in rows] if include_attributes else None
        return SearchResult([r.id for r in rows], [r.distance for r in rows], SearchInfo(found.strategy, found.ef, found.selectivity, found.stats), attributes)

    def search_batch(self, queries: DataFrame, k: int = 10, filter: str | None = None, ef: int | None = None) -> DataFrame:
        """(qid, rank, id, distance) for every row (qid: long, qv) of `queries`, in one job a page of queries.

        With an index each query has its own cells; a filter is applied before the search, so results are as
        those of bitmap.  Rows travel under a 64-bit hash of their id; the distances of the hits are then taken again
        with the ids at hand, so ids that hash alike are told apart.
        """
        if self.config["metric"] == "cosine":
            queries = queries.withColumn("qv", l2_normalize(F.col("qv")))
        cells = self.cells() if self.config["index"] != "flat" else None
        live = self.__candidates()
        if filter:
            from nearfield.functions.filters import compile_filter

            live = live.where(compile_filter(parse(filter), self.kinds))
        keyed = live.withColumn("key", F.xxhash64("id"))
        if cells is None:
            found = top_k_batch(keyed, queries, k, "key", "vector")
        else:
            found = ivf.search_batch(keyed, cells, queries, k, self.__budget(ef), "key", "vector")
            if self.tail:  # rows that were logged before the index was there
                found = found.unionByName(top_k_batch(keyed.where("cell is null"), queries, k, "key", "vector"))
        hits = found.select("qid", "key").distinct().join(keyed.select("key", "id", "vector"), "key").join(queries.select("qid", "qv"), "qid")
        return ranked(hits.select("qid", "id", l2_distance(F.col("vector"), F.col("qv")).alias("distance")), k)

    def set_budget_model(self, model: Any) -> None:
        """A learned budget for plain `hnsw` searches without an explicit ef; None takes it away."""
        if model is not None and self.config["index"] != "hnsw":
            raise InvalidArgument(f"a budget model works with hnsw, not {self.config['index']}")
        self.budget_model = model

    # ---- figures ----

    def info(self) -> dict[str, Any]:
        """Name, settings, counts and sizes."""
        last = log.latest_ops(self.ops()).agg(F.count_if(F.col("op") == "U").alias("live"), F.count_if(F.col("op") == "D").alias("deleted")).first()
        sizes = {"vector_bytes": last.live * self.dim * 4, "index_bytes": self.index_bytes(), "stored_bytes": self.store.size()}
        return {"name": self.name, "dim": self.dim, "metric": self.config["metric"], "index": self.config["index"], "count": last.live, "deleted": last.deleted, **sizes, "lsn": self.lsn}

    def index_bytes(self) -> int:
        """Bytes of the centroids, codebooks and codes of the snapshot."""
        cells, books = self.cells(), self.codebooks()
        total = cells.centroids.size * 8 if cells is not None else 0
        return total + (books.size * 8 + self.manifest["rows"] * len(books) if books is not None else 0)


class CellSearch:
    """Exact search over the cells that a budget reaches; `stats` has the cells probed and the rows compared, as of the snapshot."""

    def __init__(self, cells: ivf.Cells, query: list[float]):
        self.cells, self.query, self.stats = cells, query, {}

    def __call__(self, records: DataFrame, k: int, ef: int) -> DataFrame:
        probes = self.cells.probe(np.asarray(self.query, np.float64), ef, k)
        self.stats = {"probes": len(probes), "ndist": int(self.cells.counts[probes].sum())}
        return top_k(records.where(F.col("cell").isin(probes) | F.col("cell").isNull()), self.query, k, "id")


def clean(value: Any) -> Any:
    """A number as a float, NaN as missing."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return value
    return None if math.isnan(value) else float(value)


def kinds_of(attributes: list[dict[str, Any]]) -> dict[str, str]:
    """The kind of each attribute in a batch; InvalidArgument where it has two, or a value is no scalar."""
    kinds: dict[str, str] = {}
    for record in attributes:
        for name, value in record.items():
            if not isinstance(value, (bool, int, float, str)):
                raise InvalidArgument(f"{name!r} is a {type(value).__name__}: attributes are numbers, strings or booleans")
            kind = BOOL if isinstance(value, bool) else STR if isinstance(value, str) else NUM
            if kinds.setdefault(name, kind) != kind:
                raise InvalidArgument(f"{name!r} is both {kinds[name]} and {kind}")
    return kinds
