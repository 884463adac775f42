"""The engine: named collections below one root, with the calls of a vector-search service."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from nearfield.collection import NAME, Collection, SearchResult
from nearfield.errors import AlreadyExists, InvalidArgument, NotFound
from nearfield.plans.planner import compare
from nearfield.sources.log import Store

#: Hits where a request leaves k open (0).
DEFAULT_K = 10


class Engine:
    """All collections of a root are found at the start and opened at their first use."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.store.make()
        self.open: dict[str, Collection] = {}

    def names(self) -> list[str]:
        return [n for n in self.store.names() if self.store.exists(n, "collection.json")]

    def collection(self, name: str) -> Collection:
        if name not in self.open:
            if not name or not self.store.exists(name, "collection.json"):
                raise NotFound(name)
            self.open[name] = Collection.open(self.spark, f"{self.store.root}/{name}")
        return self.open[name]

    def create_collection(self, name: str, dim: int, **options: Any) -> Collection:
        """Options are dotted settings, as `hnsw__M=32` or `metric="cosine"`."""
        if not name or name.startswith(".") or "/" in name or "\\" in name or not NAME.fullmatch(name.replace("-", "_").replace(".", "_")):
            raise InvalidArgument(f"bad collection name {name!r}")
        if name in self.names():
            raise AlreadyExists(name)
        self.open[name] = Collection.create(self.spark, f"{self.store.root}/{name}", name, dim, options)
        return self.open[name]

    def drop_collection(self, name: str) -> None:
        self.collection(name).planner.clear()
        del self.open[name]
        self.store.remove(name)

    def upsert(self, name: str, records: list[dict[str, Any]], batch: int = 1000) -> int:
        """Records {"id", "vector", "attributes"}, logged in batches; each batch is atomic."""
        target, total = self.collection(name), 0
        for at in range(0, len(records), batch):
            some = records[at : at + batch]
            for r in some:
                if any(v is None for v in r.get("attributes", {}).values()):
                    raise InvalidArgument(f"an attribute of {r['id']!r} has no value")
            total += target.upsert([r["id"] for r in some], [r["vector"] for r in some], [r.get("attributes", {}) for r in some])
        return total

    def search(self, name: str, vector: Any, k: int = 0, filter: str = "", ef: int = 0, include_attributes: bool = False) -> SearchResult:
        """0 and "" mean that the request leaves a field open."""
        return self.collection(name).search(vector, k or DEFAULT_K, filter or None, ef or None, include_attributes)

    def delete(self, name: str, ids: list[str]) -> int:
        return self.collection(name).delete(ids)

    def stats(self, name: str) -> dict[str, Any]:
        return self.collection(name).info()

    def compare(self, name: str, vector: Any, k: int, filter: str) -> list[dict]:
        """Each strategy's recall on one filtered query."""
        target = self.collection(name)
        return compare(target.records(), target.kinds, [float(v) for v in vector], k, filter, target.planner)

    def close(self) -> None:
        for target in self.open.values():
            target.close()
        self.open.clear()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
