"""The engine over HTTP with JSON bodies, and a client; standard library only.

    POST   /collections                    {"name", "dim", "options"}                              201
    GET    /collections                    names
    GET    /collections/<name>             settings, counts and sizes
    DELETE /collections/<name>
    POST   /collections/<name>/upsert      {"records": [{"id", "vector", "attributes"}]}           {"upserted"}
    POST   /collections/<name>/search      {"vector", "k", "filter", "ef", "include_attributes"}   {"hits", "strategy", "ef", "selectivity", "stats"}
    POST   /collections/<name>/delete      {"ids"}                                                 {"deleted"}
    POST   /collections/<name>/compare     {"vector", "k", "filter"}                               {"strategies"}

A bad request is 400, an unknown collection or path 404, a collection that is there already 409, each with {"error"}.
Collections have one writer: requests that write take turns, searches run side by side.

    python -m nearfield.server --root hdfs:///vectors --port 8080
"""

from __future__ import annotations

import argparse
import contextlib
import json
import threading
import urllib.error
import urllib.parse
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from nearfield.engine import Engine
from nearfield.errors import AlreadyExists, CollectionError, InvalidArgument, NotFound

#: Bytes of a request's body at most.
MAX_BODY = 64 << 20


class Service:
    """The requests, apart from how they arrive."""

    def __init__(self, engine: Engine):
        self.engine, self.writing = engine, threading.Lock()

    def handle(self, method: str, path: str, body: dict[str, Any]) -> tuple[int, Any]:
        """(status, answer)."""
        parts = [urllib.parse.unquote(p) for p in path.split("?")[0].strip("/").split("/")]
        writes = (method, parts[-1]) not in (("POST", "search"), ("POST", "compare")) and method != "GET"
        try:
            with self.writing if writes else contextlib.nullcontext():
                return self.route(method, parts, body)
        except NotFound as e:
            return 404, {"error": f"no collection {e.args[0] if e.args else ''}"}
        except AlreadyExists as e:
            return 409, {"error": f"{e} exists"}
        except (CollectionError, KeyError, TypeError, ValueError) as e:
            return 400, {"error": str(e) or type(e).__name__}

    def route(self, method: str, parts: list[str], body: dict[str, Any]) -> tuple[int, Any]:
        engine = self.engine
        match (method, *parts):
            case ("POST", "collections"):
                engine.create_collection(body["name"], body["dim"], **body.get("options") or {})
                return 201, {"name": body["name"]}
            case ("GET", "collections"):
                return 200, {"collections": engine.names()}
            case ("GET", "collections", name):
                return 200, engine.stats(name)
            case ("DELETE", "collections", name):
                engine.drop_collection(name)
                return 200, {"dropped": name}
            case ("POST", "collections", name, "upsert"):
                return 200, {"upserted": engine.upsert(name, body["records"])}
            case ("POST", "collections", name, "delete"):
                return 200, {"deleted": engine.delete(name, body["ids"])}
            case ("POST", "collections", name, "compare"):
                return 200, {"strategies": engine.compare(name, body["vector"], body.get("k") or 10, body["filter"])}
            case ("POST", "collections", name, "search"):
                found = engine.search(name, body["vector"], body.get("k") or 0, body.get("filter") or "", body.get("ef") or 0, bool(body.get("include_attributes")))
                hits = [{"id": i, "distance": d} for i, d in zip(found.ids, found.distances, strict=True)]
                for hit, attributes in zip(hits, found.attributes or [], strict=False):
                    hit["attributes"] = attributes
                return 200, {"hits": hits, "strategy": found.info.strategy, "ef": found.info.ef, "selectivity": found.info.selectivity, "stats": found.info.stats}
        return 404, {"error": f"no such path: {method} /{'/'.join(parts)}"}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    """A request handler for a service."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MAX_BODY:
                self.close_connection = True
                status, found = 400, {"error": f"a body has {MAX_BODY} bytes at most"}
            else:
                try:
                    body = json.loads(self.rfile.read(size) or b"{}")
                    status, found = service.handle(self.command, self.path, body) if isinstance(body, dict) else (400, {"error": "the body is no object"})
                except json.JSONDecodeError as e:
                    status, found = 400, {"error": f"the body is no JSON: {e}"}
            data = json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = answer

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server over the engine, all collections opened; `serve_forever` runs it."""
    for name in engine.names():
        engine.collection(name)
    return ThreadingHTTPServer((host, port), handler(Service(engine)))


class Client:
    """The engine's calls, sent to a server; its errors come back as the same classes."""

    ERRORS = {400: InvalidArgument, 404: NotFound, 409: AlreadyExists}

    def __init__(self, url: str = "http://127.0.0.1:8080"):
        self.url = url.rstrip("/")

    def call(self, method: str, path: str, body: dict[str, Any] | None = None) -> Any:
        data = json.dumps(body).encode() if body is not None else None
        request = urllib.request.Request(f"{self.url}/collections{path}", data, {"Content-Type": "application/json"}, method=method)
        try:
            with urllib.request.urlopen(request) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            raise self.ERRORS.get(e.code, CollectionError)(json.load(e)["error"]) from None

    @staticmethod
    def path(name: str, action: str = "") -> str:
        return f"/{urllib.parse.quote(name, safe='')}{action}"

    def create_collection(self, name: str, dim: int, **options: Any) -> None:
        self.call("POST", "", {"name": name, "dim": dim, "options": options})

    def drop_collection(self, name: str) -> None:
        self.call("DELETE", self.path(name))

    def upsert(self, name: str, records: list[dict[str, Any]], batch: int = 1000) -> int:
        return sum(self.call("POST", self.path(name, "/upsert"), {"records": records[at : at + batch]})["upserted"] for at in range(0, len(records), batch))

    def search(self, name: str, vector: list[float], k: int = 0, filter: str = "", ef: int = 0, include_attributes: bool = False) -> dict[str, Any]:
        return self.call("POST", self.path(name, "/search"), {"vector": [float(v) for v in vector], "k": k, "filter": filter, "ef": ef, "include_attributes": include_attributes})

    def delete(self, name: str, ids: list[str]) -> int:
        return self.call("POST", self.path(name, "/delete"), {"ids": ids})["deleted"]

    def compare(self, name: str, vector: list[float], k: int, filter: str) -> list[dict[str, Any]]:
        return self.call("POST", self.path(name, "/compare"), {"vector": [float(v) for v in vector], "k": k, "filter": filter})["strategies"]

    def stats(self, name: str) -> dict[str, Any]:
        return self.call("GET", self.path(name))


def main() -> None:
    from pyspark.sql import SparkSession

    options = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    options.add_argument("--root", required=True, help="folder of the collections, on any file system that Spark reaches")
    options.add_argument("--host", default="127.0.0.1")
    options.add_argument("--port", type=int, default=8080)
    given = options.parse_args()
    with Engine(SparkSession.builder.appName("nearfield").getOrCreate(), given.root) as engine:
        serve(engine, given.host, given.port).serve_forever()


if __name__ == "__main__":
    main()
