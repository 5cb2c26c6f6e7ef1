"""A JSON service over a database: requests as plain values, and a server of the standard library around them.

``Service.handle(method, path, body, headers)`` returns (status, answer) and can be put behind any server. It is the edge
for one driver: the frames behind it run on the cluster.
"""

from __future__ import annotations

import hmac
import json
import re
import threading
import time
from collections import defaultdict, deque
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import functions as F

from lodestar.collection import Collection, Database
from lodestar.config import ServiceSettings
from lodestar.errors import CollectionExistsError, DuplicateIdError, EngineError, NotFoundError, ValidationError

#: The most vectors of an add, queries of a batch, k of a batch, rows of a page.
MAX_ADD, MAX_QUERIES, MAX_BATCH_K, MAX_PAGE = 10_000, 100, 1000, 1000
_CONDITIONS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin")


class RateLimiter:
    """At most ``limit`` requests of a client in any 60 seconds; 0: no limit."""

    def __init__(self, limit: int, clock: Callable[[], float] = time.monotonic):
        self.limit, self.clock = limit, clock
        self._seen: dict[str, deque[float]] = defaultdict(deque)
        self._lock = threading.Lock()

    def allowed(self, client: str) -> bool:
        with self._lock:
            now, seen = self.clock(), self._seen[client]
            while seen and seen[0] <= now - 60:
                seen.popleft()
            if self.limit and len(seen) >= self.limit:
                return False
            seen.append(now)
            return True


def filter_of(spec: Any) -> dict | None:
    """{"match": {field: value}, "conditions": [{field, operator, value}]} as one filter; other dicts as they are."""
    if not spec or not ({"match", "conditions"} & spec.keys()):
        return spec or None
    parts: list[dict] = [{k: v} for k, v in (spec.get("match") or {}).items()]
    for c in spec.get("conditions") or []:
        if c.get("operator") not in _CONDITIONS:
            raise ValidationError(f"no operator {c.get('operator')!r}")
        parts.append({c["field"]: {f"${c['operator']}": c.get("value")}})
    return {"$and": parts} if parts else None


class Service:
    def __init__(self, db: Database, settings: ServiceSettings | None = None):
        self.db, self.settings, self.began, self.requests = db, settings or ServiceSettings(), time.time(), 0
        self.limiter = RateLimiter(self.settings.requests_per_minute)
        self.lock = threading.Lock()
        name, vid = r"/collections/(?P<name>[\w.-]+)", r"(?P<id>[\w.-]+)"
        self.routes: list[tuple[str, str, bool, Callable[..., Any]]] = [
            ("GET", "/health", False, self._health), ("GET", "/info", False, self._info), ("GET", "/metrics", False, self._metrics), ("POST", "/save", True, self._save), ("POST", "/compact", True, self._save),
            ("POST", "/collections", True, self._create), ("GET", "/collections", False, self._list), ("GET", name, False, self._one), ("DELETE", name, True, self._drop),
            ("POST", f"{name}/vectors", True, self._add), ("GET", f"{name}/vectors", False, self._page), ("POST", f"{name}/vectors/single", True, self._add_one), ("POST", f"{name}/vectors/delete", True, self._delete_many),
            ("GET", f"{name}/vectors/{vid}", False, self._get), ("PUT", f"{name}/vectors/{vid}", True, self._update), ("DELETE", f"{name}/vectors/{vid}", True, self._delete),
            ("POST", f"{name}/search", False, self._search), ("POST", f"{name}/search/batch", False, self._search_batch), ("POST", f"{name}/query", False, self._query),
        ]

    def handle(self, method: str, path: str, body: dict | None = None, headers: Mapping[str, str] | None = None, client: str = "") -> tuple[int, dict]:
        self.requests += 1
        if not self.limiter.allowed(client):
            return 429, {"error": "too many requests"}
        url = urlsplit(path)
        args = {**dict(parse_qsl(url.query)), **(body or {})}
        for verb, pattern, guarded, action in self.routes:
            if verb == method and (m := re.fullmatch(pattern, url.path)):
                if guarded and (refused := self._refused(headers or {})):
                    return refused
                try:
                    with self.lock if guarded else _Free():
                        return action(args, **m.groupdict())
                except NotFoundError as e:
                    return 404, {"error": f"not found: {e.args[0] if e.args else ''}"}
                except (DuplicateIdError, CollectionExistsError) as e:
                    return 409, {"error": str(e)}
                except (EngineError, KeyError, TypeError, ValueError) as e:
                    return 400, {"error": str(e)}
        return 404, {"error": "no such route"}

    def _refused(self, headers: Mapping[str, str]) -> tuple[int, dict] | None:
        if not self.settings.api_key:
            return None
        given = next((v for k, v in headers.items() if k.lower() == "x-api-key"), None)
        if given is None:
            return 401, {"error": "an API key is needed"}
        return None if hmac.compare_digest(given, self.settings.api_key) else (403, {"error": "wrong API key"})

    def _collection(self, name: str) -> Collection:
        return self.db.get_collection(name)

    @staticmethod
    def _limit(args: dict, default: int = 100) -> tuple[int, int]:
        limit, offset = int(args.get("limit", default)), int(args.get("offset", 0))
        if not 1 <= limit <= MAX_PAGE or offset < 0:
            raise ValidationError(f"limit is from 1 to {MAX_PAGE}, offset from 0")
        return limit, offset

    def _health(self, args: dict) -> tuple[int, dict]:
        return 200, {"status": "healthy", "uptime": time.time() - self.began}

    def _info(self, args: dict) -> tuple[int, dict]:
        return 200, self.db.info() | {"uptime": time.time() - self.began}

    def _metrics(self, args: dict) -> tuple[int, dict]:
        return 200, {"requests": self.requests, "collections": {n: self._collection(n).count() for n in self.db.list_collections()}}

    def _save(self, args: dict) -> tuple[int, dict]:
        return 200, {"saved": sorted(self.db.save(args.get("path"))["collections"])}

    def _create(self, args: dict) -> tuple[int, dict]:
        c = self.db.create_collection(args["name"], args["dimension"], args.get("metric", "euclidean"), args.get("normalize", False), args.get("max_vectors"))
        return 201, c.stats()

    def _list(self, args: dict) -> tuple[int, dict]:
        limit, offset = self._limit(args)
        names = self.db.list_collections()
        return 200, {"collections": names[offset : offset + limit], "total": len(names)}

    def _one(self, args: dict, name: str) -> tuple[int, dict]:
        return 200, self._collection(name).stats()

    def _drop(self, args: dict, name: str) -> tuple[int, dict]:
        if not self.db.delete_collection(name):
            raise NotFoundError(name)
        return 200, {"deleted": name}

    def _add(self, args: dict, name: str) -> tuple[int, dict]:
        if len(args["vectors"]) > MAX_ADD:
            raise ValidationError(f"at most {MAX_ADD} vectors at once")
        return 201, {"ids": self._collection(name).add_batch(args["vectors"], bool(args.get("overwrite", False)))}

    def _add_one(self, args: dict, name: str) -> tuple[int, dict]:
        return 201, {"id": self._collection(name).add(args.get("id"), args["vector"], args.get("metadata"), bool(args.get("overwrite", False)))}

    def _page(self, args: dict, name: str) -> tuple[int, dict]:
        limit, offset = self._limit(args)
        c = self._collection(name)
        rows = c.get_many([r.id for r in c.list_ids(limit, offset).collect()])
        return 200, {"vectors": [self._shown(r, args) for r in rows], "total": c.count()}

    @staticmethod
    def _shown(row: dict, args: dict) -> dict:
        return row if str(args.get("include_vector", "")).lower() in ("true", "1") else {k: v for k, v in row.items() if k != "vector"}

    def _get(self, args: dict, name: str, id: str) -> tuple[int, dict]:
        row = self._collection(name).get(id)
        if row is None:
            raise NotFoundError(id)
        return 200, self._shown(row, {"include_vector": True} | args)

    def _update(self, args: dict, name: str, id: str) -> tuple[int, dict]:
        self._collection(name).update(id, args.get("vector"), args.get("metadata"), args.get("mode", "replace"))
        return 200, {"id": id}

    def _delete(self, args: dict, name: str, id: str) -> tuple[int, dict]:
        if not self._collection(name).delete(id):
            raise NotFoundError(id)
        return 200, {"deleted": id}

    def _delete_many(self, args: dict, name: str) -> tuple[int, dict]:
        return 200, self._collection(name).delete_many(args["ids"])

    def _search(self, args: dict, name: str) -> tuple[int, dict]:
        c = self._collection(name)
        found = c.search(args["vector"], int(args.get("k", 10)), filter_of(args.get("filter")))
        shown = args.get("include_metadata", True)
        rows = found.select("id", "distance", "score", *[F.coalesce(F.to_json("metadata"), F.lit("{}")).alias("json")] * shown).collect()
        return 200, {"results": [{"id": r.id, "distance": r.distance, "score": r.score, **({"metadata": json.loads(r.json)} if shown else {})} for r in rows]}

    def _search_batch(self, args: dict, name: str) -> tuple[int, dict]:
        queries, k = args["queries"], int(args.get("k", 10))
        if not 0 < len(queries) <= MAX_QUERIES or k > MAX_BATCH_K:
            raise ValidationError(f"1 to {MAX_QUERIES} queries, k up to {MAX_BATCH_K}")
        df = self.db.spark.createDataFrame([(str(i), [float(x) for x in q]) for i, q in enumerate(queries)], "id string, vector array<double>")
        out: list[list[dict]] = [[] for _ in queries]
        for r in self._collection(name).search_batch(df, k, filter_of(args.get("filter"))).orderBy("query_id", "rank").collect():
            out[int(r.query_id)].append({"id": r.id, "distance": r.distance})
        return 200, {"results": out}

    def _query(self, args: dict, name: str) -> tuple[int, dict]:
        limit, _ = self._limit(args)
        c = self._collection(name)
        rows = c.get_many([r.id for r in c.query_by_metadata(filter_of(args.get("filter")), limit).select("id").collect()])
        return 200, {"results": [self._shown(r, args) for r in rows]}


class _Free:
    def __enter__(self) -> None: ...

    def __exit__(self, *_: Any) -> None: ...


class AutoSaver:
    """Saves a database every so many seconds until closed, and once more then."""

    def __init__(self, db: Database, seconds: float = 60.0):
        self.db, self.seconds, self._stop = db, seconds, threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        while not self._stop.wait(self.seconds):
            self.db.save()

    def close(self) -> None:
        self._stop.set()
        self._thread.join()
        self.db.close()


def serve(service: Service) -> ThreadingHTTPServer:
    """A server on the settings' host and port (0: any free one); run serve_forever on it."""

    class Handler(BaseHTTPRequestHandler):
        def _run(self) -> None:
            n = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(n)) if n else None
                status, answer = service.handle(self.command, self.path, body, dict(self.headers), self.client_address[0])
            except ValueError:
                status, answer = 400, {"error": "not JSON"}
            raw = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_PUT = do_DELETE = _run

        def log_message(self, *_: Any) -> None: ...

    return ThreadingHTTPServer((service.settings.host, service.settings.port), Handler)
