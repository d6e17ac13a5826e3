"""An HTTP door to an engine: /healthz, /readyz, /metrics, /v1/search, /v1/sql and /v1/events, with clients, scopes and tenants.

A client is known by the SHA-256 of its TLS certificate, or of a bearer token where there is no TLS. It may do what its scopes
say (health, metrics, search, sql, ingest), for its tenants alone, so many requests at a time. The tenant is set below the
query, never by it. Answers are bounded by k or LIMIT, so the driver holds no more than a page of rows. Requests are threads that
submit Spark jobs; the cluster does the work.
"""

from __future__ import annotations

import hashlib
import json
import logging
import math
import re
import ssl
import threading
import time
from collections import Counter
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.errors import PySparkException

from semevra import model as M
from semevra.engine import Engine

VERSION = "v1"
MAX_BODY, MAX_TEXT, MAX_K, MAX_EVENTS, MAX_REQUESTS, TIMEOUT_S = 256 << 10, 64 << 10, 100, 1024, 128, 15
SCOPES = {"health", "metrics", "search", "sql", "ingest"}
_NAME = re.compile(r"[A-Za-z0-9._-]{1,128}\Z")
_SEARCH = {"tenant": str, "text": str, "time_from": int, "time_to": int, "k": int, "group_k": int, "space": str, "threshold": float, "explain": bool, "fetch_budget_bytes": int}
_SQL = {"tenant": str, "query": str, "cursor": str}
_EVENT = {
    "event_id": str, "event_time": int, "event_name": str, "cost": float, "error": bool, "body": str, "trace_id": str, "span_id": str, "attributes": dict,
    "idempotency_key": str
}
_NEEDED = {"event_id", "event_time", "event_name", "cost", "error", "body"}


class Refused(Exception):
    """An answer other than 200."""

    def __init__(self, status: int, code: str, message: str) -> None:
        super().__init__(message)
        self.status, self.code = status, code


@dataclass
class Client:
    name: str
    tenants: frozenset[str]
    scopes: frozenset[str]
    max_in_flight: int = 8
    in_flight: int = field(default=0, compare=False)

    def __post_init__(self) -> None:
        if not self.scopes <= SCOPES:
            raise M.EngineError(f"unknown scopes {sorted(self.scopes - SCOPES)}")


def fingerprint(secret: bytes) -> str:
    return hashlib.sha256(secret).hexdigest()


def _fields(x: Any, known: dict[str, type], needed: set[str]) -> dict:
    """``x`` with no fields but the known ones, of their types; nulls are as if they were not there."""
    if not isinstance(x, dict):
        raise ValueError("an object is expected")
    if set(x) - set(known):
        raise ValueError(f"unknown fields {sorted(set(x) - set(known))}")
    out = {k: v for k, v in x.items() if v is not None}
    if needed - set(out):
        raise ValueError(f"missing fields {sorted(needed - set(out))}")
    for k, v in out.items():
        ok = isinstance(v, (int, float)) and not isinstance(v, bool) if known[k] is float else type(v) is known[k]
        if not ok or known[k] is int and not -(1 << 63) <= v < 1 << 63:
            raise ValueError(f"{k} is not of type {known[k].__name__}")
    return out


def _tenant(x: dict) -> str:
    if not _NAME.match(x["tenant"]):
        raise ValueError("tenant must be 1 to 128 letters, digits, dots, dashes or underscores")
    return x["tenant"]


def to_query(x: dict) -> M.Query:
    """The search that a request asks for; ValueError says what is wrong with it."""
    x = _fields(x, _SEARCH, {"tenant", "text"})
    tenant = _tenant(x)
    if not x["text"].strip() or len(x["text"].encode()) > MAX_TEXT:
        raise ValueError(f"text must have 1 to {MAX_TEXT} bytes")
    if not 1 <= x.setdefault("k", M.LIMIT) <= MAX_K:
        raise ValueError(f"k must be within 1 to {MAX_K}")
    if not 1 <= x.get("group_k", 1) <= x["k"]:
        raise ValueError("group_k must be within 1 to k")
    if "time_from" in x and "time_to" in x and x["time_from"] > x["time_to"]:
        raise ValueError("time_from must not be after time_to")
    if not -1 <= x.get("threshold", 0) <= 1:
        raise ValueError("threshold must be within -1 to 1")
    if not 1 <= len(x.get("space", "x")) <= 256:
        raise ValueError("space must have 1 to 256 characters")
    return M.Query(**{**x, "tenant": tenant})


def _tagged(v: Any) -> tuple:
    """A value as the data model holds it."""
    if isinstance(v, bool):
        return M.BOOL, None, None, None, v
    if isinstance(v, int):
        return M.INT, None, v, None, None
    if isinstance(v, float):
        return M.DOUBLE, None, None, v, None
    if isinstance(v, str):
        return M.STR, v, None, None, None
    raise ValueError("an attribute is a text, a number or a boolean")


def to_events(x: dict, now_ms: int) -> tuple[str, list[tuple]]:
    """(tenant, rows of the data model) of an ingest request."""
    x = _fields(x, {"tenant": str, "events": list}, {"tenant", "events"})
    tenant = _tenant(x)
    if not 1 <= len(x["events"]) <= MAX_EVENTS:
        raise ValueError(f"events must have 1 to {MAX_EVENTS} items")
    rows = []
    for e in x["events"]:
        e = _fields(e, _EVENT, _NEEDED)
        attributes = {k: _tagged(v) for k, v in e.get("attributes", {}).items()}
        rows.append(
            (
                e["event_id"], tenant, e["event_time"], now_ms, e["event_name"], float(e["cost"]), e["error"], e["body"], e.get("trace_id", ""),
                e.get("span_id", ""), attributes, e.get("idempotency_key")
            )
        )
    return tenant, rows


def _plain(v: Any) -> Any:
    """A value that JSON can hold: numbers that are not finite become texts."""
    if isinstance(v, float) and not math.isfinite(v):
        return str(v)
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


class Service:
    """What the routes do, without the network. ``clients`` by fingerprint."""

    def __init__(self, engine: Engine, clients: dict[str, Client]) -> None:
        self.engine, self.clients = engine, clients
        self.count: Counter[str] = Counter()
        self.lock, self.writing = threading.Lock(), threading.Lock()
        self.in_flight, self.number = 0, 0

    def answer(self, method: str, path: str, secret: bytes | None, body: bytes = b"") -> tuple[int, Any]:
        """(status, JSON value, or a text for /metrics)."""
        with self.lock:
            self.number += 1
            request = f"r{self.number:08d}"
            self.count["requests"] += 1
        try:
            client = self.clients.get(fingerprint(secret)) if secret else None
            if client is None:
                raise Refused(401, "unknown_client", "the client is not known")
            return self._route(method, path, client, body, request)
        except Refused as e:
            with self.lock:
                self.count["refused"] += 1
                self.count[f"status_{e.status}"] += 1
            return e.status, {"request_id": request, "error": {"code": e.code, "message": str(e)}}

    def _route(self, method: str, path: str, client: Client, body: bytes, request: str) -> tuple[int, Any]:
        routes = {
            ("GET", "/healthz"): "health", ("GET", "/readyz"): "health", ("GET", "/metrics"): "metrics", ("POST", "/v1/search"): "search",
            ("POST", "/v1/sql"): "sql", ("POST", "/v1/events"): "ingest"
        }
        if method not in ("GET", "POST"):
            raise Refused(405, "method_not_allowed", "GET and POST are allowed")
        scope = routes.get((method, path))
        if scope is None:
            raise Refused(404, "not_found", "there is no such route")
        if scope not in client.scopes:
            raise Refused(403, "scope_denied", f"the scope {scope} is needed")
        if path == "/healthz":
            return 200, {"status": "ok", "version": VERSION}
        if path == "/readyz":
            try:
                self.engine.snapshot()
            except Exception as e:
                raise Refused(503, "not_ready", "the store cannot be read") from e
            return 200, {"status": "ready", "version": VERSION}
        if path == "/metrics":
            with self.lock:
                return 200, "".join(f"# TYPE semevra_{k} counter\nsemevra_{k} {v}\n" for k, v in sorted(self.count.items())) + f"# TYPE semevra_in_flight gauge\nsemevra_in_flight {self.in_flight}\n"
        if len(body) > MAX_BODY:
            raise Refused(413, "too_large", f"a body has {MAX_BODY} bytes at most")
        try:
            asked = json.loads(body)
        except ValueError as e:
            raise Refused(400, "invalid_json", str(e)) from None
        try:
            tenant, work = {"search": self._search, "sql": self._sql, "ingest": self._ingest}[scope](asked)
        except (ValueError, TypeError) as e:
            raise Refused(400, f"invalid_{scope}", str(e)) from None
        if tenant not in client.tenants:
            raise Refused(403, "tenant_denied", "the client may not act for this tenant")
        with self.lock:
            if client.in_flight >= client.max_in_flight or self.in_flight >= MAX_REQUESTS:
                raise Refused(429, "concurrency_limit", "too many requests at a time")
            client.in_flight += 1
            self.in_flight += 1
            self.count[f"{scope}_requests"] += 1
        began = time.monotonic()
        try:
            return 200, {"request_id": request, "result": _plain(work())}
        except M.EngineError as e:
            raise Refused(422, "refused", str(e)) from None
        except PySparkException as e:
            raise Refused(503, f"{scope}_unavailable", "the request could not be completed") from e
        except Exception as e:  # the client learns no more than that; the log has it
            logging.getLogger(__name__).exception("request %s", request)
            raise Refused(500, "fault", "the request could not be completed") from e
        finally:
            with self.lock:
                client.in_flight -= 1
                self.in_flight -= 1
                self.count[f"{scope}_milliseconds"] += int(1000 * (time.monotonic() - began))

    def _search(self, asked: dict) -> tuple[str, Any]:
        query = to_query(asked)

        def work() -> dict:
            r = self.engine.search(query)
            rows = [x.asDict(True) for x in r.rows.drop("vector", "code").collect()]  # k rows at most
            return {
                "rows": rows, "snapshot_id": r.snapshot_id, "spaces": list(r.spaces), "bridged": r.bridged, "clusters": r.clusters,
                "explain": vars(r.explain) if query.explain and r.explain else None
            }

        return query.tenant, work

    def _sql(self, asked: dict) -> tuple[str, Any]:
        asked = _fields(asked, _SQL, {"tenant", "query"})
        tenant = _tenant(asked)
        if not 1 <= len(asked["query"].encode()) <= MAX_TEXT:
            raise ValueError(f"query must have 1 to {MAX_TEXT} bytes")

        def work() -> dict:
            r = self.engine.sql(asked["query"], tenant, asked.get("cursor"))
            return {"rows": [x.asDict(True) for x in r.rows.collect()], "snapshot_id": r.snapshot_id, "next_cursor": r.next_cursor}  # LIMIT rows at most

        return tenant, work

    def _ingest(self, asked: dict) -> tuple[str, Any]:
        now = int(time.time() * 1000)
        tenant, rows = to_events(asked, now)

        def work() -> dict:
            events = self.engine.spark.createDataFrame(rows, M.EVENT)
            with self.writing:  # one commit after another
                out = self.engine.admit_and_ingest(events, now)
                snapshot = self.engine.snapshot().id
            reasons = {k: v for k, v in out.items() if k not in ("admitted", "replay")}
            with self.lock:
                self.count["ingested_events"] += out.get("admitted", 0)
            return {
                "offered": len(rows), "published": out.get("admitted", 0), "duplicates_suppressed": out.get("replay", 0),
                "dead_lettered": sum(reasons.values()), "by_reason": reasons, "snapshot_id": snapshot
            }

        return tenant, work


class Handler(BaseHTTPRequestHandler):
    timeout = TIMEOUT_S
    service: Service

    def _secret(self) -> bytes | None:
        if isinstance(self.connection, ssl.SSLSocket):
            return self.connection.getpeercert(binary_form=True)
        kind, _, token = self.headers.get("Authorization", "").partition(" ")
        return token.encode() if kind == "Bearer" and token else None

    def _do(self) -> None:
        try:
            n = int(self.headers.get("Content-Length", 0))
        except ValueError:
            n = -1
        if n < 0 or n > MAX_BODY:
            status, value = 413, {"error": {"code": "too_large", "message": f"a body has {MAX_BODY} bytes at most"}}
        else:
            status, value = self.service.answer(self.command, self.path, self._secret(), self.rfile.read(n))
        text = isinstance(value, str)
        raw = value.encode() if text else json.dumps(value, ensure_ascii=False, default=str).encode()
        self.send_response(status)
        self.send_header("Content-Type", "text/plain; version=0.0.4" if text else "application/json")
        self.send_header("Content-Length", str(len(raw)))
        self.send_header("Connection", "close")
        self.end_headers()
        self.wfile.write(raw)

    do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = _do

    def log_message(self, *_: Any) -> None:
        """Spark's log has what matters."""


def serve(engine: Engine, clients: dict[str, Client], host: str = "127.0.0.1", port: int = 0, tls: ssl.SSLContext | None = None) -> ThreadingHTTPServer:
    """A server that answers from a thread of its own until ``shutdown()``. ``tls`` should ask for client certificates."""
    server = ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"service": Service(engine, clients)}))
    if tls is not None:
        server.socket = tls.wrap_socket(server.socket, server_side=True)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
