"""An Arrow Flight door to an engine: a statement goes in, record batches come out, one tenant a session.

The ticket is JSON {"query": text, "cursor": text}; the tenant is that of the bearer token, set below the statement as in
``Engine.sql``. Tickets are bounded, and bind parameters are refused rather than passed over. The cursor of the next page, if there
is one, is in the schema's metadata.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.flight as fl

from semevra import model as M
from semevra.engine import Engine

MAX_MESSAGE, MAX_QUERY = 256 << 10, 64 << 10


def decode(raw: bytes) -> tuple[str, str | None]:
    """(query, cursor) of a ticket; EngineError says what is wrong with it."""
    if len(raw) > MAX_MESSAGE:
        raise M.EngineError(f"a ticket has {MAX_MESSAGE} bytes at most")
    try:
        x = json.loads(raw)
        query, cursor, parameters = x["query"], x.get("cursor"), x.get("parameters")
    except (ValueError, KeyError, TypeError, AttributeError):
        raise M.EngineError("a ticket is a JSON object with a query") from None
    if not isinstance(query, str) or not query.strip() or len(query.encode()) > MAX_QUERY:
        raise M.EngineError(f"a query is a text of 1 to {MAX_QUERY} bytes")
    if parameters:
        raise M.EngineError("bind parameters are not supported; write the values into the statement")
    if cursor is not None and not isinstance(cursor, str):
        raise M.EngineError("a cursor is a text")
    return query, cursor


class _Tokens(fl.ServerMiddlewareFactory):
    def __init__(self, tenants: dict[str, str]) -> None:
        self.tenants = tenants

    def start_call(self, info: fl.CallInfo, headers: dict) -> fl.ServerMiddleware:
        value = next((v[0] for k, v in headers.items() if k.lower() == "authorization"), "")
        kind, _, token = value.partition(" ")
        if kind != "Bearer" or token not in self.tenants:
            raise fl.FlightUnauthenticatedError("the token is not known")
        return _Session(self.tenants[token])


class _Session(fl.ServerMiddleware):
    def __init__(self, tenant: str) -> None:
        self.tenant = tenant


class Door(fl.FlightServerBase):
    """Serves from its construction on, until ``shutdown()``. ``tenants`` by bearer token."""

    def __init__(self, engine: Engine, tenants: dict[str, str], location: str = "grpc://127.0.0.1:0", **options) -> None:
        super().__init__(location, middleware={"tenant": _Tokens(tenants)}, **options)
        self.engine = engine

    def do_get(self, context: fl.ServerCallContext, ticket: fl.Ticket) -> fl.RecordBatchStream:
        try:
            query, cursor = decode(ticket.ticket)
            r = self.engine.sql(query, context.get_middleware("tenant").tenant, cursor)
            table: pa.Table = r.rows.toArrow()  # LIMIT rows at most
        except M.EngineError as e:
            raise fl.FlightServerError(str(e)) from None
        return fl.RecordBatchStream(table.replace_schema_metadata({"snapshot": str(r.snapshot_id), "next_cursor": r.next_cursor or ""}))
