"""The doors (HTTP, Flight), polled sources, half floats."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pyarrow.flight as fl
import pytest
from pyspark.sql import functions as F

from semevra import model as M
from semevra.engine import Engine
from semevra.functions.half import half, halves, packed, unpacked
from semevra.serving import flight, http
from semevra.sources import readers
from semevra.sources.polled import MemorySource, drain

NOW = 1_760_000_600_000


def row(i, tenant="t1", body=None):
    at = NOW - 60_000 + i
    return (f"e{i:04d}", tenant, at, at, "call", 0.5, False, body or f"refund case number {i}", "", "", {}, None)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine.init(spark, tmp_path_factory.mktemp("served").as_uri(), dim=16, nlist=4, pq_m=4, restarts=2)
    e.ingest(readers.corpus(spark, 200))
    return e


@pytest.fixture(scope="module")
def clients():
    return {
        http.fingerprint(b"all"): http.Client("all", frozenset({"t1", "t2"}), frozenset(http.SCOPES)),
        http.fingerprint(b"look"): http.Client("look", frozenset({"t1"}), frozenset({"search"})),
        http.fingerprint(b"none"): http.Client("none", frozenset({"t1"}), frozenset({"search"}), 0),
    }


def ask(server, path, value=None, token="all", method=None):
    request = urllib.request.Request(
        f"http://127.0.0.1:{server.server_port}{path}", None if value is None else value if isinstance(value, bytes) else json.dumps(value).encode(),
        {"Authorization": f"Bearer {token}"} if token else {}, method=method
    )
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            raw = r.read().decode()
            return r.status, json.loads(raw) if "json" in r.headers["Content-Type"] else raw
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())["error"]["code"]


def test_http_door(engine, clients):
    server = http.serve(engine, clients)
    try:
        assert ask(server, "/healthz") == (200, {"status": "ok", "version": "v1"})
        assert ask(server, "/readyz")[1]["status"] == "ready"
        status, got = ask(server, "/v1/search", {"tenant": "t1", "text": "refund payment", "k": 5, "explain": True})
        want = engine.search(M.Query(text="refund payment", tenant="t1", k=5)).rows.collect()
        assert status == 200 and [(r["event_id"], r["score"]) for r in got["result"]["rows"]] == [(r.event_id, r.score) for r in want]
        assert got["result"]["explain"]["rows_returned"] == 5 and "vector" not in got["result"]["rows"][0]
        page = ask(server, "/v1/sql", {"tenant": "t1", "query": "SELECT event_id FROM events LIMIT 3"})[1]["result"]
        more = ask(server, "/v1/sql", {"tenant": "t1", "query": "SELECT event_id FROM events LIMIT 3", "cursor": page["next_cursor"]})[1]["result"]
        assert len({r["event_id"] for r in page["rows"] + more["rows"]}) == 6
        for path, value, token, code in (
            ("/v1/search", {"tenant": "t3", "text": "x"}, "all", (403, "tenant_denied")),
            ("/v1/events", {"tenant": "t1", "events": []}, "look", (403, "scope_denied")),
            ("/v1/search", {"tenant": "t1", "text": "x"}, "none", (429, "concurrency_limit")),
            ("/v1/search", {"tenant": "t1", "text": "x"}, "else", (401, "unknown_client")),
            ("/v1/search", {"tenant": "t1", "text": "x"}, None, (401, "unknown_client")),
            ("/v1/search", b"{", "all", (400, "invalid_json")),
            ("/v1/search", b" " * (http.MAX_BODY + 1), "all", (413, "too_large")),
            ("/v1/sql", {"tenant": "t1", "query": "DROP TABLE events"}, "all", (422, "refused")),
            ("/v2/search", {}, "all", (404, "not_found")),
        ):
            assert ask(server, path, value, token) == code, (path, value)
        assert ask(server, "/healthz", method="DELETE") == (405, "method_not_allowed")
        assert "semevra_search_requests 1\n" in ask(server, "/metrics")[1]
    finally:
        server.shutdown()
        server.server_close()


@pytest.mark.parametrize(
    "change",
    [
        {"text": " "}, {"k": 0}, {"k": 101}, {"k": True}, {"group_k": 11}, {"time_from": 2, "time_to": 1}, {"threshold": 1.5}, {"threshold": float("nan")},
        {"tenant": "a b"}, {"tenant": ""}, {"space": ""}, {"extra": 1}, {"text": "x" * (http.MAX_TEXT + 1)}
    ]
)
def test_bad_searches_are_refused(change):
    with pytest.raises(ValueError):
        http.to_query({"tenant": "t1", "text": "x"} | change)
    assert http.to_query({"tenant": "t1", "text": "x", "k": None}).k == M.LIMIT


def test_http_ingest(spark, tmp_path):
    e = Engine.init(spark, tmp_path.as_uri(), dim=16, nlist=2, pq_m=2, restarts=1)
    s = http.Service(e, {http.fingerprint(b"k"): http.Client("k", frozenset({"t1"}), frozenset({"ingest"}))})
    import time

    at = int(time.time() * 1000)
    one = {"event_id": "a", "event_time": at, "event_name": "n", "cost": 1, "error": False, "body": "hello there", "attributes": {"x": 1, "y": "z", "w": True, "v": 0.5}}
    send = lambda *events: s.answer("POST", "/v1/events", b"k", json.dumps({"tenant": "t1", "events": list(events)}).encode())
    status, got = send(one, one | {"event_id": "b"}, one | {"event_id": "c", "event_time": 5})
    assert status == 200 and {
        k: got["result"][k] for k in ("offered", "published", "dead_lettered", "duplicates_suppressed")
    } == {"offered": 3, "published": 2, "dead_lettered": 1, "duplicates_suppressed": 0}
    assert send(one)[1]["result"]["duplicates_suppressed"] == 1
    assert e.sql("SELECT event_id FROM events WHERE attributes['x'] = 1 AND attributes['w'] = true", "t1").rows.count() == 2
    for bad in ({k: v for k, v in one.items() if k != "body"}, one | {"cost": "1"}, one | {"tenant_id": "t2"}, one | {"attributes": {"x": [1]}}, 7):
        assert send(bad)[0] == 400
    assert send()[0] == 400 and send(*[one] * (http.MAX_EVENTS + 1))[0] in (400, 413)


def test_requests_at_a_time_are_bounded(engine, monkeypatch):
    s = http.Service(engine, {http.fingerprint(b"k"): http.Client("k", frozenset({"t1"}), frozenset({"search"}), 1)})
    inside, go = threading.Event(), threading.Event()

    def slow(query):
        inside.set()
        go.wait(30)
        raise M.EngineError("enough") if query.text == "x" else RuntimeError("a fault")

    monkeypatch.setattr(engine, "search", slow)
    body = json.dumps({"tenant": "t1", "text": "x"}).encode()
    first = []
    t = threading.Thread(target=lambda: first.append(s.answer("POST", "/v1/search", b"k", body)))
    t.start()
    inside.wait(30)
    assert s.answer("POST", "/v1/search", b"k", body)[0] == 429
    go.set()
    t.join()
    assert first[0][0] == 422 and s.in_flight == 0
    status, got = s.answer("POST", "/v1/search", b"k", json.dumps({"tenant": "t1", "text": "y"}).encode())
    assert status == 500 and got["error"]["code"] == "fault" and "a fault" not in got["error"]["message"] and s.in_flight == 0


def test_flight_door(engine):
    door = flight.Door(engine, {"one": "t1"})
    try:
        client = fl.connect(f"grpc://127.0.0.1:{door.port}")
        as_ = lambda token: fl.FlightCallOptions(headers=[(b"authorization", f"Bearer {token}".encode())])
        get = lambda x, token="one": client.do_get(fl.Ticket(x if isinstance(x, bytes) else json.dumps(x).encode()), as_(token)).read_all()
        text = "SELECT event_id, cost FROM events WHERE cost > 0.01 LIMIT 4"
        first = get({"query": text})
        assert first.to_pylist() == [r.asDict() for r in engine.sql(text, "t1").rows.collect()]
        then = get({"query": text, "cursor": first.schema.metadata[b"next_cursor"].decode()})
        assert not set(first.column("event_id").to_pylist()) & set(then.column("event_id").to_pylist())
        for bad in (
            b"x", b"[]", {"query": ""}, {"query": text, "parameters": [1]}, {"query": text, "cursor": 7}, {"query": "x" * (flight.MAX_QUERY + 1)},
            b" " * (flight.MAX_MESSAGE + 1), {"query": "SELECT"}
        ):
            with pytest.raises(fl.FlightServerError):
                get(bad)
        with pytest.raises(fl.FlightUnauthenticatedError):
            get({"query": text}, "two")
    finally:
        door.shutdown()


def test_memory_source_moves_after_the_commit(spark, tmp_path, monkeypatch):
    e = Engine.init(spark, tmp_path.as_uri(), dim=16, nlist=2, pq_m=2, restarts=1)
    rows = [row(i) for i in range(7)]
    s = MemorySource(spark, e.store.root, "queue", rows)
    assert s.committed() == 0 and s.poll(3)[1] == 3 and s.committed() == 0
    monkeypatch.setattr(s, "commit", lambda offset: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        drain(e, s, 3, NOW)
    monkeypatch.undo()
    again = MemorySource(spark, e.store.root, "queue", rows)
    assert drain(e, again, 3, NOW) == {"replay": 3, "admitted": 4} and again.committed() == 7
    assert drain(e, again, 3, NOW) == {} and e.sql("SELECT count(*) FROM events", "t1").rows.first()[0] == 7
    with pytest.raises(M.EngineError):
        MemorySource(spark, e.store.root, "a/b", rows)


def test_half_floats(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    x = np.concatenate(
        [
            rng.standard_normal(4000), rng.standard_normal(2000) * 1e-6, rng.standard_normal(500) * 1e5, 2.0 ** np.arange(-30, 20), np.arange(2040, 2060) + 0.5,
            [0.0, -0.0, 65519.0, 65520.0, -65520.0, 2.0**-25, 2.0**-24, np.inf, -np.inf, np.nan]
        ]
    ).astype(np.float32)
    with np.errstate(over="ignore"):
        want = x.astype(np.float16).astype(np.float32)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    got = np.array([r[0] for r in df.orderBy("i").select(half(F.col("x"))).collect()])
    assert np.array_equal(got, want.astype(float), equal_nan=True)
    v = spark.createDataFrame([(1, [0.1, -2.5, 1e-7]), (2, []), (3, None), (4, [3.3])], "i int, v array<float>").orderBy("i")
    rows = v.select(unpacked(packed("v")).alias("a"), halves(F.col("v")).alias("b"), F.length(packed("v")).alias("n")).collect()
    assert [r.n for r in rows] == [6, 0, None, 2]
    assert all(r.a is None and r.b is None or list(r.a) == list(r.b) for r in rows)
