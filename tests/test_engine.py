"""The engine end to end: parity, invariance, refusals, lifecycle."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from semevra import model as M
from semevra.engine import Engine, run_plan
from semevra.functions.codebook import distances, kmeans, nearest_of, probes, sums_by, train
from semevra.functions.embed import HashEmbedder, tokens, with_vectors
from semevra.functions.hashing import Random, content_id, fnv1a64, tenant_bucket
from semevra.operators import analytics, ingest, maintenance, search
from semevra.plans import sql as S
from semevra.plans.predicate import And, Attr, Cmp, Col, In, Lit, Not, Or, compile_predicate, time_bounds
from semevra.sources import readers
from semevra.streaming.ingest import stream_into

NO = {}


def attribute(v):
    tag = M.BOOL if isinstance(v, bool) else M.INT if isinstance(v, int) else M.DOUBLE if isinstance(v, float) else M.STR
    return (tag, v if tag == M.STR else None, v if tag == M.INT else None, v if tag == M.DOUBLE else None, v if tag == M.BOOL else None)


def event(i, tenant="t1", body=None, at=None, attributes=None, cost=0.1, error=False, name="call", key=None):
    at = 1_760_000_000_000 + i * 1000 if at is None else at
    return (f"e{i:05d}", tenant, at, at, name, cost, error, f"body number {i}" if body is None else body, "", "", {k: attribute(v) for k, v in (attributes or NO).items()}, key)


def events(spark, rows):
    return spark.createDataFrame(rows, M.EVENT)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    e = Engine.init(spark, tmp_path_factory.mktemp("store").as_uri(), dim=32, nlist=8, pq_m=4, seed=7, restarts=2)
    e.ingest(readers.corpus(spark, 600))
    return e


def ids(df):
    return [r.event_id for r in df.select("event_id").collect()]


# functions -------------------------------------------------------------------------------------------------------------


def test_embedder():
    e = HashEmbedder(64)
    v = e.embed("Refund failed refund")
    assert abs(float((v.astype(float) ** 2).sum()) - 1) < 1e-6
    assert (v == HashEmbedder(64, "2").embed("refund FAILED, refund")).all()
    assert tokens("a-B c1!é") == ["a", "b", "c1", "é"]
    assert fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    with pytest.raises(M.EngineError, match="no tokens"):
        e.embed(" .,! ")
    assert (e.embed("x" * 40_000) == e.embed("x" * (32 << 10))).all()


def test_bucket_expression(spark):
    import hashlib

    names = ["acme", "t1", "é"]
    got = spark.createDataFrame([(n,) for n in names], "t string").select(tenant_bucket(F.col("t"))).collect()
    assert [r[0] for r in got] == [int.from_bytes(hashlib.sha256(n.encode()).digest()[:4], "little") % 16 for n in names]
    assert content_id(b"") == "e3b0c44298fc1c14"


def test_generator_and_kmeans_are_deterministic():
    assert [Random(42).next() for _ in range(2)] == [Random(42).next() for _ in range(2)]
    assert 0 <= min(Random(1).array(100)) and max(Random(1).array(100)) < 1
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (40, 4)) for c in (0, 3, 6)]).astype(np.float32)
    a, inertia = kmeans(x, 3, 25, 5)
    assert sorted(np.round(a[:, 0]).tolist()) == [0, 3, 6] and inertia < 2
    assert (a == kmeans(x, 3, 25, 5)[0]).all()
    assert len(train(x[:2], 8, 2, 1).coarse) == 2


def test_probes_widen_only():
    d = np.array([1.0, 2.0, 2.01, 2.02, 3.0])
    assert probes(d, 2, False, 0.02, 16) == 2 and probes(d, 2, True, 0.02, 16) == 4 and probes(d, 9, True, 0.02, 16) == 5
    assert probes(d, 2, True, 0.02, 3) == 3


# predicates ------------------------------------------------------------------------------------------------------------

PREDICATES = [
    (Cmp("=", Attr("s"), Lit("x")), {0}),
    (Not(Cmp("=", Attr("s"), Lit("x"))), {1}),
    (Cmp("<>", Attr("n"), Lit(5)), {1}),
    (Cmp(">=", Attr("n"), Lit(4.5)), {0}),
    (Cmp(">", Attr("s"), Lit(1)), set()),
    (Not(Cmp(">", Attr("s"), Lit(1))), set()),
    (In(Attr("n"), (Lit(5), Lit("y"))), {0}),
    (Not(In(Attr("n"), (Lit("y"),))), {0, 1}),
    (Attr("b"), {0}),
    (Not(Attr("b")), {1}),
    (Or(Cmp("=", Attr("absent"), Lit(1)), Cmp("=", Col("cost"), Lit(2))), {2}),
    (And(Not(Cmp("=", Attr("absent"), Lit(1))), Lit(True)), set()),
    (Cmp("<", Lit(1), Col("cost")), {2}),
    (Cmp("=", Col("error"), Lit(False)), {0, 1, 2}),
]


@pytest.mark.parametrize("promoted", [{}, {"s": "str", "n": "num", "b": "bool"}])
def test_predicate_matrix(spark, promoted):
    rows = [event(0, attributes={"s": "x", "n": 5, "b": True}), event(1, attributes={"s": "y", "n": 3.5, "b": False}), event(2, cost=2.0)]
    df = events(spark, rows)
    for k, f in promoted.items():
        a = F.col("attributes")[k]
        df = df.withColumn(f"attr.{k}", {"str": a["s"], "num": F.coalesce(a["i"].cast("double"), a["d"]), "bool": a["b"]}[f])
    for tree, want in PREDICATES:
        assert {int(x[1:]) for x in ids(df.filter(compile_predicate(tree, promoted)))} == want, tree


def test_bare_non_boolean_is_an_error(spark):
    df = events(spark, [event(0, attributes={"s": "x"})])
    with pytest.raises(M.EngineError):
        compile_predicate(Col("cost"))
    with pytest.raises(Exception, match="not boolean"):
        df.filter(compile_predicate(Attr("s"))).collect()


def test_time_bounds():
    tree = S.bind("SELECT event_id FROM events WHERE event_time > 5 AND event_time <= 9 AND (event_time < 3 OR error)", "t").predicate
    assert time_bounds(tree) == (6, 9)
    assert time_bounds(S.bind("SELECT event_id FROM events WHERE event_time = 4", "t").predicate) == (4, 4)
    assert time_bounds(Or(Cmp("<", Col("event_time"), Lit(3)), Lit(True))) == (None, None)


# SQL -------------------------------------------------------------------------------------------------------------------

REFUSED = [
    ("SELECT nope FROM events", "unknown column"),
    ("SELECT * FROM other", "only table"),
    ("SELECT * FROM events LIMIT 5 OFFSET 2", "OFFSET"),
    ("SELECT * FROM events ORDER BY cost DESC", "only order"),
    ("SELECT * FROM events ORDER BY score ASC, event_id ASC", "only order"),
    ("SELECT count(*) AS n FROM events", "expected"),
    ("SELECT event_id, count(*) FROM events", "GROUP BY"),
    ("SELECT *, count(*) FROM events GROUP BY error", "beside"),
    ("SELECT sum(body) FROM events", "number"),
    ("SELECT count(*) FROM events GROUP BY score", "cannot group"),
    ("SELECT count(*) FROM events GROUP BY semantic_cluster", "cannot group"),
    ("SELECT upper(body) FROM events", "unknown function"),
    ("SELECT * FROM events WHERE upper(body) = 'X'", "unknown function"),
    ("SELECT * FROM events; SELECT * FROM events", "unexpected"),
    ("SELECT * FROM events UNION SELECT * FROM events", "unexpected"),
    ("SELECT * FROM (SELECT * FROM events)", "expected"),
    ("SELECT * FROM events, events", "unexpected"),
    ("SELECT * FROM events WHERE cost", "not boolean"),
    ("SELECT * FROM events WHERE embedding ~~ ' '", "blank"),
    ("SELECT * FROM events WHERE embedding ~~ 'a' AND embedding ~~ 'b'", "only one"),
    ("SELECT * FROM events WHERE error OR embedding ~~ 'a'", "top-level"),
    ("SELECT * FROM events WHERE NOT embedding ~~ 'a'", "top-level"),
    ("SELECT * FROM events WITH (nprobe = 0)", "positive"),
    ("SELECT * FROM events WITH (speed = 1)", "unknown option"),
    ("SELECT * FROM events WHERE cost = NULL", "expected|unknown column"),
    ("SELECT * FROM events WHERE " + "(" * 40 + "error" + ")" * 40, "deeply"),
    ("SELECT * FROM events WHERE event_id IN (" + ",".join(["1"] * 1025) + ")", "1024"),
    ("SELECT * FROM events WHERE body LIKE 'x'", "unexpected|expected"),
    ("SELECT * FROM events -- " + "x" * 70_000, "64 KiB"),
]


@pytest.mark.parametrize("sql,message", REFUSED)
def test_refusals(sql, message):
    with pytest.raises(S.SqlError, match=message):
        S.bind(sql, "t1")


def test_empty_tenant_is_refused():
    with pytest.raises(S.SqlError, match="tenant"):
        S.bind("SELECT * FROM events", "")


def test_grammar_details():
    p = S.bind("select event_id as x, attributes['a''b'] From events /* c */ where Not error limit 3 with (nprobe=2, rerank=9); -- end", "t")
    assert [i.output for i in p.items] == ["event_id", "attributes[a'b]"] and (p.limit, p.nprobe, p.rerank) == (3, 2, 9)
    a, b = Cmp("=", Col("cost"), Lit(1)), Cmp("=", Col("cost"), Lit(-2))
    assert S.bind("SELECT * FROM events WHERE error OR cost = 1 AND cost = -2", "t").predicate == Or(Col("error"), And(a, b))
    loose = S.bind("SELECT * FROM events WHERE embedding ~~ 'q' AND error OR cost = 1", "t")
    assert loose.predicate == Or(Col("error"), a) and loose.semantic == "q"
    assert S.bind("SELECT * FROM events WHERE error OR cost = 1 AND embedding ~~ 'q'", "t").predicate == Or(Col("error"), a)


ESCAPES = [
    "tenant_id = 't2'", "tenant_id = 't2' OR TRUE", "NOT (tenant_id = 't1')", "TRUE OR tenant_id = 't2'", "tenant_id IN ('t2', 't3')", "tenant_id <> 't1'",
    "cost >= 0 OR cost < 0"
]


@pytest.mark.parametrize("where", ESCAPES)
def test_no_predicate_escapes_the_tenant(spark, where):
    df = events(spark, [event(i, tenant=f"t{i % 4}") for i in range(40)])
    plan = S.bind(f"SELECT event_id, tenant_id FROM events WHERE {where} LIMIT 100", "t1")
    assert {r.tenant_id for r in run_plan(plan, df).collect()} <= {"t1"}


def test_aggregates(spark):
    df = events(spark, [event(i, name=f"n{i % 2}", cost=i / 10, error=i % 3 == 0) for i in range(10)])
    run = lambda t: [tuple(r) for r in run_plan(S.bind(t, "t1"), df).collect()]
    assert run("SELECT count(*), sum(cost), avg(cost), min(cost), max(cost), min(body) FROM events") == [(10, 4.5, 0.45, 0.0, 0.9, None)]
    assert run("SELECT count(*), sum(cost), avg(cost) FROM events WHERE cost > 5") == [(0, 0.0, None)]
    assert run(
        "SELECT error, event_name, count(*) FROM events GROUP BY event_name, error LIMIT 1"
    ) == [("false", "n0", 3), ("true", "n0", 2), ("false", "n1", 3), ("true", "n1", 2)]
    assert run("SELECT body, count(*) FROM events GROUP BY error") == [(None, 6), (None, 4)]
    assert run("SELECT event_id FROM events LIMIT 0") == []


# store, search, pages --------------------------------------------------------------------------------------------------


def test_sql_equals_api(store):
    sql = store.sql("SELECT event_id, score FROM events WHERE embedding ~~ 'refund payment' AND cost > 0.01 LIMIT 5", "t1").rows
    api = store.search(M.Query(text="refund payment", tenant="t1", k=5, predicate=Cmp(">", Col("cost"), Lit(0.01)))).rows
    assert [tuple(r) for r in sql.collect()] == [(r.event_id, r.score) for r in api.collect()] and len(ids(api)) == 5


def test_approximate_recall_against_exact(store):
    scores = []
    for text in ("refund payment", "login failure case", "latency spike", "invoice tax escalation", "deploy rollback"):
        q = M.Query(text=text, tenant="t2", k=10)
        scores.append(search.recall(store.search(q).rows, store.exact_search(q).rows))
    assert np.mean(scores) >= 0.9


def test_answers_do_not_depend_on_layout(spark, store, tmp_path):
    other = Engine.init(spark, tmp_path.as_uri(), dim=32, nlist=8, pq_m=4, seed=7, restarts=2)
    rows = readers.corpus(spark, 600)
    for i in range(3):
        other.ingest(rows.filter(F.abs(F.hash("event_id")) % 3 == i).repartition(i + 1))
    q = M.Query(text="search index", k=20, exact=True)
    want = [(r.event_id, r.score) for r in store.search(q).rows.collect()]
    for _ in range(2):
        assert [(r.event_id, r.score) for r in other.search(q).rows.collect()] == want
        assert [
            tuple(r) for r in other.sql("SELECT count(*), sum(cost) FROM events", "t1").rows.collect()
        ] == [tuple(r) for r in store.sql("SELECT count(*), sum(cost) FROM events", "t1").rows.collect()]
        other.merge()
    assert other.verify() == []


def test_pages_tile_the_answer(store):
    text = "SELECT event_id FROM events WHERE error LIMIT 4"
    whole = ids(store.sql("SELECT event_id FROM events WHERE error LIMIT 1000", "t1").rows)
    seen, token = [], None
    for _ in range(100):
        r = store.sql(text, "t1", token)
        seen += ids(r.rows)
        token = r.next_cursor
        if token is None:
            break
    assert seen == whole == sorted(whole)
    first = store.sql(text, "t1")
    for bad, message in (("zz", "malformed"), ("00000000" + first.next_cursor[8:], "checksum"), (first.next_cursor[:8], "checksum|malformed")):
        with pytest.raises(M.EngineError, match=message):
            store.sql(text, "t1", bad)
    with pytest.raises(M.EngineError, match="another plan"):
        store.sql("SELECT event_id FROM events WHERE error LIMIT 5", "t1", first.next_cursor)
    with pytest.raises(M.EngineError, match="aggregate"):
        store.sql("SELECT count(*) FROM events", "t1", first.next_cursor)
    gone = search.make_cursor(9999, S.bind(text, "t1").fingerprint, 0.0, "e")
    with pytest.raises(M.EngineError, match="reclaimed"):
        store.sql(text, "t1", gone)


def test_pages_stay_on_their_snapshot(spark, tmp_path):
    e = Engine.init(spark, tmp_path.as_uri(), dim=16, nlist=2, pq_m=2, restarts=1)
    e.ingest(events(spark, [event(i) for i in range(9)]))
    one = e.sql("SELECT event_id FROM events LIMIT 5", "t1")
    e.ingest(events(spark, [event(i) for i in range(20, 25)]))
    e.delete(["e00007"])
    two = e.sql("SELECT event_id FROM events LIMIT 5", "t1", one.next_cursor)
    assert ids(two.rows) == [f"e{i:05d}" for i in range(5, 9)] and two.next_cursor is None


def test_threshold_grouping_and_explain(store):
    q = M.Query(text="refund payment", tenant="t1", threshold=0.5, k=100, nprobe=8)
    rows = store.search(q).rows.collect()
    assert rows and all(r.score >= 0.5 for r in rows)
    exact = {r.event_id for r in store.exact_search(q).rows.collect()}
    assert len({r.event_id for r in rows} & exact) >= 0.9 * len(exact)
    r = store.search(M.Query(text="refund", tenant="t1", k=5, group_k=3, explain=True, predicate=Cmp(">", Col("cost"), Lit(0.02))))
    assert sum(c["count"] for c in r.clusters) <= M.RERANK and all(c["exemplar"] in c["member_ids"] for c in r.clusters)
    assert r.explain.parts_total and 0 < r.explain.selectivity < 1 and r.explain.estimated_rows
    for k in ("scalar-first", "semantic-first", "interleaved"):
        assert ids(store.search(M.Query(text="refund", tenant="t1", plan=k)).rows) == ids(store.search(M.Query(text="refund", tenant="t1")).rows)
    for bad in (M.Query(text=" "), M.Query(text="x", nprobe=0), M.Query(text="x", k=-1)):
        with pytest.raises(M.EngineError):
            store.search(bad)
    assert store.search(M.Query(text="x", tenant="nobody")).rows.count() == 0


def test_parts_are_pruned(store):
    snap = store.snapshot()
    day = snap.parts[0]["window"]
    assert len(store.store.prune(snap, "nobody")) == 0
    assert len(store.store.prune(snap, "t1", hi=day - 1)) == 0
    assert 0 < len(store.store.prune(snap, "t1")) < len(snap.parts)


def test_delete_merge_redact_rollback_gc(spark, tmp_path):
    e = Engine.init(spark, tmp_path.as_uri(), dim=16, nlist=2, pq_m=2, restarts=1, promoted={"m": "str"})
    day = 86_400_000
    e.ingest(events(spark, [event(i, at=1_760_000_000_000 + i % 2 * day, attributes={"m": "a", "z": i}) for i in range(20)]))
    e.ingest(events(spark, [event(3, body="again number three", at=1_760_000_000_000 + day, attributes={"m": "b"})]))
    before = e.snapshot().id
    assert e.delete(["e00001", "e00001", "e00002"]) == 2 and e.delete(["e00001"]) == 0
    count = lambda: e.sql("SELECT count(*) FROM events", "t1").rows.first()[0]
    assert count() == 19
    e.merge()
    assert count() == 18 and e.snapshot().tombstones == [] and e.verify() == []
    one = e.sql("SELECT event_id, attributes['m'] FROM events WHERE attributes['m'] = 'b'", "t1").rows.collect()
    assert [tuple(r) for r in one] == [("e00003", "b")]
    with pytest.raises(M.EngineError, match="reason"):
        e.redact_bodies(0, " ")
    assert e.redact_bodies(1_760_000_000_000 + day // 2, "request") == 1
    bodies = {r.event_id: r.body for r in e.sql("SELECT * FROM events LIMIT 99", "t1").rows.collect()}
    assert bodies["e00000"] == "" and bodies["e00005"] != ""
    e.merge()
    assert any(p["redacted"] for p in e.snapshot().parts)
    with pytest.raises(M.EngineError, match="redacted"):
        e.reembed(HashEmbedder(16, "2"))
    e.rollback(before)
    assert count() == 21
    kept = e.gc(keep=2, dry_run=True, now_ms=int(time.time() * 1000) + 3 * 3_600_000)
    assert kept["snapshots"] and e.verify() == []
    e.gc(keep=1, now_ms=int(time.time() * 1000) + 3 * 3_600_000)
    assert e.verify() == [] and count() == 21
    with pytest.raises(M.EngineError, match="reclaimed"):
        e.snapshot(1)


def test_stale_writers_and_replays(spark, tmp_path):
    e = Engine.init(spark, tmp_path.as_uri(), dim=16, nlist=2, pq_m=2, restarts=1)
    old = e.snapshot()
    e.ingest(events(spark, [event(0)]), batch=0)
    e.ingest(events(spark, [event(0)]), batch=0)
    assert e.sql("SELECT count(*) FROM events", "t1").rows.first()[0] == 1
    with pytest.raises(M.EngineError, match="moved on"):
        e.store.commit(old, tombstones=["x"])
    with pytest.raises(M.EngineError, match="already"):
        Engine.init(spark, tmp_path.as_uri())
    with pytest.raises(M.EngineError, match="invalid_cost"):
        e.ingest(events(spark, [event(1, cost=-1.0)]))


def test_tier_plan():
    part = lambda i, rows, b=0: {"path": f"p{i}", "bucket": b, "window": 0, "generation": "g", "rows": rows}
    groups = maintenance.plan_tiers([part(i, 10) for i in range(9)] + [part(20 + i, 5000, 1) for i in range(4)] + [part(30, 10, 2)])
    assert sorted(len(g) for g in groups) == [4, 4, 4] and [g[0]["bucket"] for g in groups] == [0, 1, 0]


def test_generations_bridge_and_migration(spark, tmp_path):
    class Flipped(HashEmbedder):
        model_id = "flipped"

        def embed(self, text):
            return super().embed(text)[::-1].copy()

    e = Engine.init(spark, tmp_path.as_uri(), dim=16, nlist=2, pq_m=2, restarts=1)
    e.ingest(readers.corpus(spark, 60))
    first = e.snapshot().active
    g = e.generation_create(Flipped(16))
    assert e.generation_create(Flipped(16)) == g
    e.generation_canary(g)
    with pytest.raises(M.EngineError, match="cannot go"):
        e.generation_canary(g)
    assert e.generation_migrate(g, max_parts=1) == 1
    with pytest.raises(M.EngineError, match="several embedding spaces"):
        e.search(M.Query(text="refund payment"))
    with pytest.raises(M.EngineError, match="note"):
        e.bridge_declare("a", "b", "")
    e.bridge_declare("hash-embedder:1", "flipped:1", "checked by hand")
    r = e.search(M.Query(text="refund payment", k=5))
    assert r.bridged and r.rows.count() == 5
    assert len(e.search(M.Query(text="refund payment", space="flipped:1")).rows.collect()) > 0
    e.generation_promote(g)
    assert e.snapshot().active == g
    assert e.generation_migrate(g) >= 1 and e.generation_migrate(g) == 0
    status = e.migration_status()
    assert status[first]["parts"] == 0 and status[g]["rows"] == 60
    with pytest.raises(M.EngineError, match="retained snapshot"):
        e.generation_retire(first)
    assert e.gc(keep=1, now_ms=int(time.time() * 1000) + 3 * 3_600_000)["snapshots"]
    e.generation_retire(first)
    assert first not in e.migration_status()
    cmp = e.generation_compare(["refund payment", "login failure"], "t1", ("flipped:1", "flipped:1"))
    assert cmp["jaccard"] == 1.0
    e.reembed(HashEmbedder(16, "3"))
    assert e.search(M.Query(text="refund payment")).spaces == ("hash-embedder:3",)


def test_promotion_across_spaces_needs_a_bridge(spark, tmp_path):
    class Other(HashEmbedder):
        model_id = "other"

    e = Engine.init(spark, tmp_path.as_uri(), dim=16, nlist=2, pq_m=2, restarts=1)
    e.ingest(readers.corpus(spark, 20))
    g = e.generation_create(Other(16))
    with pytest.raises(M.EngineError, match="declare a bridge"):
        e.generation_promote(g)
    e.bridge_declare("hash-embedder:1", "other:1", "checked")
    e.generation_promote(g)
    assert e.snapshot().active == g


def test_writers_that_die_or_race(spark, tmp_path, monkeypatch):
    root = tmp_path.as_uri()
    e = Engine.init(spark, root, dim=16, nlist=2, pq_m=2, restarts=1)
    e.ingest(events(spark, [event(i) for i in range(5)]))
    before = e.snapshot()
    # dies between the manifest and CURRENT: the commit counts
    whole = e.store.files.write
    monkeypatch.setattr(e.store.files, "write", lambda name, text: (_ for _ in ()).throw(OSError("dead")) if name == "CURRENT" else whole(name, text))
    with pytest.raises(OSError, match="dead"):
        e.delete(["e00001"])
    other = Engine(spark, root)
    assert other.snapshot().id == before.id + 1 and other.snapshot().tombstones == ["e00001"]
    assert other.sql("SELECT count(*) FROM events", "t1").rows.first()[0] == 4
    # dies before the manifest: nothing has changed, and the next writer goes on
    monkeypatch.setattr(e.store.files, "create", lambda name, text: (_ for _ in ()).throw(OSError("dead")))
    with pytest.raises(OSError, match="dead"):
        e.delete(["e00002"])
    assert other.snapshot().id == before.id + 1 and other.delete(["e00003"]) == 1
    # two writers that both saw the same snapshot: one is refused, whoever of them
    import concurrent.futures

    base = other.snapshot()
    writers = [Engine(spark, root) for _ in range(4)]

    def write(k):
        try:
            writers[k].store._put(base.data | {"tombstones": [str(k)]}, base.id + 1)
            return k
        except M.EngineError:
            return None

    with concurrent.futures.ThreadPoolExecutor(4) as pool:
        done = [k for k in pool.map(write, range(4)) if k is not None]
    assert len(done) == 1 and other.snapshot().tombstones == [str(done[0])] and other.snapshot().id == base.id + 1
    report = other.fsck()
    assert report["orphans"] == report["snapshots"] == report["codebooks"] == []


def test_current_is_never_missing(spark, tmp_path):
    from semevra.sources.store import Files

    f = Files(spark, tmp_path.as_uri())
    f.write("CURRENT", "0")
    seen = []
    import threading

    def read():
        while len(seen) < 300:
            seen.append(f.read("CURRENT"))

    t = threading.Thread(target=read)
    t.start()
    n = 0
    while t.is_alive():
        n += 1
        f.write("CURRENT", str(n))
    t.join()
    assert len(seen) >= 300 and all(x.isdigit() for x in seen)
    assert f.create("one", "a") and not f.create("one", "b") and f.read("one") == "a"


def test_search_reads_no_more_than_it_needs(spark, tmp_path):
    e = Engine.init(spark, tmp_path.as_uri(), dim=32, nlist=8, pq_m=4, seed=7, restarts=1)
    e.ingest(readers.corpus(spark, 400))
    e.ingest(readers.corpus(spark, 400, seed=99).withColumns({"event_id": F.concat(F.lit("b"), "event_id"), "event_time": F.col("event_time") + 40 * M.DAY_MS}))
    q = M.Query(text="refund payment", tenant="t1", k=3, nprobe=1, adaptive=False, candidates=4, rerank=4, explain=True)
    r = e.search(q)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = r.rows._jdf.queryExecution().executedPlan().toString()
    x = r.explain
    # whole rows: only of parts with a candidate, filtered by list, time and id in the scan
    assert x.candidates_found == 4 and 1 <= x.parts_fetched <= min(4, x.parts_scanned) and x.parts_scanned <= x.parts_total - x.parts_pruned
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert all(f in pushed for f in ("In(event_id", "EqualTo(centroid", "GreaterThanOrEqual(event_time", "LessThanOrEqual(event_time", "EqualTo(tenant_id"))
    assert x.rows_returned == 3 and x.bytes_fetched == 4 * 4 * 32 and 0 < x.rows_scanned < 800 and x.elapsed_ms >= 0
    # codes: neither vectors nor bodies
    book = e.store.codebook(e.snapshot().active)
    v = e.embedder.embed("refund payment")
    narrow = e.store.read(e.snapshot().parts).filter(F.col("centroid").isin(x.lists)).select(*search.KEY, "centroid", search.adc(F.col("code"), book.table(v)).alias("dist"))
    scan = narrow._jdf.queryExecution().executedPlan().toString()
    schema = scan[scan.index("ReadSchema") :].split("\n")[0]
    assert "vector" not in schema and "body" not in schema and "code" in schema
    # the byte budget bounds what is fetched
    less = e.search(M.Query(text="refund payment", tenant="t1", k=3, nprobe=8, explain=True, fetch_budget_bytes=2 * 4 * 32))
    assert less.explain.candidates_found == 2 and less.rows.count() == 2
    # parts without a probed list are not opened
    snap = e.snapshot()
    for p in snap.parts:
        held = {c for s in p["tenants"].values() for c in range(8) if int(s["lists"], 16) >> c & 1}
        for c in range(8):
            assert (p in e.store.prune(snap, lists=[c])) == (c in held)


def test_large_parts_have_several_files(spark, tmp_path, monkeypatch):
    from semevra.sources import store as stores

    monkeypatch.setattr(stores, "PART_FILE_ROWS", 50)
    e = Engine.init(spark, tmp_path.as_uri(), dim=16, nlist=2, pq_m=2, restarts=1)
    e.ingest(events(spark, [event(i) for i in range(300)]))
    (part,) = e.snapshot().parts
    files = [n for n, _ in e.store.files.list(part["path"]) if n.endswith(".parquet")]
    assert len(files) > 1 and part["rows"] == 300 and e.verify() == []
    assert len(ids(e.sql("SELECT event_id FROM events LIMIT 400", "t1").rows)) == 300


def test_deletes_by_table(spark, tmp_path):
    e = Engine.init(spark, (tmp_path / "a").as_uri(), dim=16, nlist=2, pq_m=2, restarts=1)
    e.ingest(events(spark, [event(i) for i in range(10)]))
    gone = spark.createDataFrame([("e00001",), ("e00002",), ("e00002",), (None,)], "event_id string")
    assert e.delete(["e00001"]) == 1 and e.delete(gone) == 1 and e.delete(gone) == 0
    count = lambda x: x.sql("SELECT count(*) FROM events", "t1").rows.first()[0]
    assert count(e) == 8
    e.backup((tmp_path / "b").as_uri())
    assert count(Engine(spark, (tmp_path / "b").as_uri())) == 8
    e.merge()
    assert count(e) == 8 and e.snapshot().data["tombstone_tables"] == []
    assert e.gc(keep=1, now_ms=int(time.time() * 1000) + 3 * 3_600_000)["parts"] and count(e) == 8


def test_query_grants(spark, tmp_path):
    e = Engine.init(spark, tmp_path.as_uri(), dim=16, nlist=2, pq_m=2, restarts=1)
    e.ingest(events(spark, [event(i) for i in range(5)]))
    e.policy(spark.createDataFrame([("t1", "hash-embedder", "query", 2), ("t2", "hash-embedder", "ingest", None)], "tenant_id string, model string, purpose string, budget long"))
    ask = lambda t: e.search(M.Query(text="body number", tenant=t)).rows.count()
    assert ask("t1") == 5 and ask("t1") == 5
    with pytest.raises(M.EngineError, match="spent"):
        ask("t1")
    assert e.search(M.Query(vector=tuple([1.0] + [0.0] * 15), tenant="t1", exact=True)).rows.count() == 5
    e.ingest(events(spark, [event(9, tenant="t2")]))
    for t in ("t2", None):
        with pytest.raises(M.EngineError, match="no grant"):
            ask(t)
    e.policy(None)
    assert ask("t2") == 1


def test_sums_hold_for_every_finite_cost(spark):
    rng = random.Random(8)
    groups = {
        "tiny": [1e-13, 2e-13], "huge": [1e300] * 7, "mixed": [rng.random() * 10.0 ** rng.randint(-320, 290) for _ in range(400)],
        "cents": [rng.randrange(10_000) / 100 for _ in range(3000)], "zero": [0.0, 0.0], "least": [5e-324] * 3
    }
    rows = [event(i, name=g, cost=c) for i, (g, c) in enumerate((g, c) for g, cs in groups.items() for c in cs)]
    plan = S.bind("SELECT event_name, sum(cost), avg(cost), count(cost) FROM events GROUP BY event_name", "t1")
    import math

    for parts in (1, 7):
        got = {r[0]: r[1:] for r in run_plan(plan, events(spark, rows).repartition(parts)).collect()}
        for g, cs in groups.items():
            want = math.fsum(cs)
            assert abs(got[g][0] - want) <= abs(want) * 3e-16 and got[g][2] == len(cs), g
            assert abs(got[g][1] - want / len(cs)) <= abs(want) * 3e-16
        first = got if parts == 1 else first
    assert first == got
    inf = run_plan(S.bind("SELECT sum(cost) FROM events", "t1"), events(spark, [event(0, cost=float("inf")), event(1)])).first()[0]
    assert inf == float("inf")


# analytics -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape,floor", [("balanced", 0.8), ("zipf", 0.6), ("overlap", 0.6)])
def test_clusters_recover_labels(spark, shape, floor):
    df = with_vectors(readers.cluster_corpus(spark, 800, shape), HashEmbedder(64))
    c = analytics.semantic_cluster(df.select("event_id", "vector", "cost", "error"), 8)
    joined = c.assigned.join(df.select("event_id", "event_name"), "event_id")
    assert analytics.adjusted_rand_index(joined, "cluster_id", "event_name") >= floor
    # k-means must serve the rows at least about as well as the true labels do; on the zipf shape it splits the largest class for less
    rows = df.select("event_name", "vector").collect()
    x, y = np.array([r.vector for r in rows], float), np.array([r.event_name for r in rows])
    true = sum(((x[y == k] - x[y == k].mean(0)) ** 2).sum() for k in set(y))
    assert c.assigned.agg(F.sum("dist")).first()[0] <= 1.03 * true
    s = c.summary.orderBy("cluster_id").collect()
    assert sum(r["count"] for r in s) == 800 and [r["count"] for r in s] == sorted((r["count"] for r in s), reverse=True)
    assert c.confidence == "ok"
    if shape == "balanced":
        again = analytics.semantic_cluster(df.repartition(7).select("event_id", "vector", "cost", "error"), 8)
        assert [tuple(r) for r in again.summary.orderBy("cluster_id").collect()] == [tuple(r) for r in s]
        few = analytics.semantic_cluster(df.select("event_id", "vector", "cost", "error"), 8, driver_rows=200)
        joined = few.assigned.join(df.select("event_id", "event_name"), "event_id")
        assert analytics.adjusted_rand_index(joined, "cluster_id", "event_name") >= floor
        two = analytics.semantic_cluster(df.repartition(3).select("event_id", "vector", "cost", "error"), 8, driver_rows=200)
        assert (few.centroids == two.centroids).all()


def test_cluster_edges(spark):
    noise = with_vectors(readers.cluster_corpus(spark, 300, "noise"), HashEmbedder(64)).select("event_id", "vector", "cost", "error")
    assert analytics.semantic_cluster(noise, 8).confidence == "low"
    assert analytics.semantic_cluster(noise.limit(0), 3).summary.count() == 0
    assert analytics.semantic_cluster(noise.limit(2), 5).summary.count() == 2
    for k in (0, 257):
        with pytest.raises(M.EngineError):
            analytics.semantic_cluster(noise, k)
    with pytest.raises(M.EngineError, match="budget"):
        analytics.semantic_cluster(noise, 3, state_budget=1000)


def test_novelty_drift_and_diff(spark, tmp_path):
    # 256 dimensions, so that the few words of the unseen classes do not share buckets with known ones
    e = Engine.init(spark, tmp_path.as_uri(), dim=256, nlist=8, pq_m=8, restarts=1)
    e.ingest(readers.cluster_corpus(spark, 600))
    with pytest.raises(M.EngineError, match="no baseline"):
        e.novelty_against("alpha")
    e.baseline_build("alpha")
    _, fires = e.novelty_against("alpha")
    assert not fires
    e.ingest(readers.cluster_corpus(spark, 0, novel=80).withColumn("event_id", F.concat(F.lit("new"), "event_id")))
    out, fires = e.novelty_against("alpha")
    novel = {r.event_id for r in out.filter("is_novel").collect()}
    assert fires and len([x for x in novel if x.startswith("new")]) >= 0.9 * 80 and len(novel) <= 80 + 20
    d = e.drift_check("alpha").collect()
    assert len(d) == 1 and d[0].rows == 680 and d[0].fires
    assert e.drift_check("nobody").count() == 0
    later = readers.cluster_corpus(spark, 400, seed=11).withColumns({"event_id": F.concat(F.lit("later"), "event_id"), "event_time": F.col("event_time") + 10_000_000_000})
    e.ingest(later)
    diff = e.semantic_diff("alpha", (0, 1_765_000_000_000), (1_765_000_000_000, 1_780_000_000_000), 12).collect()
    assert diff and all(r.exemplar.startswith("new") for r in diff) and sum(r["count"] for r in diff) >= 70
    assert e.baselines_refresh() == {"alpha": "ok"}
    c = e.semantic_cluster("alpha", 4, Cmp("=", Col("event_name"), Lit("c1")))
    assert sum(r["count"] for r in c.summary.collect()) == 125


def test_baseline_states(spark, tmp_path):
    class Two(HashEmbedder):
        model_id = "two"

    e = Engine.init(spark, tmp_path.as_uri(), dim=64, nlist=2, pq_m=2, restarts=1)
    rows = readers.cluster_corpus(spark, 300)
    e.ingest(rows.filter("event_id < 'e'") if rows.filter("event_id < 'e'").count() else rows)
    e.baseline_build("alpha")
    old = e.snapshot().active
    first = e._baselines(e.snapshot(), "alpha")[old]
    assert e.baselines_refresh() == {"alpha": "ok"} and e._baselines(e.snapshot(), "alpha")[old] == first
    late = 3_000_000_000_000
    e.ingest(rows.withColumns({"event_id": F.concat(F.lit("late"), "event_id"), "event_time": F.col("event_time") + late}))
    assert e.redact_bodies(late, "retention") > 0
    e.bridge_declare("hash-embedder:1", "two:1", "checked")
    g = e.generation_create(Two(64))
    e.generation_promote(g)
    assert e.generation_migrate(g) > 0
    # what is redacted cannot follow, so the new generation is not watched, and says so; the old one still is
    assert e.baselines_refresh() == {"alpha": "degraded"}
    states = {k: (b.state, b.reason) for k, b in e._baselines(e.snapshot(), "alpha").items()}
    assert states[old] == ("ok", "") and states[g][0] == "degraded" and "redacted" in states[g][1]
    d = {r.generation: r for r in e.drift_check("alpha").collect()}
    assert (d[old].status, d[g].status, d[g].novel, d[g].fires) == ("ok", "degraded", None, None) and d[g].rows == 300
    with pytest.raises(M.EngineError, match="degraded"):
        e.novelty_against("alpha")


def test_order_statistic(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=500), rng.normal(size=100) * 1e-300, [0.0, -0.0, 1e300, -1e300], np.repeat(0.25, 50)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(5)
    s = np.sort(x)
    for rank in (0, 1, 160, 333, len(x) - 2, len(x) - 1):
        assert analytics.order_statistic(df, "v", rank) == s[rank]


def test_baseline_is_fitted_to_all_rows(spark):
    rng = np.random.default_rng(4)
    means = np.eye(16)
    x = means[np.arange(640) % 16] + rng.normal(0, 0.1, (640, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(f"e{i:04d}", v.tolist()) for i, v in enumerate(x)], "event_id string, vector array<float>")
    b = analytics.build_baseline(df, "t", "g", sample=100)
    c = np.array(b.centroids)
    near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    # each centroid is the mean of all rows nearest to it, not of those in the sample
    assert all(np.abs(c[j] - x[near == j].mean(0)).max() < 1e-5 for j in np.unique(near)) and b.rows == 640


# ingest ----------------------------------------------------------------------------------------------------------------

NOW = 1_760_000_100_000


def test_admission_order_and_reasons(spark):
    big = {f"k{i}": i for i in range(65)}
    rows = [
        event(0), event(1, tenant=""), event(2, cost=float("nan")), event(3, body=" \t\n"), event(4, body="x" * ((1 << 20) + 1)), event(5, attributes=big), event(6, attributes={"k" * 129: 1}),
        event(7, attributes={"k": "v" * 4097}), event(
            8, attributes={f"k{i}": "v" * 4000 for i in range(5)}
        ), event(9, at=NOW - 8 * 86_400_000), event(10, at=NOW + 3_600_001), event(11, name="n" * 257),
        event(12, key="a"), event(13, key="a", body="other"), event(0), event(14, at=NOW - 7 * 86_400_000), event(15, at=NOW + 3_600_000),
    ]
    df = events(spark, rows).withColumn("seq", F.monotonically_increasing_id())
    got = [(r.event_id, r.reason) for r in ingest.admit(df.coalesce(1), NOW).orderBy("seq").collect()]
    want = [
        None, "missing_tenant_id", "invalid_cost", "empty_body", "body_too_large", "too_many_attribute_keys", "attribute_key_too_long",
        "attribute_value_too_long", "attributes_too_large", "event_time_too_late", "event_time_in_future", "invalid_identifier", None, "idempotency_conflict",
        "replay", None, None
    ]
    assert [r for _, r in got] == want


def test_quota_is_greedy_and_windows_restart(spark):
    rows = [(f"e{i}", "t", "x" * (60 if i == 1 else 10), int(i // 4 * 1000), i) for i in range(8)]
    df = spark.createDataFrame(rows, "event_id string, tenant_id string, body string, arrival_ms long, seq long")
    got = {r.event_id: r.over_quota for r in ingest.quota(df, events=3, size=50).collect()}
    assert got == {"e0": False, "e1": True, "e2": False, "e3": False, "e4": False, "e5": False, "e6": False, "e7": True}


def test_key_dictionary(spark):
    df = events(spark, [event(i, attributes={f"k{i}": 1, f"m{i}": 1}) for i in range(4)]).withColumn("seq", F.col("event_id"))
    over = {r.event_id: r.over_dictionary for r in ingest.key_dictionary(df, ["k0", "m0"], ["seq"], limit=6).collect()}
    assert over == {"e00000": False, "e00001": False, "e00002": False, "e00003": True}


def test_fair_order_and_sample(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5), ("c", 6)], "tenant_id string, seq int")
    assert [r.seq for r in ingest.fair_order(df).collect()] == [1, 4, 5, 2, 6, 3]
    rows = spark.createDataFrame([(f"e{i}", "big" if i < 900 else f"s{i % 5}") for i in range(1000)], "event_id string, tenant_id string")
    got = ingest.stratified_sample(rows, 100, 1)
    counts = {r[0]: r[1] for r in got.groupBy("tenant_id").count().collect()}
    assert sum(counts.values()) == 100 and min(counts.values()) >= 4
    assert ids(got.orderBy("event_id")) == ids(ingest.stratified_sample(rows.repartition(5), 100, 1).orderBy("event_id"))
    assert ingest.stratified_sample(rows, 5000, 1).count() == 1000


def test_batches_dead_letters_and_replay_across_batches(spark, tmp_path):
    e = Engine.init(spark, tmp_path.as_uri(), dim=16, nlist=2, pq_m=2, restarts=1)
    one = [event(0), event(1, cost=-1.0), event(2, body="!!!")]
    assert e.admit_and_ingest(events(spark, one), NOW) == {"admitted": 1, "invalid_cost": 1, "embedding_failed": 1}
    assert e.admit_and_ingest(events(spark, [event(0), event(0, body="changed"), event(5)]), NOW + 10) == {"admitted": 1, "replay": 1, "idempotency_conflict": 1}
    assert e.sql("SELECT count(*) FROM events", "t1").rows.first()[0] == 2
    dead = spark.read.json(f"{tmp_path.as_uri()}/dead_letters")
    assert sorted(r.reason for r in dead.collect()) == ["embedding_failed", "idempotency_conflict", "invalid_cost"]


def test_grants_install_and_backup(spark, tmp_path):
    e = Engine.init(spark, (tmp_path / "a").as_uri(), dim=16, nlist=2, pq_m=2, restarts=1)
    rng = np.random.default_rng(0)
    book = train(rng.normal(size=(50, 16)).astype(np.float32), 2, 2, 1)
    g = e.install_generation(e.embedder, book)
    at = e.snapshot().id
    assert e.install_generation(e.embedder, book) == g == e.snapshot().active and e.snapshot().id == at
    grants = spark.createDataFrame([("t1", "hash-embedder", "ingest", 2), ("t2", "other", "ingest", None)], "tenant_id string, model string, purpose string, budget long")
    rows = [event(i) for i in range(3)] + [event(9, tenant="t2")]
    assert e.admit_and_ingest(events(spark, rows), NOW, grants=grants) == {"admitted": 2, "model_policy_denied": 2}
    assert e.backup((tmp_path / "b").as_uri()) == 1
    other = Engine(spark, (tmp_path / "b").as_uri())
    assert other.verify() == [] and ids(other.search(M.Query(text="body number")).rows) == ids(e.search(M.Query(text="body number")).rows)


def test_stream_of_json_lines_is_ingested_once(spark, tmp_path):
    e = Engine.init(spark, (tmp_path / "store").as_uri(), dim=16, nlist=2, pq_m=2, restarts=1)
    source = tmp_path / "in"
    source.mkdir()
    line = '{{"event_id":"e{0}","tenant_id":"t1","event_time":%d,"event_name":"n","cost":0.5,"error":false,"body":"hello {0}","attributes":{{"k":{{"type":"int","value":"{0}"}}}}}}\n' % NOW
    (source / "a.jsonl").write_text("".join(line.format(i) for i in range(5)) + "\n")
    go = lambda: stream_into(e, readers.stream_jsonl(spark, str(source)), str(tmp_path / "ck"), NOW).awaitTermination()
    go()
    (source / "b.jsonl").write_text("".join(line.format(i) for i in range(3, 8)))
    go()
    go()
    assert e.sql("SELECT count(*) FROM events WHERE attributes['k'] >= 0", "t1").rows.first()[0] == 8


# readers ---------------------------------------------------------------------------------------------------------------


def test_tsv(spark, tmp_path):
    rows = [event(0, body="a\tb\nc\\n\r"), event(1, body="\\t plain", error=True, cost=0.25)]
    readers.write_tsv(events(spark, rows), str(tmp_path / "x"))
    back = readers.read_tsv(spark, str(tmp_path / "x")).orderBy("event_id").collect()
    assert [(r.event_id, r.body, r.error, r.cost, r.observed_time) for r in back] == [(r[0], r[7], r[6], r[5], r[2]) for r in rows]
    head = "event_id\ttenant_id\tevent_time\tevent_name\tcost\terror\tbody"
    ok = spark.createDataFrame([(head,), ("",), ("e\tt\t1\tn\t0\tTRUE\tb",)], "value string")
    assert readers.parse_tsv(ok).count() == 1
    for bad in ("e\tt\tx\tn\t0\t1\tb", "e\tt\t1\tn\t0\tmaybe\tb", "e\tt\t1\tn\tzz\t1\tb", "e\tt\t1"):
        with pytest.raises(Exception, match="bad"):
            readers.parse_tsv(spark.createDataFrame([(bad,)], "value string")).collect()


def test_bad_json_line_raises(spark):
    with pytest.raises(Exception):
        readers.parse_jsonl(spark.createDataFrame([("{nope",)], "value string")).collect()


OTLP = """{"resourceSpans":[{"resource":{"attributes":[{"key":"service.namespace","value":{"stringValue":"acme"}}]},"scopeSpans":[{"spans":[
{"traceId":"t","spanId":"s1","name":"chat","startTimeUnixNano":"1700000000123456789","status":{"code":2},"attributes":[{"key":"gen_ai.prompt","value":{"stringValue":" hi "}},{"key":"gen_ai.completion","value":{"stringValue":"yo"}},{"key":"n","value":{"intValue":7}},{"key":"m","value":{"intValue":"8"}},{"key":"d","value":{"doubleValue":0.5}},{"key":"b","value":{"boolValue":true}},{"key":"l","value":{"arrayValue":{"values":[]}}},{"key":"n","value":{"intValue":9}}]},
{"spanId":"s2","name":"other","attributes":[{"key":"x","value":{"stringValue":"y"}}]},
{"spanId":"s3","name":"chat","attributes":[{"key":"gen_ai.completion","value":{"stringValue":"only"}}]}]}]}]}"""


def test_otlp(spark):
    got = {r.event_id: r for r in readers.parse_otlp(spark.createDataFrame([(OTLP,)], "value string"), "fallback", 42).collect()}
    assert set(got) == {"s1", "s3"}
    a = got["s1"]
    assert (a.tenant_id, a.event_time, a.error, a.body, a.idempotency_key) == ("acme", 1_700_000_000_123, True, "hi \nyo", "s1")
    values = {k: (v.tag, v.s, v.i, v.d, v.b) for k, v in a.attributes.items()}
    assert values == {"n": attribute(9), "m": attribute(8), "d": attribute(0.5), "b": attribute(True)}
    assert got["s3"].event_time == 42 and got["s3"].body == "only" and not got["s3"].error
    bad = OTLP.replace('"spanId":"s3",', "")
    with pytest.raises(Exception, match="without spanId"):
        readers.parse_otlp(spark.createDataFrame([(bad,)], "value string"), "f", 1).collect()


def test_corpora(spark):
    assert readers.corpus(spark, 30, "duplicates").select("event_id").distinct().count() == 20
    skew = readers.corpus(spark, 200, "tenant-skew").groupBy("tenant_id").count().orderBy(F.desc("count")).first()
    assert skew.tenant_id == "acme" and skew["count"] > 150
    assert readers.corpus(spark, 4, "edge").filter(F.length("body") > 1 << 20).count() == 1
    assert random.Random(1).random() and readers.corpus(spark, 5).collect() == readers.corpus(spark, 5).collect()


# size --------------------------------------------------------------------------------------------------------------------


def test_large_answers_stay_in_the_cluster(spark, store, monkeypatch):
    q = M.Query(text="refund payment", tenant="t1", nprobe=8, k=40, candidates=60, rerank=60)
    want = [(r.event_id, r.score) for r in store.search(q).rows.collect()]
    bounded = M.Query(text="refund payment", tenant="t1", threshold=-1.0, k=10_000, nprobe=8)
    whole = ids(store.search(bounded).rows)
    assert whole == ids(store.exact_search(bounded).rows) and len(whole) > 60
    monkeypatch.setattr(search, "HELD_ROWS", 5)
    monkeypatch.setattr(search, "by_code", None)  # the driver takes no candidates
    assert [(r.event_id, r.score) for r in store.search(q).rows.collect()] == want
    assert ids(store.search(bounded).rows) == whole


@pytest.mark.parametrize("n", [1, 7, 100, 150, 299, 300, 400])
def test_best_cuts_among_ties(spark, monkeypatch, n):
    rows = [(f"e{i:04d}", float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id string, score double").repartition(7)
    monkeypatch.setattr(search, "HELD_ROWS", 0)
    for down in (True, False):
        want = sorted(rows, key=lambda r: (-r[1] if down else r[1], r[0]))[:n]
        assert [tuple(r) for r in search.best(df, n, "score", down).collect()] == want


def test_nearest_by_blocks_is_what_all_distances_give():
    rng = np.random.default_rng(3)
    for n, k in ((0, 4), (1, 1), (1000, 256)):
        x, c = rng.normal(size=(n, 8)).astype(np.float32), rng.normal(size=(k, 8)).astype(np.float32)
        near, served = nearest_of(x, c)
        d = distances(x, c)
        assert (near == d.argmin(1)).all() and np.allclose(served, d.min(1))
        assert np.allclose(sums_by(near, x, k)[near], np.array([x[near == j].astype(float).sum(0) for j in range(k)])[near])


def test_rows_are_shuffled_once_by_file(spark, tmp_path, monkeypatch):
    from semevra.sources import store as stores

    monkeypatch.setattr(stores, "PART_FILE_ROWS", 40)
    e = Engine.init(spark, tmp_path.as_uri(), dim=16, nlist=2, pq_m=2, restarts=1)
    rows = [event(i) for i in range(300)]
    e.ingest(events(spark, rows))
    e.ingest(events(spark, rows[:100]).withColumn("cost", F.col("cost") + 1))
    e.delete(spark.createDataFrame([("e00001",), ("e00150",)], "event_id string"))
    e.delete(["e00002"])
    placed = e.store._placed(e.store.partitioned(e.store.read(e.snapshot().parts)))
    sizes = [r.n for r in placed.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("_place").alias("n")).collect()]
    assert len(sizes) >= 8 and set(sizes) == {1}
    e.merge()
    got = {r.event_id: r.cost for r in e.store.read(e.snapshot().parts, e.snapshot()).collect()}
    assert len(got) == 297 and not got.keys() & {"e00001", "e00002", "e00150"} and e.verify() == []
    files = len(spark.read.parquet(*[f"{tmp_path.as_uri()}/{p['path']}" for p in e.snapshot().parts]).inputFiles())
    assert files >= 7
    writes = []
    placed = stores.Store._placed
    monkeypatch.setattr(stores.Store, "_placed", lambda *a: writes.append(1) or placed(*a))
    assert e.redact_bodies(2**60, "retention") == 1 and not writes and e.verify() == []
    assert {r.body for r in e.store.read(e.snapshot().parts).collect()} == {""}


def test_sample_sorts_only_low_tickets(spark):
    rows = spark.range(40_000).select(F.concat(F.lit("e"), "id").alias("event_id"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("tenant_id"))
    got = ingest.stratified_sample(rows, 90, 5)
    import hashlib

    want = set()
    for t in range(3):
        ticket = sorted((hashlib.sha256(f"5|e{i}".encode()).hexdigest(), f"e{i}") for i in range(40_000) if i % 3 == t)
        want |= {i for _, i in ticket[:30]}
    assert set(ids(got)) == want
    same = rows.withColumn("event_id", F.lit("e1"))  # one ticket for all rows
    assert ingest.stratified_sample(same, 90, 5).count() == 90


def test_texts_embedded_together_are_as_one_by_one(monkeypatch):
    from semevra.functions import embed

    texts = ["Refund failed refund", None, "", " ?! ", "é_ß İstanbul x" * 40, "a", "b", "x" * 40_000, "word " * 9000, "é" * 20_000 + " end", "refund failed"]
    monkeypatch.setattr(embed, "GROUP_CHARS", 100)
    for dim in (64, 48):
        e = HashEmbedder(dim)
        together, one = e.embed_many(texts), [e._one(t) for t in texts]
        assert [x is None for x in together] == [x is None for x in one]
        assert all((x == y).all() for x, y in zip(together, one) if x is not None)

    def never(self, feature):
        raise AssertionError("a feature was hashed by itself")

    monkeypatch.setattr(embed._Codes, "__missing__", never)
    assert len([v for v in HashEmbedder(64).embed_many(texts) if v is not None]) == 8
