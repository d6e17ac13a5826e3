"""The engine's operators as queries over the driver's tables, each with its SQL where SQL can express it.

Tables map onto the data model thus: event ids are padded (ids order as bytes), users fall into five tenants, and each event
takes the embedding whose number is its own modulo their count, so rankings have ties for the id order to settle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semevra import model as M
from semevra.engine import Engine, run_plan
from semevra.functions.codebook import train
from semevra.functions.embed import SIGN_SEED, HashEmbedder, with_vectors
from semevra.functions.half import halves
from semevra.functions.hashing import day_window, tenant_bucket
from semevra.functions.vectors import dot, l2, nearest
from semevra.operators import analytics, ingest, search
from semevra.operators.maintenance import dedup
from semevra.plans import sql as S
from semevra.plans.predicate import compile_predicate, time_bounds
from semevra.session import materialise, scratch
from semevra.sources import readers
from semevra.sources.store import encode

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(letter: str, number: str) -> Column:
    """``letter`` and the number of at least 8 digits; a longer one keeps all its digits, which lpad alone would cut."""
    n = F.col(number).cast("string")
    return F.concat(F.lit(letter), F.lpad(n, F.greatest(F.lit(8), F.length(n)), F.lit("0")))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events in the engine's data model."""
    local = "ts" if spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC") else "convert_timezone('UTC', current_timezone(), ts)"
    k = F.get_json_object("props", "$.k").try_cast("long")
    value = F.struct(
        F.lit(M.INT).cast("byte").alias("tag"), F.lit(None).cast("string").alias("s"), k.alias("i"), F.lit(None).cast("double").alias("d"),
        F.lit(None).cast("boolean").alias("b")
    )
    ms = F.expr(f"unix_millis(cast({local} as timestamp))")
    return table(spark, sf_dir, "events").select(
        padded("e", "event_id").alias("event_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        ms.alias("event_time"), ms.alias("observed_time"),
        F.col("event_type").alias("event_name"), F.col("value").alias("cost"), (F.col("event_type") == "error").alias("error"),
        F.concat_ws(" ", "event_type", "props").alias("body"), F.lit("").alias("trace_id"), F.lit("").alias("span_id"),
        F.when(k.isNotNull(), F.create_map(F.lit("k"), value)).otherwise(F.create_map().cast(M.EVENT["attributes"].dataType)).alias("attributes"),
        F.lit(None).cast("string").alias("idempotency_key"), F.col("event_id").alias("number"),
    )


def with_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with vector and label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return canonical(spark, sf_dir).join(e, F.col("number") % F.lit(e.count()) == F.col("vec_id")).drop("vec_id")


def query_vector(spark: SparkSession, sf_dir: str, number: int = 3) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == number).first().embedding]


EV = """WITH ev AS (
  SELECT printf('e%08d', event_id) AS event_id, 't' || CAST(user_id % 5 AS VARCHAR) AS tenant_id,
         CAST(epoch_us(ts) // 1000 AS BIGINT) AS event_time, CAST(epoch_us(ts) // 1000 AS BIGINT) AS observed_time, event_type AS event_name,
         value AS cost, event_type = 'error' AS error, event_type || ' ' || props AS body, '' AS trace_id, '' AS span_id,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id AS number FROM events)"""
VEC = (
    EV
    + """, vec AS (SELECT ev.*, e.embedding::DOUBLE[] AS vector, e.label FROM ev JOIN embeddings e ON ev.number % (SELECT count(*) FROM embeddings) = e.vec_id),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3),
sc AS (SELECT vec.*, round(greatest(-1.0, least(1.0, list_dot_product(vec.vector, q.v))), 6) AS score FROM vec, q)"""
)
STAR = "event_id, tenant_id, event_time, observed_time, event_name, cost, error, body, trace_id, span_id"


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def _sql(name: str, text: str, oracle: str, tenant: str = "t1") -> None:
    """A statement of the SQL front end, without a LIMIT of its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = S.bind(text, tenant)
        df = run_plan(plan, canonical(spark, sf_dir))
        doubles = [c for c, t in df.dtypes if t == "double"]
        return df.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in doubles}) if doubles else df

    register(name, oracle)(run)


def _rows(name: str, columns: str, where: str, oracle_where: str, oracle_columns: str | None = None) -> None:
    text = f"SELECT {columns} FROM events WHERE {where}" if where else f"SELECT {columns} FROM events"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = S.bind(text, "t1")
        rows = canonical(spark, sf_dir).filter(F.col("tenant_id") == plan.tenant)
        if plan.predicate is not None:
            rows = rows.filter(compile_predicate(plan.predicate))
        from semevra.engine import project

        return project(plan, rows.withColumn("score", F.lit(0.0)))

    register(name, f"{EV} SELECT {oracle_columns or columns} FROM ev WHERE tenant_id = 't1' AND ({oracle_where})")(run)


_rows("scan_project_star", "*", "", "TRUE", STAR)
_rows("scan_project_cols", "event_id, cost, error", "", "TRUE")
_rows("attr_project", "event_id, attributes['k']", "", "TRUE", "event_id, CAST(k AS VARCHAR) AS \"attributes[k]\"")
_rows(
    "filter_cmp_matrix", "event_id, cost", "cost >= 10 AND cost < 50.5 AND event_name <> 'click' AND 'purchase' = event_name OR cost > 'x'",
    "cost >= 10 AND cost < 50.5 AND event_name <> 'click' AND event_name = 'purchase'"
)
_rows("filter_in", "event_id, event_name", "event_name IN ('click', 'view', 3) AND attributes['k'] IN (1, 2, 3, 'x')", "event_name IN ('click', 'view') AND k IN (1, 2, 3)")
_rows("filter_not_null", "event_id", "NOT attributes['absent'] = 'x' OR NOT (cost > 20)", "NOT (cost > 20)")
_rows("filter_bool", "event_id, error", "error AND NOT FALSE", "error")
_rows("filter_attr", "event_id, attributes['k']", "attributes['k'] >= 50 AND attributes['k'] <> 60", "k >= 50 AND k <> 60", "event_id, CAST(k AS VARCHAR) AS \"attributes[k]\"")
_rows("tenant_policy_or_escape", "event_id, tenant_id", "tenant_id = 't2' OR cost >= 0", "tenant_id = 't2' OR cost >= 0")


def _window(name: str, where: str, oracle_where: str) -> None:
    """Rows within the bounds of event_time that the predicate implies, and by nothing else of it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = S.bind(f"SELECT event_id, event_time FROM events WHERE {where}", "t1")
        lo, hi = time_bounds(plan.predicate)
        return canonical(spark, sf_dir).filter((F.col("tenant_id") == plan.tenant) & F.col("event_time").between(lo, hi)).select("event_id", "event_time")

    register(name, f"{EV} SELECT event_id, event_time FROM ev WHERE tenant_id = 't1' AND ({oracle_where})")(run)


_window(
    "time_window_inclusive", "event_time >= 1704153600000 AND event_time <= 1704672000000 AND (event_time < 0 OR cost >= 0)",
    "event_time BETWEEN 1704153600000 AND 1704672000000"
)
_window(
    "time_window_exclusive", "cost < 0 AND event_time > 1704153600000 AND event_time < 1704672000000 AND event_time <= 1804672000000",
    "event_time > 1704153600000 AND event_time < 1704672000000"
)
_rows("semantic_precedence", "event_id", "error OR cost < 5 AND event_name = 'click'", "error OR (cost < 5 AND event_name = 'click')")

_sql("agg_count", "SELECT count(*) FROM events WHERE cost > 10", EV + " SELECT count(*) AS \"count(*)\" FROM ev WHERE tenant_id = 't1' AND cost > 10")
_sql(
    "agg_count_empty", "SELECT count(*), count(cost) FROM events WHERE cost < 0",
    EV + " SELECT count(*) AS \"count(*)\", count(cost) AS \"count(cost)\" FROM ev WHERE tenant_id = 't1' AND cost < 0"
)
_sql(
    "agg_sum_avg_min_max",
    "SELECT sum(cost), avg(cost), min(cost), max(cost), min(event_time), max(event_name) FROM events",
    EV + ' SELECT round(sum(cost), 6) AS "sum(cost)", round(avg(cost), 6) AS "avg(cost)", min(cost) AS "min(cost)", max(cost) AS "max(cost)", CAST(min(event_time) AS DOUBLE) AS "min(event_time)", CAST(NULL AS DOUBLE) AS "max(event_name)" FROM ev WHERE tenant_id = \'t1\'',
)
_COSTS = ["1e-13", "2e-13", "1e27", "1e300", "0.1", "123456789.123"]


@register("agg_sum_wide", EV + ", w AS (SELECT event_name, (ARRAY[" + ", ".join(_COSTS) + """])[1 + number % 6]::DOUBLE AS cost, number % 6 AS c FROM ev WHERE tenant_id = 't1')
SELECT event_name || c AS event_name, count(*) AS n, fsum(cost) / any_value(cost) AS sum_in_units, max(cost) AS most FROM w GROUP BY ALL""")
def agg_sum_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of costs from 1e-13 to 1e300; each group's sum is given in units of its cost."""
    ev = canonical(spark, sf_dir)
    c = F.pmod("number", F.lit(6)).cast("int")
    ev = ev.withColumns({"cost": F.array(*[F.lit(float(x)) for x in _COSTS])[c], "event_name": F.concat("event_name", c.cast("string"))})
    df = run_plan(S.bind("SELECT event_name, count(*), sum(cost), max(cost) FROM events GROUP BY event_name", "t1"), ev)
    df = df.toDF("event_name", "n", "total", "most")
    return df.select("event_name", "n", (F.col("total") / F.col("most")).alias("sum_in_units"), "most")


_sql(
    "agg_sum_empty_zero", "SELECT sum(cost), avg(cost) FROM events WHERE cost < 0",
    EV + ' SELECT coalesce(sum(cost), 0.0) AS "sum(cost)", avg(cost) AS "avg(cost)" FROM ev WHERE tenant_id = \'t1\' AND cost < 0'
)
_sql(
    "group_by_one", "SELECT event_name, count(*), sum(cost) FROM events GROUP BY event_name",
    EV + ' SELECT event_name, count(*) AS "count(*)", round(sum(cost), 6) AS "sum(cost)" FROM ev WHERE tenant_id = \'t1\' GROUP BY event_name'
)
_sql(
    "agg_beside_key", "SELECT body, event_name, count(*) FROM events GROUP BY event_name LIMIT 1",
    EV + " SELECT CAST(NULL AS VARCHAR) AS body, event_name, count(*) AS \"count(*)\" FROM ev WHERE tenant_id = 't1' GROUP BY event_name"
)
_sql(
    "group_by_two",
    "SELECT error, event_name, count(*), avg(cost), max(cost) FROM events GROUP BY event_name, error",
    EV + ' SELECT CAST(error AS VARCHAR) AS error, event_name, count(*) AS "count(*)", round(avg(cost), 6) AS "avg(cost)", max(cost) AS "max(cost)" FROM ev WHERE tenant_id = \'t1\' GROUP BY event_name, error',
)


# Semantic search -------------------------------------------------------------------------------------------------------

TOP = "SELECT event_id, score FROM {} ORDER BY score DESC, event_id LIMIT {}"


@register(
    "topk_exact",
    "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3), sc AS (SELECT printf('v%08d', vec_id) AS event_id, round(greatest(-1.0, least(1.0, list_dot_product(embedding::DOUBLE[], q.v))), 6) AS score FROM embeddings, q) " + TOP.format("sc", 10)
)
def topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings."""
    e = table(spark, sf_dir, "embeddings").select(padded("v", "vec_id").alias("event_id"), F.col("embedding").alias("vector"))
    return search.exact_topk(e, query_vector(spark, sf_dir), 10, digits=6).select("event_id", "score")


_STEP = "pow(2.0, greatest(floor(log2(abs(x))), -14) - 10)"


@register(
    "half_scores",
    f"""WITH h AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / {_STEP}, 0) * {_STEP} END) AS v FROM embeddings)
SELECT printf('v%08d', h.vec_id) AS event_id,
       round(greatest(-1.0, least(1.0, list_dot_product(h.v, q.embedding::DOUBLE[]))), 6) AS score FROM h, (SELECT embedding FROM embeddings WHERE vec_id = 3) q""",
)
def half_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine of every embedding, as half floats hold it, with the query."""
    e = table(spark, sf_dir, "embeddings").select(padded("v", "vec_id").alias("event_id"), halves(F.col("embedding")).alias("vector"))
    return search.scored(e, query_vector(spark, sf_dir), digits=6).select("event_id", "score")


class TableEmbedder(HashEmbedder):
    """Embeds the text 'vector N' as the embedding N, as far as it is given."""

    model_id = "table"

    def __init__(self, vectors: dict[str, list[float]]) -> None:
        super().__init__(len(next(iter(vectors.values()))))
        self.vectors = vectors

    def embed(self, text: str) -> np.ndarray:
        return np.array(self.vectors[text], np.float32)


_STORES: dict[tuple[str, str], tuple[Engine, int, int]] = {}


def whole_of(e: Engine, number: int) -> dict[str, int]:
    """Options that read all lists and rerank all rows of a snapshot, however many, so that the answer is the exact one."""
    n = max(1, sum(p["rows"] for p in e.snapshot(number).parts))
    return {"nprobe": 32, "candidates": n, "rerank": n}


def with_all(e: Engine, number: int) -> str:
    """``whole_of`` as a clause of a statement."""
    return "WITH (" + ", ".join(f"{k} = {v}" for k, v in whole_of(e, number).items()) + ")"


def store(spark: SparkSession, sf_dir: str) -> tuple[Engine, int, int]:
    """An engine whose store holds the events with their embeddings, and two of its snapshots: one with all events, one in which
    the signups are deleted. It is made once a session and table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        e = Engine.init(spark, scratch(spark), TableEmbedder({"vector 3": query_vector(spark, sf_dir)}), window_ms=30 * M.DAY_MS, restarts=2)
        df = with_embeddings(spark, sf_dir)
        whole = e.ingest(df).id
        e.delete(canonical(spark, sf_dir).filter("event_name = 'signup'").select("event_id"))
        _STORES[key] = e, whole, e.snapshot().id
    return _STORES[key]


def _search(spark: SparkSession, sf_dir: str, deleted: bool = False, where: str = "", **options) -> DataFrame:
    """Rows of a search of the store for the embedding 3, scores rounded."""
    e, whole, less = store(spark, sf_dir)
    plan = S.bind(f"SELECT event_id FROM events {where}", "t1")
    number = less if deleted else whole
    every = whole_of(e, number)
    if options.get("k", 0) is None:  # all rows that qualify
        options["k"] = every["rerank"]
    query = M.Query(text="vector 3", predicate=plan.predicate, **({"tenant": "t1", "k": 10} | every | options))
    return e.search(query, e.snapshot(number)).rows.withColumn("score", F.round("score", 6))


@register(
    "topk_hybrid",
    VEC + " SELECT event_id, score, cost FROM sc WHERE tenant_id = 't1' AND cost > 20 AND event_name IN ('purchase', 'view') ORDER BY score DESC, event_id LIMIT 10"
)
def topk_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship, by the store: tenant and scalar predicate, code distances of the probed lists, exact reranking, top ten."""
    return _search(spark, sf_dir, where="WHERE cost > 20 AND event_name IN ('purchase', 'view')").select("event_id", "score", "cost")


@register("topk_ties", VEC + " " + TOP.format("sc", 50))
def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty nearest events of all tenants; equal scores go by id."""
    return search.exact_topk(with_embeddings(spark, sf_dir), query_vector(spark, sf_dir), 50, digits=6).select("event_id", "score")


@register("topk_threshold", VEC + " SELECT event_id, score FROM sc WHERE score >= 0.2 AND tenant_id = 't1'")
def topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a tenant at a similarity of 0.2 or more, exactly scored, however many."""
    return _search(spark, sf_dir, threshold=0.2, k=None).select("event_id", "score")


@register(
    "page_two_keyset",
    VEC + ", t AS (SELECT * FROM sc WHERE tenant_id = 't1'), one AS (SELECT score, event_id FROM t ORDER BY score DESC, event_id LIMIT 10), last AS (SELECT score, event_id FROM one ORDER BY score, event_id DESC LIMIT 1) SELECT t.event_id, t.score FROM t, last WHERE t.score < last.score OR (t.score = last.score AND t.event_id > last.event_id) ORDER BY t.score DESC, t.event_id LIMIT 10"
)
def page_two_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten of a semantic statement, by the cursor that came with the first."""
    e, whole, _ = store(spark, sf_dir)
    text = f"SELECT event_id, score FROM events WHERE embedding ~~ 'vector 3' LIMIT 10 {with_all(e, whole)}"
    plan = S.bind(text, "t1")
    start = search.make_cursor(whole, plan.fingerprint, 2.0, "")  # before the first row of that snapshot
    return e.sql(text, "t1", e.sql(text, "t1", start).next_cursor).rows.withColumn("score", F.round("score", 6))


@register("tombstone_search", VEC + " SELECT event_id, score FROM sc WHERE tenant_id = 't1' AND NOT (event_name = 'signup') ORDER BY score DESC, event_id LIMIT 10")
def tombstone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted events (here the signups) never take a place in the top ten."""
    return _search(spark, sf_dir, deleted=True).select("event_id", "score")


@register(
    "agg_over_semantic",
    VEC + " SELECT event_name, count(*) AS n, round(avg(cost), 6) AS avg_cost, max(score) AS best FROM sc WHERE tenant_id = 't1' AND cost > 20 GROUP BY event_name"
)
def agg_over_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of the survivors of a semantic predicate; here all rows of the scalar predicate survive."""
    e, whole, _ = store(spark, sf_dir)
    plan = S.bind(f"SELECT event_name, count(*), avg(cost), max(score) FROM events WHERE embedding ~~ 'vector 3' AND cost > 20 GROUP BY event_name {with_all(e, whole)}", "t1")
    df = e.run(plan, e.snapshot(whole)).rows.toDF("event_name", "n", "avg_cost", "best")
    return df.withColumns({"avg_cost": F.round("avg_cost", 6), "best": F.round("best", 6)})


@register("alias_and_order", VEC + " SELECT event_id, score FROM sc WHERE tenant_id = 't1' AND error ORDER BY score DESC, event_id LIMIT 7")
def alias_and_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semantic statement with aliases (which name nothing anew), the one order there is, and options."""
    e, whole, _ = store(spark, sf_dir)
    plan = S.bind(f"SELECT event_id AS x, score AS y FROM events WHERE embedding ~~ 'vector 3' AND error ORDER BY score DESC, event_id ASC LIMIT 7 {with_all(e, whole)}", "t1")
    return e.run(plan, e.snapshot(whole)).rows.withColumn("score", F.round("score", 6))


@register(
    "snapshot_scan",
    EV + " SELECT event_id, cost, 'whole' AS at FROM ev WHERE tenant_id = 't1' AND event_time > 1705276800000 AND cost > 20 UNION ALL SELECT event_id, cost, 'less' FROM ev WHERE tenant_id = 't1' AND event_time > 1705276800000 AND cost > 20 AND event_name <> 'signup'"
)
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan of each of two pinned snapshots, parts pruned by tenant and time, deleted rows left out where they are."""
    e, whole, less = store(spark, sf_dir)
    plan = S.bind("SELECT event_id, cost FROM events WHERE event_time > 1705276800000 AND cost > 20 LIMIT 1000000000", "t1")
    lo, hi = time_bounds(plan.predicate)
    out = []
    for number, at in ((whole, "whole"), (less, "less")):
        snap = e.snapshot(number)
        rows = e.store.read(e.store.prune(snap, plan.tenant, lo, hi), snap).filter((F.col("tenant_id") == plan.tenant) & compile_predicate(plan.predicate))
        out.append(rows.select("event_id", "cost", F.lit(at).alias("at")))
    return out[0].unionByName(out[1])


@register(
    "gather_window",
    EV + " SELECT event_id FROM ev WHERE tenant_id = 't2' AND event_time >= 1704672000000 AND event_time < 1705276800000 AND NOT error AND event_name <> 'signup'"
)
def gather_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that analytics gather: a tenant's, in a half-open window, of one embedding space, by a predicate, less the deleted."""
    e, _, _ = store(spark, sf_dir)
    rows, _ = e._gather("t2", S.bind("SELECT * FROM events WHERE NOT error", "t2").predicate, 1704672000000, 1705276800000)
    return rows.select("event_id")


@register(
    "explain_counters",
    EV
    + """, p AS (SELECT DISTINCT tenant_id, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % 16 AS b, event_time - event_time % 2592000000 AS w FROM (SELECT *, sha256(tenant_id) AS h FROM ev)),
r AS (SELECT count(*) AS n FROM ev WHERE tenant_id = 't1' AND cost > 20)
SELECT (SELECT count(*) FROM (SELECT DISTINCT b, w FROM p)) AS parts_total, (SELECT count(*) FROM (SELECT DISTINCT b, w FROM p)) - (SELECT count(DISTINCT w) FROM p WHERE tenant_id = 't1') AS parts_pruned, n AS rows_scanned, n AS candidates_found, 256 * n AS bytes_fetched, least(n, 10) AS rows_returned FROM r""",
)
def explain_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What EXPLAIN says of a search that reads all lists: parts, rows, candidates and bytes as they were."""
    e, whole, _ = store(spark, sf_dir)
    plan = S.bind("SELECT event_id FROM events WHERE cost > 20", "t1")
    x = e.search(M.Query(text="vector 3", tenant="t1", predicate=plan.predicate, explain=True, **whole_of(e, whole)), e.snapshot(whole)).explain
    names = ["parts_total", "parts_pruned", "rows_scanned", "candidates_found", "bytes_fetched", "rows_returned"]
    return spark.createDataFrame([tuple(getattr(x, n) for n in names)], ", ".join(f"{n} long" for n in names))


@register(
    "recall_at_k",
    VEC + ", a AS (SELECT event_id FROM sc WHERE tenant_id = 't1' ORDER BY score DESC, event_id LIMIT 50), b AS (SELECT event_id FROM sc WHERE tenant_id = 't1' AND cost > 20 ORDER BY score DESC, event_id LIMIT 50) SELECT round((SELECT count(*) FROM a WHERE event_id IN (SELECT event_id FROM b)) / (SELECT count(*)::DOUBLE FROM a), 6) AS recall"
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which share of a top fifty another one has: here that of a search with a predicate."""
    found, truth = _search(spark, sf_dir, where="WHERE cost > 20", k=50), _search(spark, sf_dir, k=50)
    return spark.createDataFrame([(round(search.recall(found, truth), 6),)], "recall double")


@register(
    "rrf_bridge",
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3), w AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 11),
s AS (SELECT printf('v%08d', vec_id) AS event_id, round(greatest(-1.0, least(1.0, list_dot_product(embedding::DOUBLE[], q.v))), 6) AS a, round(greatest(-1.0, least(1.0, list_dot_product(embedding::DOUBLE[], w.v))), 6) AS b FROM embeddings, q, w),
r AS (SELECT event_id, row_number() OVER (ORDER BY a DESC, event_id) AS ra, row_number() OVER (ORDER BY b DESC, event_id) AS rb FROM s),
u AS (SELECT event_id, 1.0::DOUBLE / (60 + ra) AS s FROM r WHERE ra <= 50 UNION ALL SELECT event_id, 1.0::DOUBLE / (60 + rb) FROM r WHERE rb <= 50)
SELECT event_id, round(sum(s), 9) AS score FROM u GROUP BY event_id ORDER BY score DESC, event_id LIMIT 10""",
)
def rrf_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    e = table(spark, sf_dir, "embeddings").select(padded("v", "vec_id").alias("event_id"), F.col("embedding").alias("vector"))
    ranked = [search.exact_topk(e, query_vector(spark, sf_dir, n), 50, digits=6) for n in (3, 11)]
    fused = search.reciprocal_rank_fusion(ranked, 100).withColumn("score", F.round("score", 9))
    return fused.orderBy(*search.total_order()).limit(10)


# Analytics -------------------------------------------------------------------------------------------------------------

CENTROIDS = """cen AS (SELECT label, list(m ORDER BY d) AS c FROM (SELECT label, d, round(avg(x), 9) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d) GROUP BY label)"""


def label_centroids(spark: SparkSession, sf_dir: str) -> list[tuple[int, list[float]]]:
    """The mean embedding of each label: ten rows."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    m = e.groupBy("label", "d").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    rows = m.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("d", "m"))).alias("c")).orderBy("label").collect()
    return [(r.label, [x.m for x in r.c]) for r in rows]


@register(
    "novelty_label_baseline",
    VEC + ", " + CENTROIDS + " SELECT event_id, round(1 - max(list_dot_product(vector, c)), 6) AS novelty, round(1 - max(list_dot_product(vector, c)), 6) > 0.5 AS is_novel FROM vec, cen GROUP BY event_id"
)
def novelty_label_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novelty of every event against the labels' mean vectors."""
    c = [v for _, v in label_centroids(spark, sf_dir)]
    return analytics.with_novelty(with_embeddings(spark, sf_dir), c, digits=6).select("event_id", "novelty", (F.col("novelty") > 0.5).alias("is_novel"))


@register(
    "drift_label_baseline",
    VEC + ", " + CENTROIDS + """, n AS (SELECT event_id, tenant_id, round(1 - max(list_dot_product(vector, c)), 9) AS novelty FROM vec, cen GROUP BY event_id, tenant_id),
s AS (SELECT *, CASE tenant_id WHEN 't3' THEN 'no baseline' WHEN 't4' THEN 'degraded' ELSE 'ok' END AS status FROM n)
SELECT tenant_id AS generation, status, count(*) AS rows, CASE WHEN status = 'ok' THEN CAST(sum(CASE WHEN novelty > 0.5 THEN 1 ELSE 0 END) AS BIGINT) END AS novel,
  CASE WHEN status = 'ok' THEN round(avg(novelty), 5) END AS mean_novelty, CASE WHEN status = 'ok' THEN round(max(novelty), 6) END AS max_novelty,
  CASE WHEN status = 'ok' THEN avg(CASE WHEN novelty > 0.5 THEN 1.0 ELSE 0.0 END) > 0.05 END AS fires FROM s GROUP BY tenant_id, status""",
)
def drift_label_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of several generations (here the tenants) against their baselines: three sound, one degraded, one without."""
    c = [v for _, v in label_centroids(spark, sf_dir)]
    known = {g: analytics.Baseline("all", g, c, 0.5, 0) for g in ("t0", "t1", "t2")} | {"t4": analytics.Baseline("all", "t4", [], 0.0, 0, "degraded", "redacted rows")}
    d = analytics.drift(with_embeddings(spark, sf_dir).withColumn("generation", F.col("tenant_id")), known)
    return d.select("generation", "status", "rows", "novel", F.round("mean_novelty", 5).alias("mean_novelty"), F.round("max_novelty", 6).alias("max_novelty"), "fires")


NEAR = VEC + ", " + CENTROIDS + ", d AS (SELECT vec.*, cen.label AS cluster, round(list_sum(list_transform(list_zip(vector, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS dist FROM vec, cen), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, cluster) AS rn FROM d) WHERE rn = 1)"


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nearest(F.col("vector"), label_centroids(spark, sf_dir), 6)
    return with_embeddings(spark, sf_dir).withColumn("_n", n).select("*", "_n.cluster", "_n.dist").drop("_n")


@register("assign_nearest", NEAR + " SELECT event_id, cluster, dist FROM a")
def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the given centroids for every event."""
    return _near(spark, sf_dir).select("event_id", "cluster", "dist")


@register(
    "cluster_summary_given_centroids",
    NEAR + ", g AS (SELECT cluster, count(*) AS count, round(avg(cost), 6) AS avg_cost, round(avg(CASE WHEN error THEN 1.0 ELSE 0.0 END), 6) AS error_rate, arg_min(event_id, {'d': dist, 'e': event_id}) AS exemplar FROM a GROUP BY cluster) SELECT CAST(row_number() OVER (ORDER BY count DESC, exemplar) - 1 AS INTEGER) AS cluster_id, count, avg_cost, error_rate, exemplar FROM g"
)
def cluster_summary_given_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, cost, errors and exemplar of each cluster."""
    s = analytics.summarise(_near(spark, sf_dir))
    return s.select("cluster_id", "count", F.round("avg_cost", 6).alias("avg_cost"), F.round("error_rate", 6).alias("error_rate"), "exemplar")


@register(
    "semantic_diff_label",
    NEAR + """, g AS (SELECT cluster, count(*) AS count, round(avg(cost), 6) AS avg_cost, round(avg(CASE WHEN error THEN 1.0 ELSE 0.0 END), 6) AS error_rate, arg_min(event_id, {'d': dist, 'e': event_id}) AS exemplar FROM a WHERE event_time >= 1705276800000 GROUP BY cluster),
r AS (SELECT CAST(row_number() OVER (ORDER BY count DESC, exemplar) - 1 AS INTEGER) AS cluster_id, * FROM g)
SELECT cluster_id, count, avg_cost, error_rate, exemplar FROM r WHERE cluster NOT IN (SELECT cluster FROM a WHERE event_time < 1704153600000 AND event_name = 'error' AND tenant_id = 't1')""",
)
def semantic_diff_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters (by given centroids) of a later window to which nothing of an earlier one is nearest."""
    a = with_embeddings(spark, sf_dir)
    before = a.filter("event_time < 1704153600000 and event_name = 'error' and tenant_id = 't1'")
    d = analytics.untaken(before, a.filter("event_time >= 1705276800000"), np.array([v for _, v in label_centroids(spark, sf_dir)]))
    return d.select("cluster_id", "count", F.round("avg_cost", 6).alias("avg_cost"), F.round("error_rate", 6).alias("error_rate"), "exemplar")


@register(
    "column_dot_l2",
    "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS l2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
)
def column_dot_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product and squared distance of two vector columns."""
    e = table(spark, sf_dir, "embeddings")
    p = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return p.select("vec_id", F.round(dot(F.col("x"), F.col("y")), 6).alias("dot"), F.round(l2(F.col("x"), F.col("y")), 6).alias("l2"))


@register("semantic_cluster")
def semantic_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic GROUP BY of all embeddings into ten groups."""
    e = table(spark, sf_dir, "embeddings").select(
        F.format_string("v%08d", "vec_id").alias("event_id"), F.col("embedding").alias("vector"), F.lit(0.0).alias("cost"), F.lit(False).alias("error")
    )
    return analytics.semantic_cluster(e, 10).summary


@register("baseline_kmeans")
def baseline_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted baseline and the novelty of every embedding against it."""
    e = table(spark, sf_dir, "embeddings").select(F.format_string("v%08d", "vec_id").alias("event_id"), F.col("embedding").alias("vector"))
    return analytics.novelty_against(e, analytics.build_baseline(e, "all", "g"))


@register("ivf_pq_topk")
def ivf_pq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate top ten of every embedding as a query: coarse lists, code distances, exact reranking. Lists and candidates
    start at the model's defaults and grow until a sample of the queries finds 0.95 of its exact neighbours. The number of lists
    follows that of the embeddings, so that a list, and what a query looks at in it, stays of one size."""
    e = table(spark, sf_dir, "embeddings").select(
        F.format_string("v%08d", "vec_id").alias("event_id"), F.lit("t").alias("tenant_id"), F.lit("g").alias("generation"), F.col("embedding").alias("vector")
    )
    got = ingest.stratified_sample(e, 50_000, 42).orderBy(F.sha2("event_id", 256)).toArrow()
    book = train(np.array(got.column("vector").combine_chunks().flatten(), np.float32).reshape(got.num_rows, -1), search.lists_for(e.count()), 8, 42, 8)
    coded = materialise(encode(e, book).select("event_id", "vector", "centroid", "code"))
    nprobe, cap, candidates = search.calibrate(coded, book, 10, M.NPROBE, M.ADAPTIVE_MAX, M.ADAPTIVE_MARGIN, M.CANDIDATES)
    asked = coded.select(F.col("event_id").alias("query_id"), "vector")
    return search.approximate_topk_all(coded, asked, book, 10, nprobe, cap, M.ADAPTIVE_MARGIN, candidates).withColumn("score", F.round("score", 6))


def _fnv(seed: int) -> str:
    """FNV-1a of the bytes of ``w``."""
    return f"list_reduce(list_prepend({0xCBF29CE484222325 ^ seed}::UHUGEINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i - 1, 2) AS UHUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@register(
    "hash_embed",
    """WITH d AS (SELECT doc_id, CASE WHEN octet_length(encode(text)) > 32768 THEN left(text, len(list_filter(range(8192, 32769), lambda i: octet_length(encode(left(text, i))) <= 32768)) + 8191) ELSE text END AS text FROM documents),
l AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS l FROM d),
f AS (SELECT doc_id, unnest(l) AS w, 1.0 AS s FROM l UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || '_' || l[i + 1])), 0.5 FROM l),
u AS (SELECT w, """ + _fnv(0) + " % 64 AS i, " + _fnv(SIGN_SEED) + """ % 2 AS odd FROM (SELECT DISTINCT w FROM f)),
v AS (SELECT doc_id, i, sum(CASE WHEN odd = 0 THEN s ELSE -s END)::DOUBLE AS x FROM f JOIN u USING (w) GROUP BY doc_id, i),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY doc_id),
g AS (SELECT doc_id, list(round(CAST(CAST(coalesce(v.x, 0.0) / norm AS FLOAT) AS DOUBLE), 5) ORDER BY k.i) AS vector FROM n CROSS JOIN (SELECT unnest(range(64)) AS i) k LEFT JOIN v USING (doc_id, i) WHERE norm >= 1e-12 GROUP BY doc_id)
SELECT doc_id, vector FROM documents LEFT JOIN g USING (doc_id)""",
)
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash embedding of every document, all 64 coordinates. The model reads the first 32 KiB of a text; that is a part of
    its definition, as vectors of other lengths would not compare with stored ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    v = with_vectors(d, HashEmbedder(64))
    return v.select("doc_id", F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"))


ARI = """, t AS (SELECT label, event_name, count(*) AS n FROM vec GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS b, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY label)) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY event_name)) AS y, (SELECT sum(n) FROM t) AS n)
SELECT round((b - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 9) AS ari FROM s"""


@register("adjusted_rand_index", VEC + ARI)
def adjusted_rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the labels of the embeddings with the names of the events."""
    v = analytics.adjusted_rand_index(with_embeddings(spark, sf_dir), "label", "event_name")
    return spark.createDataFrame([(round(v, 9),)], "ari double")


# Ingest and maintenance ------------------------------------------------------------------------------------------------


#: The content hash of a row of ``two``: SHA-256 of its JSON.
HASH = """sha256('{"tenant_id":"' || tenant_id || '","event_time":' || event_time || ',"event_name":"' || event_name || '","cost":' || cost || ',"error":' || error || ',"body":"' || replace(body, '"', '\\"') || '","trace_id":"","span_id":"","attributes":{"k":{"tag":2,"s":null,"i":' || k || ',"d":null,"b":null}}}')"""
LAST = "SELECT event_id, tenant_id, event_time, cost FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY event_time DESC, " + HASH + " DESC) AS n FROM two) WHERE n = 1"


@register(
    "merge_dedup",
    EV + ", two AS (SELECT * FROM ev UNION ALL SELECT * REPLACE (event_time + 1000 * CAST(k % 2 AS BIGINT) AS event_time, round(cost + 1, 2) AS cost) FROM ev WHERE k % 3 = 0) " + LAST
)
def merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later version of each event survives a merge, and of equally late ones that of the larger content hash."""
    ev = canonical(spark, sf_dir)
    k = F.col("attributes")["k"]["i"]
    again = ev.filter(k % 3 == 0).withColumns({"event_time": F.col("event_time") + 1000 * (k % 2), "cost": F.round(F.col("cost") + 1, 2)})
    return dedup(ev.unionByName(again), []).select("event_id", "tenant_id", "event_time", "cost")


@register("merge_supersede_hash", EV + ", two AS (SELECT * FROM ev UNION ALL SELECT * REPLACE (round(cost + 1, 2) AS cost) FROM ev) " + LAST)
def merge_supersede_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As merge_dedup, with all times equal, so that the content hash alone decides."""
    ev = canonical(spark, sf_dir)
    return dedup(ev.unionByName(ev.withColumn("cost", F.round(F.col("cost") + 1, 2))), []).select("event_id", "tenant_id", "event_time", "cost")


_HISTORIES: dict[tuple[str, str], tuple[Engine, dict[str, int]]] = {}
REDACTED_BEFORE = 1704844800000  # 2024-01-10


def history(spark: SparkSession, sf_dir: str) -> tuple[Engine, dict[str, int]]:
    """An engine whose store went through two loads, a delete, a merge, a redaction and a rollback, and its snapshots by name."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _HISTORIES:
        e = Engine.init(spark, scratch(spark), TableEmbedder({"vector 3": query_vector(spark, sf_dir)}), window_ms=7 * M.DAY_MS, restarts=1, nlist=8)
        df = with_embeddings(spark, sf_dir)
        e.ingest(df)
        at = {"loaded": e.ingest(df.filter("number % 3 = 0").withColumn("cost", F.round(F.col("cost") + 1, 2))).id}
        e.delete(canonical(spark, sf_dir).filter("number % 11 = 0").select("event_id"))
        at["merged"] = e.merge().id
        e.redact_bodies(REDACTED_BEFORE, "retention")
        at["redacted"] = e.snapshot().id
        at["back"] = e.rollback(at["merged"]).id
        _HISTORIES[key] = e, at
    return _HISTORIES[key]


TWO = ", two AS (SELECT * FROM ev UNION ALL SELECT * REPLACE (round(cost + 1, 2) AS cost) FROM ev WHERE number % 3 = 0) "
MERGED = "SELECT event_id, tenant_id, event_time, cost FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY event_time DESC, " + HASH + " DESC) AS n FROM two WHERE number % 11 <> 0) WHERE n = 1"


@register("store_merge", EV + TWO + MERGED)
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a store after a merge: of two versions the one that supersedes, without the deleted."""
    e, at = history(spark, sf_dir)
    snap = e.snapshot(at["merged"])
    return e.store.read(snap.parts, snap).select("event_id", "tenant_id", "event_time", "cost")


@register(
    "store_rollback",
    EV + TWO + ", r AS (" + MERGED + ") SELECT 'loaded' AS at, count(*) AS n FROM two UNION ALL SELECT 'merged', count(*) FROM r UNION ALL SELECT 'back', count(*) FROM r"
)
def store_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a store's snapshots: before the merge, after it, and after a rollback to it."""
    e, at = history(spark, sf_dir)
    out = None
    for name in ("loaded", "merged", "back"):
        snap = e.snapshot(at[name])
        part = e.store.read(snap.parts, snap).agg(F.lit(name).alias("at"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "store_redact",
    EV + TWO + ", r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY event_time DESC, " + HASH + " DESC) AS n FROM two WHERE number % 11 <> 0) WHERE n = 1), h AS (SELECT *, sha256(tenant_id) AS h FROM r), b AS (SELECT *, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % 16 AS b, event_time - event_time % 604800000 AS w FROM h) SELECT event_id, CASE WHEN max(event_time) OVER (PARTITION BY b, w) < " + str(REDACTED_BEFORE) + " THEN '' ELSE body END AS body FROM b"
)
def store_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of a store after a redaction: empty in the parts that lie wholly before its time."""
    e, at = history(spark, sf_dir)
    snap = e.snapshot(at["redacted"])
    return e.store.read(snap.parts, snap).select("event_id", "body")


NOW = 1706659200000


@register(
    "skew_dead_letters",
    EV + f" SELECT event_id, CASE WHEN {NOW} - event_time > 604800000 THEN 'event_time_too_late' ELSE 'event_time_in_future' END AS reason FROM ev WHERE {NOW} - event_time > 604800000 OR event_time - {NOW} > 3600000"
)
def skew_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events too late or too early at admission."""
    return canonical(spark, sf_dir).select("event_id", ingest.validation_reason(NOW).alias("reason")).filter("reason is not null")


@register(
    "admission_reasons",
    EV
    + f""", b AS (SELECT event_id, number, CASE WHEN number % 7 = 0 THEN '' ELSE tenant_id END AS tenant_id, event_time, CASE WHEN number % 11 = 0 THEN -1.0 ELSE cost END AS cost, CASE WHEN number % 13 = 0 THEN ' ' ELSE body END AS body, CASE WHEN number % 17 < 2 THEN 'key' || number // 17 END AS key FROM ev),
r AS (SELECT *, CASE WHEN tenant_id = '' THEN 'missing_tenant_id' WHEN cost < 0 THEN 'invalid_cost' WHEN trim(body) = '' THEN 'empty_body' WHEN {NOW} - event_time > 604800000 THEN 'event_time_too_late' WHEN event_time - {NOW} > 3600000 THEN 'event_time_in_future' END AS reason FROM b),
q AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY number) > {M.QUOTA_EVENTS} AS over FROM r WHERE reason IS NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, coalesce(key, event_id) ORDER BY number) AS n FROM q WHERE NOT over),
p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY number) AS used FROM k WHERE n = 1)
SELECT reason, count(*) AS n FROM (SELECT reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT 'quota_exceeded' FROM q WHERE over UNION ALL SELECT 'idempotency_conflict' FROM k WHERE n > 1
UNION ALL SELECT CASE WHEN tenant_id = 't0' OR tenant_id = 't1' AND used > 50 THEN 'model_policy_denied' ELSE 'admitted' END FROM p) GROUP BY reason""",
)
def admission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the first check that they fail at admission: validation, lateness, dictionary, quota, idempotency, grants."""
    ev, n = canonical(spark, sf_dir), F.col("number")
    bad = ev.withColumns(
        {
            "tenant_id": F.when(n % 7 == 0, "").otherwise(F.col("tenant_id")), "cost": F.when(n % 11 == 0, -1.0).otherwise(F.col("cost")),
            "body": F.when(n % 13 == 0, " ").otherwise(F.col("body")),
            "idempotency_key": F.when(n % 17 < 2, F.concat(F.lit("key"), F.floor(n / 17).cast("string")))
        }
    )
    grants = spark.createDataFrame(
        [("t1", "m", "ingest", 50), ("t2", "m", "ingest", None), ("t3", "m", "ingest", None), ("t4", "m", "ingest", None), ("t0", "m", "query", None)],
        "tenant_id string, model string, purpose string, budget long"
    )
    judged = ingest.admit(bad, NOW, seq="number", grants=grants, model="m")
    return judged.select(F.coalesce("reason", F.lit("admitted")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@register(
    "key_dictionary",
    EV + ", f AS (SELECT k % 40 AS key, min(number) AS first FROM ev GROUP BY ALL), r AS (SELECT key, row_number() OVER (ORDER BY first) AS place FROM f WHERE key NOT IN (3, 4)) SELECT event_id, coalesce(place > 10, FALSE) AS over FROM ev LEFT JOIN r ON ev.k % 40 = r.key"
)
def key_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose attribute key no longer fits a dictionary of twelve, two of which are known."""
    ev = canonical(spark, sf_dir)
    value = F.col("attributes")["k"]
    ev = ev.withColumn("attributes", F.create_map(F.concat(F.lit("k"), (value["i"] % 40).cast("string")), value))
    return ingest.key_dictionary(ev, ["k3", "k4"], ["number"], limit=12).select("event_id", F.col("over_dictionary").alias("over"))


@register(
    "ingest_outcomes",
    EV
    + f""", b AS (SELECT number, tenant_id, event_id, CASE WHEN number % 11 = 0 THEN -1.0 ELSE cost END AS cost, CASE WHEN number % 13 = 0 THEN '?!' WHEN number % 17 = 0 THEN ' ' ELSE body END AS body, event_time FROM ev WHERE tenant_id < 't2'),
r AS (SELECT *, CASE WHEN cost < 0 THEN 'invalid_cost' WHEN trim(body) = '' THEN 'empty_body' WHEN {NOW} - event_time > 604800000 THEN 'event_time_too_late' WHEN event_time - {NOW} > 3600000 THEN 'event_time_in_future' END AS reason FROM b),
q AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY tenant_id, reason IS NULL ORDER BY event_time, event_id) > {M.QUOTA_EVENTS} THEN 'quota_exceeded' WHEN reason IS NULL AND body = '?!' THEN 'embedding_failed' ELSE reason END AS outcome FROM r)
SELECT coalesce(outcome, 'stored') AS outcome, count(*) AS n FROM q GROUP BY ALL""",
)
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch through admission into a store: its dead letters by reason, and the rows stored."""
    ev, n = canonical(spark, sf_dir).filter("tenant_id < 't2'"), F.col("number")
    bad = ev.withColumns(
        {"cost": F.when(n % 11 == 0, -1.0).otherwise(F.col("cost")), "body": F.when(n % 13 == 0, "?!").when(n % 17 == 0, " ").otherwise(F.col("body"))}
    ).drop("number")
    e = Engine.init(spark, scratch(spark), dim=64, nlist=8, window_ms=30 * M.DAY_MS, restarts=1)
    e.admit_and_ingest(bad, NOW)
    snap = e.snapshot()
    dead = spark.read.schema("reason string").json(f"{e.store.root}/dead_letters").select(F.col("reason").alias("outcome"))
    return dead.unionByName(e.store.read(snap.parts, snap).select(F.lit("stored").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@register("quota_count", EV + " SELECT tenant_id, least(count(*), 1000) AS admitted, greatest(count(*) - 1000, 0) AS rejected FROM ev GROUP BY tenant_id")
def quota_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quota of 1000 events a tenant, when all arrive at once."""
    d = canonical(spark, sf_dir).select("event_id", "tenant_id", "body", F.lit(0).cast("long").alias("arrival_ms"), F.col("number").alias("seq"))
    q = ingest.quota(d, events=1000)
    return q.groupBy("tenant_id").agg(F.sum((~F.col("over_quota")).cast("long")).alias("admitted"), F.sum(F.col("over_quota").cast("long")).alias("rejected"))


@register("fair_interleave", EV + " SELECT event_id, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY number) AS turn FROM ev")
def fair_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin turns of the tenants."""
    return ingest.fair_order(canonical(spark, sf_dir), "number").select("event_id", "tenant_id", F.col("turn").cast("long").alias("turn"))


@register(
    "idempotency_verdicts",
    EV + ", b AS (SELECT *, event_name || k AS key FROM ev), f AS (SELECT *, row_number() OVER w AS rn, first_value(cost) OVER w AS c0, first_value(event_time) OVER w AS t0 FROM b WINDOW w AS (PARTITION BY tenant_id, key ORDER BY number)) SELECT event_id, CASE WHEN rn = 1 THEN 'new' WHEN cost = c0 AND event_time = t0 THEN 'replay' ELSE 'conflict' END AS verdict FROM f"
)
def idempotency_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, replayed and conflicting events where several share a key."""
    d = canonical(spark, sf_dir).withColumn("idempotency_key", F.concat("event_name", F.col("attributes")["k"]["i"].cast("string")))
    return ingest.idempotency(d, None, "number").select("event_id", "verdict")


@register(
    "model_preflight",
    EV + ", g(tenant_id, budget) AS (VALUES ('t0', 100), ('t1', 700), ('t2', NULL), ('t3', 0)) SELECT event_id, CASE WHEN tenant_id NOT IN (SELECT tenant_id FROM g) THEN TRUE ELSE coalesce(rn > budget, FALSE) END AS denied FROM (SELECT ev.event_id, ev.tenant_id, g.budget, row_number() OVER (PARTITION BY ev.tenant_id ORDER BY number) AS rn FROM ev LEFT JOIN g ON ev.tenant_id = g.tenant_id)"
)
def model_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that their tenant's grants for the model do not cover."""
    grants = spark.createDataFrame(
        [("t0", "m", "ingest", 100), ("t1", "m", "ingest", 700), ("t2", "m", "ingest", None), ("t3", "m", "ingest", 0), ("t4", "other", "ingest", 9)],
        "tenant_id string, model string, purpose string, budget long"
    )
    return ingest.preflight(canonical(spark, sf_dir), grants, "m", seq="number").select("event_id", "denied")


@register(
    "lookup_vectors",
    EV + ", v AS (SELECT DISTINCT event_type || ' ' || props AS body FROM events WHERE event_type = 'view') SELECT event_id, body IN (SELECT body FROM v) AS found FROM ev"
)
def lookup_vectors_by_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen vectors found by body (here those of the views)."""
    from semevra.functions.embed import lookup_vectors

    ev = canonical(spark, sf_dir)
    frozen = ev.filter("event_name = 'view'").select("body", F.array(F.lit(1.0).cast("float")).alias("vector"))
    return lookup_vectors(ev, frozen).select("event_id", F.col("vector").isNotNull().alias("found"))


@register(
    "bucket_window",
    EV + ", b AS (SELECT event_id, tenant_id, event_time, sha256(tenant_id) AS h FROM ev) SELECT event_id, CAST(CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % 16 AS INTEGER) AS bucket, event_time - event_time % 86400000 AS window_start FROM b"
)
def bucket_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partition of every event: tenant bucket and day."""
    return canonical(spark, sf_dir).select("event_id", tenant_bucket(F.col("tenant_id")).alias("bucket"), day_window(F.col("event_time")).alias("window_start"))


@register(
    "stratified_sample",
    EV
    + """, c AS (SELECT tenant_id, count(*) AS n FROM ev GROUP BY tenant_id), f AS (SELECT *, least(n, 125 // (SELECT count(*) FROM c)) AS got FROM c),
l AS (SELECT *, n - got AS rest, 500 - sum(got) OVER () AS room, greatest(1, sum(n - got) OVER ()) AS spare FROM f),
s AS (SELECT *, CAST(room * rest AS DOUBLE) / CAST(spare AS DOUBLE) AS share FROM l),
w AS (SELECT *, floor(share) AS whole, row_number() OVER (ORDER BY share - floor(share) DESC, tenant_id) AS place, 500 - sum(got + floor(share)) OVER () AS extra FROM s),
q AS (SELECT tenant_id, got + whole + CASE WHEN place <= extra THEN 1 ELSE 0 END AS quota FROM w),
t AS (SELECT event_id, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY sha256('42|' || event_id), event_id) AS place FROM ev)
SELECT event_id, tenant_id FROM t JOIN q USING (tenant_id) WHERE place <= quota OR (SELECT count(*) FROM ev) <= 500""",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 500 events: a sampling operator, so its size is its meaning."""
    return ingest.stratified_sample(canonical(spark, sf_dir), 500, 42).select("event_id", "tenant_id")


@register("tsv_roundtrip", EV + " SELECT event_id, tenant_id, event_time, event_name, cost, error, body || chr(9) || chr(10) || '\\' AS body FROM ev")
def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as TSV lines and parsed again, with tab, newline and backslash in the body."""
    d = canonical(spark, sf_dir).withColumn("body", F.concat("body", F.lit("\t\n\\")))
    return readers.parse_tsv(readers.tsv_lines(d)).select("event_id", "tenant_id", "event_time", "event_name", "cost", "error", "body")


@register("jsonl_roundtrip", EV + " SELECT event_id, tenant_id, event_time, cost, error, k FROM ev")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines, with typed attributes, and parsed again."""
    d = canonical(spark, sf_dir)
    attributes = F.transform_values("attributes", lambda _, v: F.struct(F.lit("int").alias("type"), v["i"].cast("string").alias("value")))
    lines = d.select(F.to_json(F.struct("event_id", "tenant_id", "event_time", "event_name", "cost", "error", "body", attributes.alias("attributes"))).alias("value"))
    return readers.parse_jsonl(lines).select("event_id", "tenant_id", "event_time", "cost", "error", F.col("attributes")["k"]["i"].alias("k"))


@register(
    "otlp_map",
    "SELECT 's' || conv_id || '-' || turn AS event_id, 'tenant' || conv_id % 3 AS tenant_id, CAST(1700000000000 + turn AS BIGINT) AS event_time, regexp_replace('ask ' || conv_id || chr(10) || coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS body, role = 'system' AS error FROM conversations"
)
def otlp_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of OTLP payloads, one for each turn of the conversations, mapped to events."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    c = table(spark, sf_dir, "conversations")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    span = F.struct(
        text("s", F.col("conv_id"), "-", F.col("turn")).alias("spanId"), F.lit("chat").alias("name"), text(
            (F.lit(1_700_000_000_000) + F.col("turn")), "000000"
        ).alias("startTimeUnixNano"),
        F.array(pair("gen_ai.prompt", text("ask ", F.col("conv_id"))), pair("gen_ai.completion", F.coalesce("text", F.lit("")))).alias("attributes"),
        F.struct(F.when(F.col("role") == "system", "STATUS_CODE_ERROR").otherwise("0").alias("code")).alias("status"),
    )
    resource = F.struct(F.array(pair("tenant.id", text("tenant", F.col("conv_id") % 3))).alias("attributes"))
    payload = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    return readers.parse_otlp(c.select(payload.alias("value")), "none", 0).select("event_id", "tenant_id", "event_time", "body", "error")
