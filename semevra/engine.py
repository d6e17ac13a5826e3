"""The engine: one store, its SQL, search, analytics, ingest and maintenance."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semevra import model as M
from semevra.functions.codebook import Codebook, probes, train
from semevra.functions.embed import HashEmbedder, with_vectors
from semevra.operators import analytics, ingest, maintenance, search
from semevra.plans import sql as S
from semevra.plans.predicate import compile_predicate, count_terms, time_bounds
from semevra.session import discard, materialise
from semevra.sources.store import Snapshot, Store, encode

TRAINING_ROWS = 50_000
IDEMPOTENCY = "tenant_id string, key string, hash string, at long, batch long, day long, n long"


#: Bits of the exponent that share a bucket of an exact sum, and bits by which its values are scaled to integers.
_BUCKET, _SCALE = 32, 54


def _power(n: Any) -> Any:
    return F.pow(F.lit(2.0), n.cast("double"))


def _limbs(x: Any) -> tuple[Any, Any, Any]:
    """(bucket, high, low) of a double: it is (high * 2^40 + low) * 2^(32 bucket - 54) exactly, all three being integers."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    b = F.when(finite & (x != 0), F.floor(F.log2(F.abs(x)) / _BUCKET)).otherwise(0).cast("int")
    v = F.when(finite, x) * _power(-b * (_BUCKET // 2)) * _power(-b * (_BUCKET // 2) + _SCALE)
    high = F.floor(v / float(1 << 40))
    return b, high, (v - high * float(1 << 40)).cast("long")


def aggregate_columns(plan: S.Plan, df: DataFrame) -> DataFrame:
    """Groups of a bound plan over its rows (with score): sums are 0 over nothing, min and max of anything but numbers NULL,
    group keys are texts, and LIMIT does not apply.

    No sum depends on the layout. Those of cost hold for every finite double: values of one range of exponents add up as
    integers, without error, in a first aggregation, and a second adds the few ranges in their order.
    """
    names = list(dict.fromkeys(plan.group))
    keys = [F.col(g).cast("string").alias(f"_key_{g}") for g in names]
    first: dict[str, Any] = {"_rows": F.count(F.lit(1))}
    second: dict[str, Any] = {}
    wide = any(i.kind == "aggregate" and i.function in ("sum", "avg") and i.name == "cost" for i in plan.items)
    bucket, high, low = _limbs(F.col("cost").cast("double")) if wide else (F.lit(0), None, None)
    for i in plan.items:
        if i.kind != "aggregate" or i.output in second:
            continue
        own = f"_{len(second)}"
        c = None if i.name == "*" else F.col(i.name)
        if i.function == "count":
            first[own] = F.count(F.lit(1)) if c is None else F.count(c)
            second[i.output] = F.coalesce(F.sum(own), F.lit(0).cast("long"))
        elif i.name not in M.NUMERIC:
            second[i.output] = F.max(F.lit(None).cast("double"))
        elif i.function in ("min", "max"):
            f = F.min if i.function == "min" else F.max
            first[own], second[i.output] = f(c.cast("double")), f(own)
        else:
            first[f"{own}n"] = F.count(c)
            if i.name == "cost":
                first[f"{own}h"], first[f"{own}l"] = F.sum(high.cast("decimal(20,0)")), F.sum(low.cast("decimal(20,0)"))
                d = c.cast("double")
                first[f"{own}x"] = F.sum(F.when(F.isnan(d) | (F.abs(d) == float("inf")), d))  # in any order the same
                parts = F.sort_array(F.collect_list(F.struct(F.col("_bucket").alias("b"), (F.col(f"{own}h") * F.lit(1 << 40) + F.col(f"{own}l")).cast("decimal(38,0)").alias("v"))))
                term = lambda s, x: s + F.coalesce(x["v"].cast("double"), F.lit(0.0)) * _power(x["b"] * (_BUCKET // 2)) * _power(x["b"] * (_BUCKET // 2) - _SCALE)
                total = F.aggregate(parts, F.lit(0.0), term) + F.coalesce(F.sum(f"{own}x"), F.lit(0.0))
            else:
                first[own] = F.sum(c.cast("decimal(38,22)" if i.name == "score" else "decimal(38,0)"))
                total = F.coalesce(F.sum(own).cast("double"), F.lit(0.0))
            n = F.sum(f"{own}n")
            second[i.output] = total if i.function == "sum" else F.when(n > 0, total / n)
    parts = [f"_key_{g}" for g in names]
    level = df.groupBy(*keys, bucket.alias("_bucket")).agg(*[a.alias(k) for k, a in first.items()])
    last = [a.alias(k) for k, a in second.items()] or [F.sum("_rows").alias("_n")]
    out = level.groupBy(*parts).agg(*last).orderBy(*parts) if keys else level.agg(*last)
    cols = []
    for i in plan.items:
        if i.kind == "aggregate":
            cols.append(F.col(f"`{i.output}`"))
        elif i.kind == "column" and i.name in names:
            cols.append(F.col(f"_key_{i.name}").alias(i.name))
        else:
            cols.append(F.lit(None).cast("string").alias(i.output))
    return out.select(*cols)


def attribute_text(key: str, promoted: dict[str, str] | None = None) -> Any:
    """An attribute's value as text (a column has one type), NULL where absent."""
    if promoted and key in promoted:
        return F.col(f"`attr.{key}`").cast("string")
    a = F.col("attributes")[key]
    return F.when(a["tag"] == M.STR, a["s"]).when(a["tag"] == M.INT, a["i"].cast("string")).when(
        a["tag"] == M.DOUBLE, a["d"].cast("string")
    ).when(a["tag"] == M.BOOL, a["b"].cast("string"))


def project(plan: S.Plan, df: DataFrame, promoted: dict[str, str] | None = None) -> DataFrame:
    cols = []
    for i in plan.items:
        if i.kind == "star":
            cols += [F.col(c) for c in M.STAR]
        elif i.kind == "attribute":
            cols.append(attribute_text(i.name, promoted).alias(i.output))
        else:
            cols.append(F.col(i.name))
    return df.select(*cols)


def run_plan(plan: S.Plan, events: DataFrame, scored: DataFrame | None = None, promoted: dict[str, str] | None = None) -> DataFrame:
    """A bound plan over a DataFrame of events. The tenant filter is the first on the source; ``scored`` are the rows of the semantic part, if any."""
    if scored is None:
        rows = events.filter(F.col("tenant_id") == plan.tenant)
        if plan.predicate is not None:
            rows = rows.filter(compile_predicate(plan.predicate, promoted))
        rows = rows.withColumn("score", F.lit(0.0))
    else:
        rows = scored
    if plan.aggregate:
        return aggregate_columns(plan, rows)
    return project(plan, rows.orderBy(*search.total_order()).limit(plan.limit), promoted)


class Engine:
    """``Engine.init(spark, root)`` makes a store, ``Engine(spark, root)`` opens one."""

    def __init__(self, spark: SparkSession, root: str, embedder: HashEmbedder | None = None) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.embedder = embedder or HashEmbedder(self.store.config["dim"])
        self.embedders = {self.embedder.space: self.embedder}
        self.grants: DataFrame | None = None
        self._asked: dict[tuple[str, str], int] = {}

    def policy(self, grants: DataFrame | None) -> None:
        """Let tenants use models only as ``grants`` (tenant_id, model, purpose, budget) say: purpose 'ingest' for events, 'query' for
        the texts of searches, each up to its budget (null: no bound) while this engine lives."""
        self.grants, self._asked = grants, {}

    def _may_ask(self, tenant: str | None, model: str) -> None:
        if self.grants is None:
            return
        g = self.grants.filter((F.col("tenant_id") == tenant) & (F.col("model") == model) & (F.col("purpose") == "query")) if tenant else None
        budgets = [] if g is None else [r[0] for r in g.select(F.max(F.coalesce("budget", F.lit(1 << 62)))).collect() if r[0] is not None]
        n = self._asked.get((tenant or "", model), 0)
        if not budgets or n >= budgets[0]:
            raise M.EngineError(f"tenant {tenant!r} may not embed a query by {model}: " + ("its budget is spent" if budgets else "there is no grant"))
        self._asked[tenant or "", model] = n + 1

    @classmethod
    def init(cls, spark: SparkSession, root: str, embedder: HashEmbedder | None = None, **config: Any) -> Engine:
        if embedder:
            config.setdefault("dim", embedder.dim)
        Store.init(spark, root, **config)
        return cls(spark, root, embedder)

    def register(self, embedder: HashEmbedder) -> None:
        """Make a further model known, for the spaces that it made."""
        self.embedders[embedder.space] = embedder

    def snapshot(self, number: int | None = None) -> Snapshot:
        return self.store.snapshot(number)

    # Ingest ------------------------------------------------------------------------------------------------------------

    def _bootstrap(self, snap: Snapshot, vectors: DataFrame) -> Snapshot:
        """Codebooks from a stratified, bounded sample of the first batch."""
        c = self.store.config
        got = ingest.stratified_sample(vectors.select("event_id", "tenant_id", "vector"), TRAINING_ROWS, c["seed"]).orderBy(F.sha2("event_id", 256), "event_id").toArrow()
        x = np.array(got.column("vector").combine_chunks().flatten(), np.float32).reshape(got.num_rows, -1)
        book = train(x, c["nlist"], c["pq_m"], c["seed"], c["restarts"])
        g, entry = self.store.put_generation(self.embedder.model_id, self.embedder.version, book)
        return self.store.commit(snap, active=g, generations={g: entry | {"state": "active", "provisional": True}})

    def ingest(self, events: DataFrame, batch: int | None = None) -> Snapshot:
        """Bulk load: validate, embed, encode, write, one commit. No lateness, quota, dictionary or idempotency checks.

        A ``batch`` number that was committed before changes nothing, so a replayed micro-batch is written once.
        """
        snap = self.store.snapshot()
        if batch is not None and batch <= snap.data["batch"]:
            return snap
        rows = events if "vector" in events.columns else with_vectors(events, self.embedder)
        rows = materialise(rows.select(*M.EVENT.fieldNames(), "vector", ingest.validation_reason(0).alias("_reason")))  # computed once
        try:
            bad = rows.select("_reason", "event_id").filter(~F.col("_reason").isin("event_time_too_late", "event_time_in_future")).first()
            if bad:
                raise M.EngineError(f"event {bad.event_id}: {bad._reason}")
            return self._publish(snap, rows, batch)
        finally:
            discard(rows)

    def _publish(self, snap: Snapshot, rows: DataFrame, batch: int | None, **change: Any) -> Snapshot:
        """Parts, batch number and whatever else changes with them, in one commit. ``rows`` have been materialised."""
        if rows.filter("vector is null").limit(1).count():
            raise M.EngineError("an event cannot be embedded")
        if batch is not None:
            change["batch"] = batch
        if rows.limit(1).count():
            if snap.active is None:
                snap = self._bootstrap(snap, rows)
            book = self.store.codebook(snap.active)
            change["parts"] = snap.parts + self.store.write_parts(encode(rows, book), snap.active)
        return self.store.commit(snap, **change) if change else snap

    def admit_and_ingest(self, events: DataFrame, now_ms: int | None = None, batch: int | None = None, grants: DataFrame | None = None) -> dict[str, int]:
        """One micro-batch with all admission checks; rejected rows go to the dead-letter log. Counts by outcome.

        Dead letters and idempotency keys are written under the batch number and refer to it, so a replay overwrites them.
        """
        now = int(time.time() * 1000) if now_ms is None else now_ms
        snap = self.store.snapshot()
        if batch is not None and batch <= snap.data["batch"]:
            return {}
        number = snap.data["batch"] + 1 if batch is None else batch
        if "seq" not in events.columns:
            events = events.withColumn("seq", F.row_number().over(Window.partitionBy("tenant_id").orderBy("event_time", "event_id")))
        seen = None
        if self.store.files.exists("idempotency"):
            oldest = (now - M.IDEMPOTENCY_MS) // M.DAY_MS
            for name, _ in self.store.files.list("idempotency"):  # days whose events, an hour ahead at most, lie outside the window
                if name.startswith("day=") and int(name[4:]) < oldest - 1:
                    self.store.files.delete(f"idempotency/{name}")
            seen = self.spark.read.schema(IDEMPOTENCY).parquet(f"{self.store.root}/idempotency").filter((F.col("batch") < number) & (F.col("at") >= now - M.IDEMPOTENCY_MS))
            seen = seen.groupBy("tenant_id", "key").agg(F.max_by("hash", "batch").alias("hash"))
        known = snap.data.get("keys", [])
        judged = materialise(ingest.admit(events, now, seen, known, grants=self.grants if grants is None else grants, model=self.embedder.model_id))
        good = with_vectors(judged.filter("reason is null"), self.embedder)
        good = materialise(good)
        failed = good.filter("vector is null").drop("vector").withColumn("reason", F.lit("embedding_failed"))
        dead = judged.filter("reason is not null and reason <> 'replay'").unionByName(failed)
        dead.select("reason", F.struct(*M.EVENT.fieldNames()).alias("event")).write.mode("overwrite").json(f"{self.store.root}/dead_letters/batch={number}")
        kept = good.filter("vector is not null")
        keys = [r[0] for r in kept.select(F.explode(F.map_keys("attributes"))).distinct().limit(M.MAX_DICTIONARY + 1).collect()]
        from semevra.functions.hashing import content_hash

        kept.select(
            "tenant_id", F.coalesce("idempotency_key", "event_id").alias("key"), content_hash(ingest.CONTENT).alias("hash"), F.col("event_time").alias("at"),
            F.lit(number).cast("long").alias("batch")
        ).write.mode("overwrite").parquet(f"{self.store.root}/idempotency/day={now // M.DAY_MS}/n={number}")
        self._publish(snap, kept, number, keys=sorted(set(keys) | set(known)))
        out = {r[0] or "admitted": r[1] for r in judged.groupBy("reason").count().collect()}
        n = failed.count()
        if n:
            out["embedding_failed"] = n
            out["admitted"] -= n
        return out

    # Search ------------------------------------------------------------------------------------------------------------

    def _spaces(self, snap: Snapshot, parts: list[dict]) -> list[str]:
        return sorted({snap.space(p["generation"]) for p in parts})

    def search(self, query: M.Query, snapshot: Snapshot | None = None) -> M.Result:
        """Hybrid search of one snapshot. Deleted rows are removed before the top k is taken."""
        snap = snapshot or self.store.snapshot()
        if query.k < 0 or query.nprobe < 1 or query.candidates < 1 or query.rerank < 1:
            raise M.EngineError("k, nprobe, candidates and rerank must be positive")
        if query.vector is None and not (query.text or "").strip():
            raise M.EngineError("query text is blank")
        lo, hi = time_bounds(query.predicate)
        lo = max([x for x in (lo, query.time_from) if x is not None], default=None)
        hi = min([x for x in (hi, query.time_to) if x is not None], default=None)
        parts = self.store.prune(snap, query.tenant, lo, hi, query.space)
        spaces = self._spaces(snap, parts)
        if len(spaces) > 1:
            bridged = all(any(set(b["spaces"]) == {x, y} for b in snap.data["bridges"]) for i, x in enumerate(spaces) for y in spaces[:i])
            if not bridged:
                raise M.EngineError(f"the rows lie in several embedding spaces ({', '.join(spaces)}); name one, or declare a bridge")
            each = [self.search(replace(query, space=s), snap).rows for s in spaces]
            fused = search.reciprocal_rank_fusion(each, query.k)
            return M.Result(fused, snap.id, spaces=tuple(spaces), bridged=True)
        explain = M.Explain(parts_total=len(snap.parts), parts_pruned=len(snap.parts) - len(parts))

        def rows_of(parts: list[dict], alive: bool = True) -> DataFrame:
            df = self.store.read(parts, snap if alive else None)
            if query.tenant is not None:
                df = df.filter(F.col("tenant_id") == query.tenant)
            if lo is not None:
                df = df.filter(F.col("event_time") >= lo)
            if hi is not None:
                df = df.filter(F.col("event_time") <= hi)
            return df if query.predicate is None else df.filter(compile_predicate(query.predicate, self.store.config["promoted"]))

        base = rows_of(parts)
        if not parts:
            return M.Result(search.exact_topk(base, [0.0] * self.store.config["dim"], 0), snap.id, explain=explain)
        q = self._query_vector(query, spaces[0])
        if query.exact:
            rows = search.exact_topk(base, [float(x) for x in q], query.k, query.threshold, at_most=self._held(parts, query.tenant))
        else:
            rows = self._approximate(query, rows_of, snap, parts, q, explain)
        if query.explain:
            self._estimate(query, parts, base, explain)
            began = time.monotonic()
            explain.rows_returned = rows.count()
            explain.elapsed_ms = int(1000 * (time.monotonic() - began))
            explain.rows_scanned = base.filter(F.col("centroid").isin(explain.lists)).count() if explain.lists else base.count()
        clusters = None
        if query.group_k:
            survivors = replace(query, k=query.rerank, group_k=None, explain=False)
            clusters = search.group_survivors(self.search(survivors, snap).rows, query.group_k, self.store.config["seed"], query.rerank)
        return M.Result(rows, snap.id, explain=explain, clusters=clusters, spaces=tuple(spaces))

    def _query_vector(self, query: M.Query, space: str) -> np.ndarray:
        if query.vector is not None:
            return np.array(query.vector, np.float32)
        if space not in self.embedders:
            raise M.EngineError(f"no embedder is registered for the space {space}")
        self._may_ask(query.tenant, self.embedders[space].model_id)
        return self.embedders[space].embed(query.text)

    @staticmethod
    def _held(parts: list[dict], tenant: str | None) -> int:
        """Rows of the parts, or those of one tenant, by the manifest."""
        return sum(s["rows"] for p in parts for t, s in p["tenants"].items() if tenant in (None, t))

    def _approximate(self, query: M.Query, rows_of: Callable[..., DataFrame], snap: Snapshot, parts: list[dict], q: np.ndarray, explain: M.Explain) -> DataFrame:
        """Per generation: the parts that have a probed list are scanned for codes, those that have a candidate for whole rows.

        Where all their rows are candidates, as with a threshold or no more rows than candidates, codes select nothing: rows are
        exactly scored in the one scan, before the deleted are taken out, so vectors are not shuffled.
        """
        out: DataFrame | None = None
        held = 0
        for g in sorted({p["generation"] for p in parts}):
            book = self.store.codebook(g)
            order, dists = book.rank(q)
            n = probes(dists, query.nprobe, query.adaptive, query.adaptive_margin, M.ADAPTIVE_MAX)
            explain.nprobe, explain.lists = n, [int(x) for x in order[:n]]
            paths = {p["path"] for p in self.store.prune(snap, query.tenant, generations=[g], lists=explain.lists)}
            own = [p for p in parts if p["path"] in paths]
            explain.parts_scanned += len(own)
            if not own:
                continue

            def source(rows: list, own: list[dict] = own) -> DataFrame:
                times: dict[str, list[int]] = {}
                for r in rows:
                    times.setdefault(r.tenant_id, []).append(r.event_time)
                some = [p for p in own if any(s["lo"] <= t <= s["hi"] for x, s in p["tenants"].items() for t in times.get(x, ()))]
                explain.candidates_found += len(rows)
                explain.parts_fetched += len(some)
                explain.bytes_fetched += 4 * book.dim * len(rows)
                return rows_of(some or own[:1])

            rows = self._held(own, query.tenant)
            held += rows
            n = min(query.candidates, query.rerank)
            if query.fetch_budget_bytes is not None:
                n = min(n, query.fetch_budget_bytes // (4 * book.dim))
            if query.threshold is not None or rows <= n:
                part = search.scored(rows_of(own, False).filter(F.col("centroid").isin(explain.lists)), [float(x) for x in q])
                if query.threshold is not None:
                    part = part.filter(F.col("score") >= query.threshold)
                part = self.store.alive(part, snap)
            else:
                part = search.approximate_topk(rows_of(own), q, book, explain.lists, query.k, n, source)
            if query.explain and (query.threshold is not None or rows <= n or n > search.HELD_ROWS):
                found = rows_of(own).filter(F.col("centroid").isin(explain.lists)).count()
                found = found if query.threshold is not None else min(n, found)
                explain.candidates_found += found
                explain.parts_fetched += len(own)
                explain.bytes_fetched += 4 * book.dim * found
            out = part if out is None else out.unionByName(part)
        if out is None:
            return search.exact_topk(rows_of([]), [float(x) for x in q], 0)
        return search.best(out, query.k, at_most=held)

    def _estimate(self, query: M.Query, parts: list[dict], base: DataFrame, explain: M.Explain) -> None:
        """Costs as the planner sees them; Catalyst orders filters and distances by itself."""
        rows = self._held(parts, query.tenant)
        explain.estimated_rows = rows
        if query.predicate is not None and rows:
            head = self.store.read(parts).limit(512)
            ok = head.filter(compile_predicate(query.predicate, self.store.config["promoted"])).count()
            explain.selectivity = ok / max(1, head.count())
        terms = count_terms(query.predicate) + 1
        share = min(1.0, explain.nprobe / self.store.config["nlist"]) if explain.nprobe else 1.0
        costs = {
            "scalar-first": rows * terms + rows * explain.selectivity * share, "semantic-first": rows * share + rows * share * terms,
            "interleaved": rows * share * (terms + explain.selectivity)
        }
        explain.strategy = query.plan if query.plan != "auto" else min(sorted(costs), key=costs.get)
        explain.estimated_cost = costs.get(explain.strategy, 0.0)
        explain.candidates = query.candidates
        explain.bytes_estimated = int(rows * share * self.store.config["pq_m"] + query.rerank * 4 * self.store.config["dim"])
        explain.cost_micro_dollars = 100 * len(parts) + explain.bytes_estimated * 1e-6

    def exact_search(self, query: M.Query) -> M.Result:
        return self.search(replace(query, exact=True))

    # SQL ---------------------------------------------------------------------------------------------------------------

    def sql(self, text: str, tenant: str, cursor: str | None = None) -> M.Result:
        """Run a statement for a tenant. Rows come in pages of LIMIT; ``next_cursor`` continues on the same snapshot."""
        plan = S.bind(text, tenant)
        if cursor is not None and plan.aggregate:
            raise M.EngineError("an aggregate has no pages, so it takes no cursor")
        key = search.read_cursor(cursor, plan.fingerprint) if cursor else None
        return self.run(plan, self.store.snapshot(key["snapshot"] if key else None), key)

    def run(self, plan: S.Plan, snap: Snapshot, key: dict | None = None) -> M.Result:
        """A bound plan over one snapshot, from behind ``key`` (score, id) on if there is one."""
        tenant = plan.tenant
        promoted = self.store.config["promoted"]
        if plan.semantic is not None:
            k = plan.rerank if plan.aggregate or key else max(plan.limit, 1)
            k = max(k, plan.rerank)
            rows = self.search(
                M.Query(
                    text=plan.semantic, tenant=tenant, k=k, predicate=plan.predicate, nprobe=plan.nprobe, candidates=max(plan.candidates, plan.rerank),
                    rerank=plan.rerank
                ),
                snap
            ).rows
            if plan.aggregate:
                return M.Result(run_plan(plan, rows, rows, promoted), snap.id)
        else:
            lo, hi = time_bounds(plan.predicate)
            events = self.store.read(self.store.prune(snap, tenant, lo, hi), snap)
            if plan.aggregate:
                return M.Result(run_plan(plan, events, None, promoted), snap.id)
            rows = events.filter(F.col("tenant_id") == tenant)
            if plan.predicate is not None:
                rows = rows.filter(compile_predicate(plan.predicate, promoted))
            rows = rows.withColumn("score", F.lit(0.0))
        if key:
            rows = search.after(rows, key["score"], key["id"])
        ahead = rows.orderBy(*search.total_order()).limit(plan.limit + 1)
        if plan.limit == 0:
            return M.Result(project(plan, ahead.limit(0), promoted), snap.id)
        got = ahead.collect()  # one page, as LIMIT bounds it
        page = got[: plan.limit]
        token = search.make_cursor(snap.id, plan.fingerprint, page[-1].score, page[-1].event_id) if len(got) > len(page) else None
        shown = self.spark.createDataFrame(page, ahead.schema)
        return M.Result(project(plan, shown.orderBy(*search.total_order()), promoted), snap.id, token)

    # Analytics ---------------------------------------------------------------------------------------------------------

    def _gather(
        self, tenant: str, predicate: Any = None, time_from: int | None = None, time_to: int | None = None, space: str | None = None, inclusive: bool = False
    ) -> tuple[DataFrame, str]:
        """Rows of a tenant; ``time_to`` is exclusive here unless said otherwise. One space only."""
        snap = self.store.snapshot()
        hi = time_to if inclusive or time_to is None else time_to - 1
        parts = self.store.prune(snap, tenant, time_from, hi, space)
        spaces = self._spaces(snap, parts)
        if len(spaces) > 1:
            raise M.EngineError(f"the rows lie in several embedding spaces ({', '.join(spaces)}); name one")
        df = self.store.read(parts, snap).filter(F.col("tenant_id") == tenant)
        if time_from is not None:
            df = df.filter(F.col("event_time") >= time_from)
        if hi is not None:
            df = df.filter(F.col("event_time") <= hi)
        if predicate is not None:
            df = df.filter(compile_predicate(predicate, self.store.config["promoted"]))
        return df, spaces[0] if spaces else ""

    def semantic_cluster(
        self, tenant: str, k: int, predicate: Any = None, time_from: int | None = None, time_to: int | None = None, space: str | None = None
    ) -> analytics.Clusters:
        df, s = self._gather(tenant, predicate, time_from, time_to, space)
        return analytics.semantic_cluster(df.select("event_id", "vector", "cost", "error"), k, s)

    def baseline_build(self, tenant: str, time_from: int | None = None, time_to: int | None = None, generation: str | None = None) -> analytics.Baseline:
        """Fit what is known of a tenant in a generation, by default the active one, and keep it in the snapshot."""
        snap = self.store.snapshot()
        g = generation or snap.active
        df, _ = self._gather(tenant, None, time_from, time_to, snap.space(g) if g else None)
        b = analytics.build_baseline(df.filter(F.col("generation") == g), tenant, g, self.store.config["seed"])
        self.store.commit(snap, baselines=snap.data["baselines"] | {f"{tenant}|{g}": asdict(b)})
        return b

    def baselines_refresh(self) -> dict[str, str]:
        """Give every watched tenant a baseline in each generation that holds its rows; 'ok' or 'degraded' by tenant.

        A sound baseline stays. One is degraded, and kept as such with its reason, where rows with redacted bodies are stranded in
        another generation: they can never be embedded anew, so what is left is a biased part of the tenant's history. A baseline
        of a generation without rows goes.
        """
        start = self.store.snapshot()
        rows: dict[tuple[str, str], list[int]] = {}
        for p in start.parts:
            for t, s in p["tenants"].items():
                n = rows.setdefault((t, p["generation"]), [0, 0])
                n[0] += s["rows"]
                n[1] += s["rows"] * bool(p.get("redacted"))
        watched = {k.split("|")[0] for k in start.data["baselines"]}
        out = {t: "ok" for t in watched}
        for (tenant, g), (n, _) in sorted(rows.items()):
            old = start.data["baselines"].get(f"{tenant}|{g}")
            if tenant not in watched or old and old.get("state", "ok") == "ok":
                continue
            stranded = sum(gone for (t, x), (_, gone) in rows.items() if t == tenant and x != g)
            if stranded:
                reason = f"{stranded} rows with redacted bodies cannot leave another generation; a baseline of the {n} rows here would be biased, so they are not watched"
                b = analytics.Baseline(tenant, g, [], 0.0, n, "degraded", reason)
                snap = self.store.snapshot()
                self.store.commit(snap, baselines=snap.data["baselines"] | {f"{tenant}|{g}": asdict(b)})
                out[tenant] = "degraded"
            else:
                self.baseline_build(tenant, generation=g)
        snap = self.store.snapshot()
        kept = {k: v for k, v in snap.data["baselines"].items() if tuple(k.split("|", 1)) in rows}
        if kept != snap.data["baselines"]:
            self.store.commit(snap, baselines=kept)
        return out

    def _baselines(self, snap: Snapshot, tenant: str) -> dict[str, analytics.Baseline]:
        return {k.split("|", 1)[1]: analytics.Baseline(**v) for k, v in snap.data["baselines"].items() if k.split("|")[0] == tenant}

    def novelty_against(self, tenant: str, predicate: Any = None, time_from: int | None = None, time_to: int | None = None) -> tuple[DataFrame, bool]:
        """(event_id, novelty, is_novel), and whether the share of novel rows is an alarm."""
        snap = self.store.snapshot()
        found = self._baselines(snap, tenant)
        if snap.active not in found:
            raise M.EngineError(f"tenant {tenant} has no baseline in the active generation")
        if found[snap.active].state != "ok":
            raise M.EngineError(f"the baseline of tenant {tenant} is degraded: {found[snap.active].reason}")
        df, _ = self._gather(tenant, predicate, time_from, time_to, snap.space(snap.active))
        out = analytics.novelty_against(df, found[snap.active])
        share = out.agg(F.avg(F.col("is_novel").cast("double"))).first()[0] or 0.0
        return out, share > M.FIRE_MULTIPLE * M.FIRE_BASE

    def semantic_diff(self, tenant: str, a: tuple[int, int], b: tuple[int, int], k: int) -> DataFrame:
        """Clusters of window b that window a has nothing near to; windows are [from, to)."""
        da, _ = self._gather(tenant, None, *a)
        db, s = self._gather(tenant, None, *b)
        return analytics.semantic_diff(da, db.select("event_id", "vector", "cost", "error"), k, s)

    def drift_check(self, tenant: str, time_from: int | None = None, time_to: int | None = None) -> DataFrame:
        """Per generation, how much is novel, and what is not watched; the bounds are inclusive."""
        snap = self.store.snapshot()
        df = self.store.read(self.store.prune(snap, tenant, time_from, time_to), snap).filter(F.col("tenant_id") == tenant)
        if time_from is not None:
            df = df.filter(F.col("event_time") >= time_from)
        if time_to is not None:
            df = df.filter(F.col("event_time") <= time_to)
        return analytics.drift(df, self._baselines(snap, tenant))

    def generation_compare(self, queries: list[str], tenant: str, spaces: tuple[str, str], k: int = 10) -> dict[str, float]:
        """Agreement (Jaccard) of the answers of two spaces, and the recall of each against its own exact answer."""
        jaccard, recalls = [], {s: [] for s in spaces}
        for text in queries:
            ids = {}
            for s in spaces:
                ids[s] = {r.event_id for r in self.search(M.Query(text=text, tenant=tenant, k=k, space=s)).rows.select("event_id").collect()}
                exact = {r.event_id for r in self.exact_search(M.Query(text=text, tenant=tenant, k=k, space=s)).rows.select("event_id").collect()}
                recalls[s].append(len(ids[s] & exact) / max(1, len(exact)))
            a, b = ids[spaces[0]], ids[spaces[1]]
            jaccard.append(len(a & b) / max(1, len(a | b)))
        return {"jaccard": float(np.mean(jaccard))} | {f"recall {s}": float(np.mean(r)) for s, r in recalls.items()} | {
            f"recall p1 {s}": float(np.quantile(r, 0.01)) for s, r in recalls.items()
        }

    # Maintenance -------------------------------------------------------------------------------------------------------

    def merge(self) -> Snapshot:
        return maintenance.merge(self.store)

    def merge_tiered(self) -> Snapshot:
        return maintenance.merge_tiered(self.store)

    def delete(self, ids: list[str] | DataFrame) -> int:
        return maintenance.delete(self.store, ids)

    def redact_bodies(self, before_ms: int, reason: str) -> int:
        return maintenance.redact_bodies(self.store, before_ms, reason)

    def reembed(self, embedder: HashEmbedder) -> Snapshot:
        out = maintenance.reembed(self.store, embedder, self._train(embedder))
        self.embedder = embedder
        self.register(embedder)
        return out

    def _train(self, embedder: HashEmbedder) -> Codebook:
        snap, c = self.store.snapshot(), self.store.config
        rows = self.store.read(snap.parts, snap).select("event_id", "tenant_id", "body")
        sample = with_vectors(
            ingest.stratified_sample(rows, TRAINING_ROWS, c["seed"]), embedder
        ).filter("vector is not null").orderBy(F.sha2("event_id", 256), "event_id").toArrow()
        x = np.array(sample.column("vector").combine_chunks().flatten(), np.float32).reshape(sample.num_rows, -1)
        return train(x, c["nlist"], c["pq_m"], c["seed"], c["restarts"])

    def generation_create(self, embedder: HashEmbedder) -> str:
        self.register(embedder)
        return maintenance.create_generation(self.store, embedder.model_id, embedder.version, self._train(embedder))

    def install_generation(self, embedder: HashEmbedder, book: Codebook) -> str:
        self.register(embedder)
        return maintenance.install_generation(self.store, embedder.model_id, embedder.version, book)

    def backup(self, to: str) -> int:
        return maintenance.backup(self.store, to)

    def generation_canary(self, generation: str) -> Snapshot:
        return maintenance.set_state(self.store, generation, "canary")

    def generation_promote(self, generation: str) -> Snapshot:
        return maintenance.set_state(self.store, generation, "active")

    def generation_migrate(self, generation: str, max_parts: int | None = None) -> int:
        space = self.store.snapshot().space(generation)
        return maintenance.migrate(self.store, generation, self.embedders[space], max_parts)

    def generation_retire(self, generation: str) -> Snapshot:
        return maintenance.retire(self.store, generation)

    def migration_status(self) -> dict[str, dict]:
        return maintenance.migration_status(self.store)

    def bridge_declare(self, a: str, b: str, note: str) -> Snapshot:
        return maintenance.declare_bridge(self.store, a, b, note)

    def rollback(self, number: int) -> Snapshot:
        return maintenance.rollback(self.store, number)

    def gc(self, **options: Any) -> dict[str, list[str]]:
        return maintenance.gc(self.store, **options)

    def verify(self) -> list[str]:
        return maintenance.verify(self.store)

    def fsck(self) -> dict[str, list[str]]:
        return maintenance.fsck(self.store)
