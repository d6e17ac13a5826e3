"""Maintenance of a store: merge, tiers, delete, redaction, re-embedding, generations, rollback, garbage collection, checks."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semevra.functions.codebook import Codebook
from semevra.functions.embed import HashEmbedder, with_vectors
from semevra.functions.hashing import content_hash
from semevra.model import EngineError
from semevra.operators.ingest import CONTENT
from semevra.sources.store import Snapshot, Store, encode

TIER_BASE, TIER_RATIO, FAN_OUT, MAX_MERGE_ROWS, MAX_OPS = 256, 4, 4, 1_000_000, 16
GC_HORIZON_MS = 2 * 3_600_000


def dedup(df: DataFrame, partition: list[str]) -> DataFrame:
    """One row for each (partition, tenant, event id): the latest event_time, then the larger content hash."""
    w = Window.partitionBy(*partition, "tenant_id", "event_id").orderBy(F.desc("event_time"), F.desc("_h"))
    return df.withColumn("_h", content_hash(CONTENT)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_h")


def _newest(df: DataFrame) -> DataFrame:
    """``dedup`` within a part, where its rows lie: an id that has a row marked ``_dead`` goes, with that row."""
    w = Window.partitionBy("_place", "bucket", "window", "tenant_id", "event_id").orderBy(F.desc("_dead"), F.desc("event_time"), F.desc("_h"))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1 and _dead = 0").drop("_n")


def _rewrite(store: Store, snap: Snapshot, parts: list[dict]) -> list[dict]:
    """Whole rows are shuffled once, to where they are written; deletes are found on ids alone and go along as marks."""
    out: list[dict] = []
    for g, redacted in sorted({(p["generation"], p.get("redacted", False)) for p in parts}):
        own = [p for p in parts if p["generation"] == g and p.get("redacted", False) == redacted]
        read = store.read(own)
        rows = store.restore(read).withColumns({"_h": content_hash(CONTENT), "_dead": F.lit(0)})
        dead = store.dead(read.select("event_id", "tenant_id", "event_time"), snap)
        if dead is not None:
            rows = rows.unionByName(dead.withColumn("_dead", F.lit(1)), allowMissingColumns=True)
        out += store.write_parts(rows, g, redacted, columns=["_h", "_dead"], reduce=_newest)
    return out


def merge(store: Store) -> Snapshot:
    """All parts of each partition into one; deleted rows go for good, and the tombstones with them."""
    snap = store.snapshot()
    return store.commit(snap, parts=_rewrite(store, snap, snap.parts), tombstones=[], tombstone_tables=[]) if snap.parts else snap


def plan_tiers(parts: list[dict]) -> list[list[dict]]:
    """Groups to merge: FAN_OUT parts of one partition and size tier, within the row and operation budgets, one bucket after another."""
    tiers: dict[tuple, list[dict]] = {}
    for p in parts:
        tier, bound = 0, TIER_BASE
        while p["rows"] > bound:
            tier, bound = tier + 1, bound * TIER_RATIO
        tiers.setdefault((p["bucket"], p["window"], p["generation"], p.get("redacted", False), tier), []).append(p)
    by_bucket: dict[int, list[list[dict]]] = {}
    for key in sorted(tiers):
        own = sorted(tiers[key], key=lambda p: (p["rows"], p["path"]))
        for i in range(0, len(own) - FAN_OUT + 1, FAN_OUT):
            by_bucket.setdefault(key[0], []).append(own[i : i + FAN_OUT])
    out: list[list[dict]] = []
    rows = 0
    while by_bucket and len(out) < MAX_OPS:
        for b in sorted(by_bucket):
            group = by_bucket[b].pop(0)
            if not by_bucket[b]:
                del by_bucket[b]
            size = sum(p["rows"] for p in group)
            if rows + size <= MAX_MERGE_ROWS and len(out) < MAX_OPS:
                out.append(group)
                rows += size
    return out


def merge_tiered(store: Store) -> Snapshot:
    """One cycle of size-tiered merges, in one commit; tombstones stay."""
    snap = store.snapshot()
    groups = plan_tiers(snap.parts)
    if not groups:
        return snap
    gone = {p["path"] for g in groups for p in g}
    return store.commit(snap, parts=[p for p in snap.parts if p["path"] not in gone] + _rewrite(store, snap, [p for g in groups for p in g]))


def delete(store: Store, ids: list[str] | DataFrame) -> int:
    """Logical delete; the number of ids that were not deleted before. A list goes into the manifest; a DataFrame (event_id), of
    any size, becomes a table of the store."""
    snap = store.snapshot()
    if isinstance(ids, DataFrame):
        name = f"tombstones/{uuid.uuid4().hex}"
        store.alive(ids.select("event_id").dropna().distinct(), snap).write.parquet(f"{store.root}/{name}")
        n = store.spark.read.parquet(f"{store.root}/{name}").count()
        if n:
            store.commit(snap, tombstone_tables=[*snap.data.get("tombstone_tables", []), name])
        return n
    old = set(snap.tombstones)
    new = set(ids) - old
    if new:
        store.commit(snap, tombstones=sorted(old | new))
    return len(new)


def redact_bodies(store: Store, before_ms: int, reason: str) -> int:
    """Empty, for good, the bodies of the parts that lie wholly before a time; the number of parts rewritten."""
    if not reason.strip():
        raise EngineError("redaction needs a reason")
    snap = store.snapshot()
    old = [p for p in snap.parts if not p.get("redacted") and all(s["hi"] < before_ms for s in p["tenants"].values())]
    parts = [p for p in snap.parts if p not in old]
    for g in sorted({p["generation"] for p in old}):
        rows = store.restore(store.read([p for p in old if p["generation"] == g])).withColumn("body", F.lit(""))
        parts += store.write_parts(rows, g, redacted=True, shuffle=False)
    if old:
        store.commit(snap, parts=parts, redactions=[*snap.data.get("redactions", []), {"before": before_ms, "reason": reason, "parts": len(old)}])
    return len(old)


def reembed(store: Store, embedder: HashEmbedder, book: Codebook) -> Snapshot:
    """The whole store under a new model, in one commit or not at all."""
    snap = store.snapshot()
    if any(p.get("redacted") for p in snap.parts):
        raise EngineError("redacted bodies cannot be embedded again")
    g, entry = store.put_generation(embedder.model_id, embedder.version, book)
    rows = with_vectors(store.restore(store.read(snap.parts)).drop("vector", "centroid", "code"), embedder)
    if rows.filter("vector is null").limit(1).count():
        raise EngineError("some bodies cannot be embedded; nothing was changed")
    states = {k: v | {"state": "deprecated"} if k == snap.active else v for k, v in snap.data["generations"].items()} | {g: entry | {"state": "active"}}
    return store.commit(snap, parts=store.write_parts(encode(rows, book), g), active=g, generations=states)


MOVES = {
    ("candidate", "canary"), ("canary", "active"), ("candidate", "active"), ("active", "deprecated"), ("canary", "deprecated"), ("candidate", "deprecated"),
    ("deprecated", "active")
}


def set_state(store: Store, generation: str, state: str) -> Snapshot:
    """Move a generation along candidate, canary, active, deprecated; promoting one deprecates the active one.

    Promotion to another embedding space is refused while parts remain, unless a bridge joins the two spaces.
    """
    snap = store.snapshot()
    all_ = {k: dict(v) for k, v in snap.data["generations"].items()}
    if generation not in all_:
        raise EngineError(f"unknown generation {generation}")
    if (all_[generation]["state"], state) not in MOVES:
        raise EngineError(f"a generation cannot go from {all_[generation]['state']} to {state}")
    if state == "deprecated" and any(p["generation"] == generation for p in snap.parts) and generation == snap.active:
        raise EngineError("the active generation holds parts; promote another first")
    active = snap.active
    if state == "active":
        if active and active != generation:
            pair = sorted((snap.space(active), snap.space(generation)))
            if pair[0] != pair[1] and snap.parts and not any(x["spaces"] == pair for x in snap.data["bridges"]):
                raise EngineError(f"parts remain in the space {snap.space(active)}; migrate them or declare a bridge to {snap.space(generation)} first")
            all_[active]["state"] = "deprecated"
        active = generation
    all_[generation]["state"] = state
    return store.commit(snap, generations=all_, active=active)


def create_generation(store: Store, model_id: str, version: str, book: Codebook) -> str:
    """Register a codebook as a candidate; the same codebook twice is one generation."""
    snap = store.snapshot()
    g, entry = store.put_generation(model_id, version, book)
    if g not in snap.data["generations"]:
        store.commit(snap, generations=snap.data["generations"] | {g: entry})
    return g


def install_generation(store: Store, model_id: str, version: str, book: Codebook) -> str:
    """Register a shipped codebook and make it active; doing so again changes nothing."""
    g = create_generation(store, model_id, version, book)
    if store.snapshot().active != g:
        set_state(store, g, "active")
    return g


def backup(store: Store, to: str) -> int:
    """Copy the current snapshot (manifest, codebooks, parts) to another root of the same file system or another; a store
    opened there answers alike. Returns the number of parts. Rows are copied by tasks, one job for each write that made parts."""
    snap = store.snapshot()
    target = Store.init(store.spark, to, **store.config)
    for g in snap.data["generations"]:
        target.files.write(f"generations/{g}.json", store.files.read(f"generations/{g}.json"))
    for t in snap.data.get("tombstone_tables", []):
        store.spark.read.parquet(f"{store.root}/{t}").write.parquet(f"{target.root}/{t}")
    runs: dict[str, list[str]] = {}
    for p in snap.parts:
        runs.setdefault(p["path"].rsplit("/", 2)[0], []).append(f"{store.root}/{p['path']}")
    for run, paths in sorted(runs.items()):
        rows = store.spark.read.option("basePath", f"{store.root}/{run}").parquet(*paths)
        rows.sortWithinPartitions("bucket", "window", "centroid", "event_time", "event_id").write.partitionBy("bucket", "window").parquet(f"{target.root}/{run}")
    target.commit(target.snapshot(), **{k: v for k, v in snap.data.items() if k not in ("parent", "id", "at")})
    return len(snap.parts)


def migrate(store: Store, generation: str, embedder: HashEmbedder, max_parts: int | None = None) -> int:
    """Re-embed parts of other generations into ``generation``, partition by partition; the number of parts moved."""
    snap = store.snapshot()
    if generation not in snap.data["generations"]:
        raise EngineError(f"unknown generation {generation}")
    book = store.codebook(generation)
    old = [p for p in snap.parts if p["generation"] != generation and not p.get("redacted")][:max_parts]
    if not old:
        return 0
    rows = with_vectors(store.restore(store.read(old)).drop("vector", "centroid", "code", "generation"), embedder)
    gone = {p["path"] for p in old}
    store.commit(snap, parts=[p for p in snap.parts if p["path"] not in gone] + store.write_parts(encode(rows, book), generation))
    return len(old)


def migration_status(store: Store) -> dict[str, dict]:
    snap = store.snapshot()
    return {
        g: {
            "state": v["state"], "parts": sum(p["generation"] == g for p in snap.parts), "rows": sum(p["rows"] for p in snap.parts if p["generation"] == g)
        } for g, v in snap.data["generations"].items()
    }


def retire(store: Store, generation: str) -> Snapshot:
    """Drop a deprecated generation to which no part of any retained snapshot belongs, so all of them can still be read."""
    snap = store.snapshot()
    g = snap.data["generations"].get(generation)
    if g is None:
        raise EngineError(f"unknown generation {generation}")
    if g["state"] != "deprecated" or any(p["generation"] == generation for p in snap.parts):
        raise EngineError("only a deprecated generation without parts can be retired")
    for name, _ in sorted(store.files.list("snapshots")):
        if name.endswith(".json") and any(p["generation"] == generation for p in store.snapshot(int(name[:10])).parts):
            raise EngineError(f"the retained snapshot {int(name[:10])} has parts of generation {generation}; reclaim it first")
    return store.commit(snap, generations={k: v for k, v in snap.data["generations"].items() if k != generation})


def declare_bridge(store: Store, a: str, b: str, note: str) -> Snapshot:
    """Allow fused answers over two spaces; symmetric, with a note on how it was validated."""
    if not note.strip():
        raise EngineError("a bridge needs a validation note")
    if a == b:
        raise EngineError("a bridge joins two spaces")
    snap = store.snapshot()
    pair = sorted((a, b))
    return store.commit(snap, bridges=[x for x in snap.data["bridges"] if x["spaces"] != pair] + [{"spaces": pair, "note": note}])


def rollback(store: Store, number: int) -> Snapshot:
    """A new snapshot with the contents of an old one."""
    snap, old = store.snapshot(), store.snapshot(number)
    return store.commit(
        snap, parts=old.parts, active=old.active, generations=snap.data["generations"] | old.data["generations"], tombstones=old.tombstones,
        tombstone_tables=old.data.get("tombstone_tables", [])
    )


def gc(store: Store, keep: int = 10, dry_run: bool = False, now_ms: int | None = None) -> dict[str, list[str]]:
    """Reclaim snapshots beyond the newest ``keep`` (and those younger than two hours), and parts that none refers to."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    current = store.snapshot().id
    names = sorted(store.files.list("snapshots"))
    names = [(n, at) for n, at in names if n.endswith(".json")]
    held = {n for n, at in names if now - at < GC_HORIZON_MS} | {n for n, _ in names[-keep:]} | {f"{current:010d}.json"}
    used = {p["path"].split("/")[1] for n in held for p in store.snapshot(int(n[:10])).parts}
    snaps = [n for n, _ in names if n not in held]
    parts = [n for n, at in store.files.list("parts") if n not in used and now - at >= GC_HORIZON_MS]
    tables = {t.split("/")[1] for n in held for t in store.snapshot(int(n[:10])).data.get("tombstone_tables", [])}
    dead = [n for n, at in store.files.list("tombstones") if n not in tables and now - at >= GC_HORIZON_MS]
    if not dry_run:
        for n in dead:
            store.files.delete(f"tombstones/{n}")
        for n in parts:
            store.files.delete(f"parts/{n}")
        for n in snaps:
            store.files.delete(f"snapshots/{n}")
    return {"snapshots": snaps, "parts": parts}


def verify(store: Store) -> list[str]:
    """What is wrong: missing parts, or rows and time ranges that differ from the manifest. One job reads all parts."""
    snap = store.snapshot()
    wrong = [f"{p['path']} is missing" for p in snap.parts if not store.files.exists(p["path"])]
    there = [p for p in snap.parts if store.files.exists(p["path"])]
    if not there:
        return wrong
    rows = store.spark.read.schema("event_time long").parquet(*[f"{store.root}/{p['path']}" for p in there])
    part = F.regexp_extract("_metadata.file_path", r"(parts/[^/]+/bucket=[^/]+/window=[^/]+)/[^/]*$", 1)
    found = rows.groupBy(part.alias("path")).agg(F.count("*").alias("n"), F.min("event_time").alias("lo"), F.max("event_time").alias("hi"))
    got = {r.path: (r.n, r.lo, r.hi) for r in found.collect()}  # one row a part
    for p in there:
        want = (p["rows"], min(s["lo"] for s in p["tenants"].values()), max(s["hi"] for s in p["tenants"].values()))
        if got.get(p["path"]) != want:
            wrong.append(f"{p['path']} has {got.get(p['path'])}, the manifest {want}")
    return wrong


def fsck(store: Store, now_ms: int | None = None) -> dict[str, list[str]]:
    """What the store's folder holds beside what its snapshots name: parts that none refers to, generations without a file,
    snapshots that cannot be read, and temporary files of writers that died. It changes nothing; ``gc`` reclaims."""
    out: dict[str, list[str]] = {"orphans": [], "codebooks": [], "snapshots": [], "temporary": []}
    used: set[str] = set()
    for name, _ in sorted(store.files.list("snapshots")):
        if not name.endswith(".json"):
            out["temporary"].append(f"snapshots/{name}")
            continue
        try:
            data = store.snapshot(int(name[:10])).data
            used |= {p["path"].split("/")[1] for p in data["parts"]}
            out["codebooks"] += [g for g in data["generations"] if not store.files.exists(f"generations/{g}.json") and g not in out["codebooks"]]
        except (ValueError, KeyError):
            out["snapshots"].append(name)
    out["orphans"] = sorted(n for n, _ in store.files.list("parts") if n not in used)
    return out
