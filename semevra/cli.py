"""A thin command line: ``python -m semevra.cli --root DIR command ...``; answers are JSON lines."""

from __future__ import annotations

import argparse
import json

from semevra import model as M
from semevra.engine import Engine
from semevra.sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="semevra")
    p.add_argument("--root", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init")
    for name, default in (("dim", 64), ("nlist", 32), ("pq-m", 8), ("seed", 42)):
        c.add_argument(f"--{name}", type=int, default=default)
    c = sub.add_parser("ingest")
    c.add_argument("path")
    c.add_argument("--format", choices=("tsv", "jsonl", "otlp"), default="tsv")
    c.add_argument("--tenant", default="default")
    c.add_argument("--admit", action="store_true", help="with lateness, quota and idempotency checks")
    c = sub.add_parser("sql")
    c.add_argument("text")
    c.add_argument("--tenant", required=True)
    c.add_argument("--cursor")
    c = sub.add_parser("search")
    c.add_argument("text")
    c.add_argument("--tenant")
    c.add_argument("--k", type=int, default=M.LIMIT)
    c.add_argument("--nprobe", type=int, default=M.NPROBE)
    c.add_argument("--threshold", type=float)
    c.add_argument("--exact", action="store_true")
    c = sub.add_parser("cluster")
    c.add_argument("--tenant", required=True)
    c.add_argument("--k", type=int, required=True)
    for name in ("baseline", "drift"):
        sub.add_parser(name).add_argument("--tenant", required=True)
    c = sub.add_parser("delete")
    c.add_argument("ids", nargs="+")
    c = sub.add_parser("redact")
    c.add_argument("--before", type=int, required=True)
    c.add_argument("--reason", required=True)
    c = sub.add_parser("rollback")
    c.add_argument("snapshot", type=int)
    c = sub.add_parser("gc")
    c.add_argument("--keep", type=int, default=10)
    c.add_argument("--dry-run", action="store_true")
    c = sub.add_parser("bridge")
    c.add_argument("a")
    c.add_argument("b")
    c.add_argument("--note", required=True)
    for name in ("merge", "merge-tiered", "verify", "inspect", "generations"):
        sub.add_parser(name)
    return p


def run(spark, argv: list[str]) -> list:
    """Values to print, one a line."""
    a = parser().parse_args(argv)
    if a.command == "init":
        Engine.init(spark, a.root, dim=a.dim, nlist=a.nlist, pq_m=a.pq_m, seed=a.seed)
        return [{"store": a.root}]
    e = Engine(spark, a.root)
    rows = lambda df: [r.asDict(True) for r in df.drop("vector", "code").toLocalIterator()]
    if a.command == "ingest":
        if a.format == "otlp":
            import time

            df = readers.parse_otlp(spark.read.text(a.path, wholetext=True), a.tenant, int(time.time() * 1000))
        else:
            df = (readers.read_tsv if a.format == "tsv" else readers.read_jsonl)(spark, a.path)
        return [e.admit_and_ingest(df) if a.admit else {"snapshot": e.ingest(df).id}]
    if a.command == "sql":
        r = e.sql(a.text, a.tenant, a.cursor)
        return rows(r.rows) + ([{"next_cursor": r.next_cursor}] if r.next_cursor else [])
    if a.command == "search":
        return rows(e.search(M.Query(text=a.text, tenant=a.tenant, k=a.k, nprobe=a.nprobe, threshold=a.threshold, exact=a.exact)).rows)
    if a.command == "cluster":
        c = e.semantic_cluster(a.tenant, a.k)
        return rows(c.summary) + [{"quality": c.quality, "confidence": c.confidence}]
    if a.command == "baseline":
        return [{"baseline": e.baseline_build(a.tenant).id}]
    if a.command == "drift":
        return rows(e.drift_check(a.tenant))
    if a.command == "delete":
        return [{"deleted": e.delete(a.ids)}]
    if a.command == "redact":
        return [{"parts": e.redact_bodies(a.before, a.reason)}]
    if a.command == "rollback":
        return [{"snapshot": e.rollback(a.snapshot).id}]
    if a.command == "gc":
        return [e.gc(keep=a.keep, dry_run=a.dry_run)]
    if a.command == "bridge":
        return [{"snapshot": e.bridge_declare(a.a, a.b, a.note).id}]
    if a.command == "merge":
        return [{"snapshot": e.merge().id}]
    if a.command == "merge-tiered":
        return [{"snapshot": e.merge_tiered().id}]
    if a.command == "verify":
        return [{"wrong": e.verify()}]
    if a.command == "generations":
        return [e.migration_status()]
    snap = e.snapshot()
    return [{"snapshot": snap.id, "parts": len(snap.parts), "rows": sum(p["rows"] for p in snap.parts), "active": snap.active, "tombstones": len(snap.tombstones)}]


def main() -> None:
    import sys

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for x in run(spark, sys.argv[1:]):
        print(json.dumps(x, default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
