"""Data model: schemas, limits, queries and results."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as P

ATTRIBUTE = P.StructType(
    [
        P.StructField("tag", P.ByteType()), P.StructField("s", P.StringType()), P.StructField("i", P.LongType()), P.StructField("d", P.DoubleType()),
        P.StructField("b", P.BooleanType())
    ]
)
STR, INT, DOUBLE, BOOL = 1, 2, 3, 4

EVENT = P.StructType(
    [
        P.StructField("event_id", P.StringType()),
        P.StructField("tenant_id", P.StringType()),
        P.StructField("event_time", P.LongType()),
        P.StructField("observed_time", P.LongType()),
        P.StructField("event_name", P.StringType()),
        P.StructField("cost", P.DoubleType()),
        P.StructField("error", P.BooleanType()),
        P.StructField("body", P.StringType()),
        P.StructField("trace_id", P.StringType()),
        P.StructField("span_id", P.StringType()),
        P.StructField("attributes", P.MapType(P.StringType(), ATTRIBUTE)),
        P.StructField("idempotency_key", P.StringType()),
    ]
)
STAR = ["event_id", "tenant_id", "event_time", "observed_time", "event_name", "cost", "error", "body", "trace_id", "span_id"]
FAMILY = {
    "event_id": "str", "tenant_id": "str", "event_time": "num", "observed_time": "num", "event_name": "str", "cost": "num", "error": "bool", "body": "str",
    "trace_id": "str", "span_id": "str", "score": "num"
}
NUMERIC = {"cost", "event_time", "observed_time", "score"}

NPROBE, CANDIDATES, RERANK, LIMIT = 11, 50, 50, 10
ADAPTIVE_MARGIN, ADAPTIVE_MAX = 0.02, 16
MAX_SEMANTIC_K, CLUSTER_BATCH, CLUSTER_EPOCHS, CLUSTER_RESTARTS = 256, 4096, 15, 5
LOW_CONFIDENCE, STATE_BUDGET = 0.25, 512 << 20
BASELINE_CLUSTERS, BASELINE_QUANTILE, FIRE_MULTIPLE, FIRE_BASE = 16, 0.99, 5.0, 0.01
RRF_CONSTANT = 60

#: Admission limits.
MAX_ID, MAX_TENANT, MAX_NAME, MAX_TRACE, MAX_SPAN, MAX_KEY = 256, 128, 256, 128, 64, 256
MAX_BODY, MAX_ATTRIBUTES, MAX_ATTRIBUTE_KEY, MAX_ATTRIBUTE_VALUE, MAX_ATTRIBUTE_BYTES, MAX_DICTIONARY = 1 << 20, 64, 128, 4096, 16 << 10, 512
LATE_MS, FUTURE_MS = 7 * 86_400_000, 3_600_000
QUOTA_EVENTS, QUOTA_BYTES, QUOTA_WINDOW_MS = 10_000, 32 << 20, 1000
IDEMPOTENCY_MS = 7 * 86_400_000
DAY_MS, BUCKETS = 86_400_000, 16


class EngineError(ValueError):
    """A refusal: the request is not answered, and the message says why."""


@dataclass(frozen=True)
class Query:
    """A hybrid search. Time bounds are inclusive."""

    text: str | None = None
    vector: tuple[float, ...] | None = None
    tenant: str | None = None
    time_from: int | None = None
    time_to: int | None = None
    k: int = LIMIT
    nprobe: int = NPROBE
    candidates: int = CANDIDATES
    rerank: int = RERANK
    group_k: int | None = None
    predicate: Any = None
    space: str | None = None
    adaptive: bool = True
    adaptive_margin: float = ADAPTIVE_MARGIN
    plan: str = "auto"
    threshold: float | None = None
    explain: bool = False
    exact: bool = False
    fetch_budget_bytes: int | None = None


@dataclass
class Explain:
    """What a plan was expected to do and what it did."""

    strategy: str = "interleaved"
    parts_total: int = 0
    parts_pruned: int = 0
    nprobe: int = 0
    lists: list[int] = field(default_factory=list)
    estimated_rows: int = 0
    selectivity: float = 1.0
    estimated_cost: float = 0.0
    candidates: int = 0
    bytes_estimated: int = 0
    cost_micro_dollars: float = 0.0
    parts_scanned: int = 0
    candidates_found: int = 0
    parts_fetched: int = 0
    bytes_fetched: int = 0
    rows_scanned: int = 0
    rows_returned: int = 0
    elapsed_ms: int = 0


@dataclass
class Result:
    """Rows as a DataFrame; the rest as plain values."""

    rows: Any
    snapshot_id: int | None = None
    next_cursor: str | None = None
    explain: Explain | None = None
    clusters: Any = None
    spaces: tuple[str, ...] = ()
    bridged: bool = False
