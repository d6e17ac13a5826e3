"""Admission: validation, lateness, the key dictionary, quotas, idempotency. Rejected rows carry a stable reason."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semevra import model as M
from semevra.functions.hashing import content_hash


def _bytes(name: str) -> Column:
    return F.coalesce(F.octet_length(name), F.lit(0))


def _value_bytes(v: Column) -> Column:
    return F.when(v["tag"] == M.STR, F.octet_length(v["s"])).when(v["tag"] == M.BOOL, F.lit(1)).otherwise(F.lit(8))


def validation_reason(now_ms: int) -> Column:
    """The first rule that a row breaks, or null."""
    a = F.coalesce(F.col("attributes"), F.create_map().cast(M.EVENT["attributes"].dataType))
    values = F.map_values(a)
    total = F.aggregate(F.map_entries(a), F.lit(0), lambda s, e: s + F.octet_length(e["key"]) + F.coalesce(_value_bytes(e["value"]), F.lit(0)))
    rules = [
        (_bytes("event_id") == 0, "missing_event_id"),
        (_bytes("tenant_id") == 0, "missing_tenant_id"),
        (
            F.greatest(
                _bytes("event_id") - M.MAX_ID, _bytes("tenant_id") - M.MAX_TENANT, _bytes("event_name") - M.MAX_NAME, _bytes("trace_id") - M.MAX_TRACE,
                _bytes("span_id") - M.MAX_SPAN, _bytes("idempotency_key") - M.MAX_KEY
            ) > 0,
            "invalid_identifier"
        ),
        (_bytes("event_name") == 0, "invalid_identifier"),
        (F.col("cost").isNull() | F.isnan("cost") | (F.col("cost") < 0) | (F.col("cost") == float("inf")), "invalid_cost"),
        (_bytes("body") > M.MAX_BODY, "body_too_large"),
        (F.length(F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+", " "))) == 0, "empty_body"),
        (F.size(a) > M.MAX_ATTRIBUTES, "too_many_attribute_keys"),
        (F.exists(F.map_keys(a), lambda k: F.octet_length(k) > M.MAX_ATTRIBUTE_KEY), "attribute_key_too_long"),
        (F.exists(values, lambda v: _value_bytes(v) > M.MAX_ATTRIBUTE_VALUE), "attribute_value_too_long"),
        (total > M.MAX_ATTRIBUTE_BYTES, "attributes_too_large"),
        (F.lit(now_ms) - F.col("event_time") > M.LATE_MS, "event_time_too_late"),
        (F.col("event_time") - F.lit(now_ms) > M.FUTURE_MS, "event_time_in_future"),
    ]
    out = F.when(rules[0][0], rules[0][1])
    for test, reason in rules[1:]:
        out = out.when(test, reason)
    return out


def fair_order(df: DataFrame, seq: str = "seq") -> DataFrame:
    """``df`` with turn: round-robin over tenants, in tenant order within a round."""
    w = Window.partitionBy("tenant_id").orderBy(seq)
    return df.withColumn("turn", F.row_number().over(w)).orderBy("turn", "tenant_id")


def quota(df: DataFrame, arrival: str = "arrival_ms", seq: str = "seq", events: int = M.QUOTA_EVENTS, size: int = M.QUOTA_BYTES, window: int = M.QUOTA_WINDOW_MS) -> DataFrame:
    """``df`` with over_quota, per tenant: fixed windows from a tenant's first use. What is rejected is not charged, so the choice is
    greedy, in order; one group is a tenant's batch, of which only times, numbers and sizes meet in a task. ``seq`` is unique
    within a tenant."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([arrival, seq], kind="stable").reset_index(drop=True)
        start, n, held, over = None, 0, 0, []
        for at, b in zip(pdf[arrival], pdf["bytes_"]):
            if start is None or at - start >= window:
                start, n, held = at, 0, 0
            bad = n + 1 > events or held + b > size
            over.append(bad)
            if not bad:
                n, held = n + 1, held + b
        pdf = pdf.assign(over=over)
        return pdf[pdf["over"]][["tenant_id", seq]]

    narrow = df.select("tenant_id", arrival, seq, _bytes("body").cast("long").alias("bytes_"))
    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in ("tenant_id", seq))
    over = narrow.groupBy("tenant_id").applyInPandas(run, schema).withColumn("over_quota", F.lit(True))
    return df.join(over, ["tenant_id", seq], "left").withColumn("over_quota", F.coalesce("over_quota", F.lit(False)))


def key_dictionary(df: DataFrame, known: list[str], turn: list[str], limit: int = M.MAX_DICTIONARY) -> DataFrame:
    """``df`` with over_dictionary: the row brings attribute keys that no longer fit the store's dictionary.

    Keys are taken in order until it is full. A set of new keys that did not fit once never fits later (room shrinks at
    least as fast as the set), so the first row with each set decides for all; only distinct sets meet in one task.
    """
    fresh = F.array_except(F.map_keys("attributes"), F.array(*[F.lit(k) for k in known]) if known else F.array().cast("array<string>"))
    d = df.withColumn("_keys", F.sort_array(F.coalesce(fresh, F.array().cast("array<string>"))))
    sets = d.filter("size(_keys) > 0").groupBy("_keys").agg(F.min(F.struct(*turn)).alias("_first")).withColumn("_all", F.lit(1))
    room = limit - len(known)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(o=[tuple(f.values()) for f in pdf["_first"]]).sort_values("o", kind="stable")
        seen: set[str] = set()
        over = []
        for keys in pdf["_keys"]:
            more = set(keys) - seen
            bad = len(seen) + len(more) > room
            over.append(bad)
            if not bad:
                seen |= more
        return pdf[["_keys"]].assign(over=over)

    judged = sets.groupBy("_all").applyInPandas(run, "_keys array<string>, over boolean").filter("over")
    return d.join(judged, "_keys", "left").withColumn("over_dictionary", F.coalesce("over", F.lit(False))).drop("_keys", "over")


CONTENT = ["tenant_id", "event_time", "event_name", "cost", "error", "body", "trace_id", "span_id", "attributes"]



def idempotency(batch: DataFrame, seen: DataFrame | None, seq: str = "seq") -> DataFrame:
    """``batch`` with verdict: new, replay (same content: suppressed) or conflict (other content: rejected).

    Keys are (tenant, idempotency key or event id). ``seen`` has (tenant_id, key, hash) of earlier batches within the
    window. In one batch the first row in order counts as seen by the later ones.
    """
    b = batch.withColumns({"key": F.coalesce("idempotency_key", "event_id"), "hash": content_hash(CONTENT)})
    w = Window.partitionBy("tenant_id", "key").orderBy(seq)
    if seen is not None:
        b = b.join(seen.select("tenant_id", "key", F.col("hash").alias("old")), ["tenant_id", "key"], "left")
    else:
        b = b.withColumn("old", F.lit(None).cast("string"))
    first = F.coalesce("old", F.first("hash").over(w))
    fresh = F.col("old").isNull() & (F.row_number().over(w) == 1)
    return b.withColumn("verdict", F.when(fresh, "new").when(F.col("hash") == first, "replay").otherwise("conflict")).drop("old")


def preflight(df: DataFrame, grants: DataFrame, model: str, purpose: str = "ingest", seq: str = "seq") -> DataFrame:
    """``df`` with denied: the tenant has no grant for the model and purpose, or its budget of events is spent by earlier rows.

    grants: (tenant_id, model, purpose, budget); a null budget is unlimited. Tenants are few, so the grants are broadcast
    while they are below Spark's own limit.
    """
    g = grants.filter((F.col("model") == model) & (F.col("purpose") == purpose)).groupBy("tenant_id").agg(F.max(F.coalesce("budget", F.lit((1 << 62)))).alias("_budget"))
    d = df.join(g, "tenant_id", "left").withColumn("_n", F.row_number().over(Window.partitionBy("tenant_id").orderBy(seq)))
    return d.withColumn("denied", F.col("_budget").isNull() | (F.col("_n") > F.col("_budget"))).drop("_budget", "_n")


def admit(
    df: DataFrame, now_ms: int, seen: DataFrame | None = None, known_keys: list[str] | None = None, seq: str = "seq", grants: DataFrame | None = None,
    model: str = ""
) -> DataFrame:
    """``df`` (events and a sequence number) with observed_time stamped, and reason (null: admitted; 'replay': suppressed).

    Order of the checks: validation, lateness, key dictionary, quota, idempotency, and the model's grants if any are given;
    the first that fails names the reason.
    """
    d = df.withColumn("observed_time", F.lit(now_ms).cast("long")).withColumn("reason", validation_reason(now_ms))
    good = d.filter("reason is null").withColumn("arrival_ms", F.lit(now_ms).cast("long"))
    turns = good.withColumn("turn", F.row_number().over(Window.partitionBy("tenant_id").orderBy(seq)))
    turns = key_dictionary(turns, known_keys or [], ["turn", "tenant_id"])
    late = turns.filter("over_dictionary").withColumn("reason", F.lit("attribute_key_cardinality_exceeded"))
    charged = quota(turns.filter("not over_dictionary").drop("over_dictionary"), seq="turn")
    spent = charged.filter("over_quota").withColumn("reason", F.lit("quota_exceeded"))
    judged = idempotency(charged.filter("not over_quota").drop("over_quota"), seen, seq)
    judged = judged.withColumn("reason", F.when(F.col("verdict") == "conflict", "idempotency_conflict").when(F.col("verdict") == "replay", "replay"))
    if grants is not None:
        fresh = preflight(judged.filter("reason is null"), grants, model, seq=seq)
        fresh = fresh.withColumn("reason", F.when(F.col("denied"), "model_policy_denied")).drop("denied")
        judged = judged.filter("reason is not null").unionByName(fresh.select(*judged.columns))
    columns = [*df.columns, "reason"] if "observed_time" in df.columns else [*df.columns, "observed_time", "reason"]
    out = d.filter("reason is not null").select(*columns)
    for part in (late, spent, judged):
        out = out.unionByName(part.select(*columns))
    return out


#: Standard deviations by which the bound on tickets lies above what a quota needs.
SPARE = 8


def stratified_sample(df: DataFrame, size: int, seed: int, stratum: str = "tenant_id", id_col: str = "event_id") -> DataFrame:
    """Bottom-k sample by SHA-256 ticket in each stratum: a floor of size/4 shared equally, the rest in proportion by largest remainder.

    Quotas need one row a stratum on the driver; rows are never collected.
    """
    counts = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    total, names = sum(counts.values()), sorted(counts)
    if total <= size:
        return df
    floor = size // 4 // max(1, len(names))
    got = {s: min(counts[s], floor) for s in names}
    left = size - sum(got.values())
    rest = {s: counts[s] - got[s] for s in names}
    spare = max(1, sum(rest.values()))
    share = {s: left * rest[s] / spare for s in names}
    for s in names:
        got[s] += int(share[s])
    for s in sorted(names, key=lambda s: (-(share[s] - int(share[s])), s))[: size - sum(got.values())]:
        got[s] += 1
    # Tickets are uniform, so the rows of a stratum's quota lie below a bound on the first 8 digits; only what does is sorted.
    bounds = {s: min(1 << 32, int((got[s] + SPARE * (got[s] ** 0.5 + SPARE)) / counts[s] * 2**32) + 1) for s in names}
    ticketed = df.withColumn("ticket", F.sha2(F.concat(F.lit(str(seed)), F.lit("|"), F.col(id_col)), 256))
    quotas = df.sparkSession.createDataFrame([(s, got[s], f"{bounds[s]:09x}") for s in names], f"`{stratum}` string, quota int, below string")
    low = ticketed.join(F.broadcast(quotas), stratum).filter(F.concat(F.lit("0"), F.substring("ticket", 1, 8)) < F.col("below"))
    enough = {r[0]: r[1] for r in low.groupBy(stratum).count().collect()}
    if any(enough.get(s, 0) < got[s] for s in names):  # many rows share an id, and so a ticket
        low = ticketed.join(F.broadcast(quotas), stratum)
    w = Window.partitionBy(stratum).orderBy("ticket", id_col)
    return low.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.col("quota")).drop("ticket", "place", "quota", "below")
