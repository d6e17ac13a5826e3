"""Readers and writers of events: TSV, JSON lines, OTLP traces of generative-AI spans, and synthetic corpora."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

from semevra.functions.hashing import Random
from semevra.model import BOOL, DOUBLE, EVENT, INT, STR

_NO_ATTRIBUTES = "cast(map() as map<string,struct<tag:tinyint,s:string,i:bigint,d:double,b:boolean>>)"
TSV_COLUMNS = ["event_id", "tenant_id", "event_time", "event_name", "cost", "error", "body"]


def unescape(c: Column) -> Column:
    r"""\\t \\n \\r and \\\\ of a TSV field; a private-use mark keeps escaped backslashes apart meanwhile."""
    mark = ""
    out = F.replace(c, F.lit("\\\\"), F.lit(mark))
    for code, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.replace(out, F.lit(mark), F.lit("\\"))


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for code, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def parse_tsv(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of TSV lines: seven fields; blank lines and a header are skipped; a bad field raises. observed_time is event_time."""
    f = F.split(column, "\t", -1)
    df = lines.filter((F.trim(column) != "") & ~F.col(column).startswith("event_id\t"))
    x = df.select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(TSV_COLUMNS)], F.size(f).alias("fields"))
    bad = lambda what: F.raise_error(F.concat(F.lit(f"bad {what} in TSV line of "), F.coalesce("event_id", F.lit("?"))))
    low = F.lower("error")
    error = F.when(low.isin("1", "true"), True).when(low.isin("0", "false"), False).otherwise(bad("error").cast("boolean"))
    text = {n: unescape(F.col(n)).alias(n) for n in ("event_id", "tenant_id", "event_name", "body")}
    number = lambda n, t: F.coalesce(F.col(n).try_cast(t), bad(n).cast(t)).alias(n)
    time = F.when(F.col("fields") == 7, F.col("event_time").try_cast("long"))
    return x.select(
        text["event_id"], text["tenant_id"], F.coalesce(
            time, bad("field count or event_time").cast("long")
        ).alias("event_time"), time.alias("observed_time"), text["event_name"], number("cost", "double"), error.alias("error"), text["body"],
        F.lit("").alias("trace_id"), F.lit("").alias("span_id"), F.expr(_NO_ATTRIBUTES).alias("attributes"), F.lit(None).cast("string").alias("idempotency_key"),
    )


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return parse_tsv(spark.read.text(path, lineSep="\n"))


def tsv_lines(events: DataFrame) -> DataFrame:
    """One TSV line (value) a row."""
    cost = F.col("cost").cast("string")
    fields = [
        escape(F.col("event_id")), escape(F.col("tenant_id")), F.col("event_time").cast("string"), escape(F.col("event_name")), cost,
        F.when(F.col("error"), "1").otherwise("0"), escape(F.col("body"))
    ]
    return events.select(F.concat_ws("\t", *fields).alias("value"))


def write_tsv(events: DataFrame, path: str) -> None:
    tsv_lines(events).write.text(path)


#: The JSON form of an event: attribute values are {"type": ..., "value": ...}.
JSON_EVENT = P.StructType(
    [
        *[f for f in EVENT.fields if f.name != "attributes"],
        P.StructField("attributes", P.MapType(P.StringType(), P.StructType([P.StructField("type", P.StringType()), P.StructField("value", P.StringType())])))
    ]
)


def _tagged(kind: Column, value: Column) -> Column:
    return F.struct(
        F.when(kind == "str", STR).when(kind == "int", INT).when(kind == "double", DOUBLE).when(kind == "bool", BOOL).cast("byte").alias("tag"),
        F.when(kind == "str", value).alias("s"),
        F.when(kind == "int", value.try_cast("long")).alias("i"),
        F.when(kind == "double", value.try_cast("double")).alias("d"),
        F.when(kind == "bool", value.try_cast("boolean")).alias("b"),
    )


def parse_jsonl(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines; a line that does not parse raises, blank ones are skipped. Works on batches and streams."""
    j = F.from_json(column, JSON_EVENT, {"mode": "FAILFAST"}).alias("j")
    df = lines.filter(F.trim(column) != "").select(j)
    attributes = F.coalesce(F.transform_values("j.attributes", lambda _, v: _tagged(v["type"], v["value"])), F.expr(_NO_ATTRIBUTES))
    cols = {f.name: F.col(f"j.{f.name}") for f in EVENT.fields if f.name != "attributes"}
    cols["attributes"] = attributes
    for n in ("trace_id", "span_id"):
        cols[n] = F.coalesce(cols[n], F.lit(""))
    cols["observed_time"] = F.coalesce(cols["observed_time"], cols["event_time"])
    return df.select(*[cols[f.name].alias(f.name) for f in EVENT.fields])


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_jsonl(spark.read.text(path))


def stream_jsonl(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """The same as a stream; the checkpoint of the query holds the committed offset."""
    return parse_jsonl(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path))


_VALUE = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string>"
_PAIRS = f"array<struct<key:string,value:{_VALUE}>>"
OTLP = f"resourceSpans array<struct<resource:struct<attributes:{_PAIRS}>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,name:string,startTimeUnixNano:string,attributes:{_PAIRS},status:struct<code:string>>>>>>>"
TENANT_KEYS = ("tenant.id", "service.namespace")
PROMPT_KEYS, COMPLETION_KEYS, COST_KEYS = ("gen_ai.prompt", "gen_ai.input.messages"), ("gen_ai.completion", "gen_ai.output.messages"), ("gen_ai.usage.cost", "gen_ai.cost")


def _find(pairs: Column, keys: tuple[str, ...]) -> Column:
    """The value, as text, of the first of ``keys`` that is there."""

    def one(key: str) -> Column:
        own = F.filter(pairs, lambda p: p["key"] == key)
        text = F.transform(own, lambda p: F.coalesce(p["value"]["stringValue"], p["value"]["intValue"], p["value"]["doubleValue"]))
        return F.when(F.size(own) > 0, F.get(text, F.lit(0)))

    return F.coalesce(*[one(k) for k in keys])


def parse_otlp(payloads: DataFrame, tenant: str, now_ms: int, column: str = "value") -> DataFrame:
    """Events of OTLP/JSON trace payloads: one for each span that has a prompt or a completion.

    The body is prompt, newline, completion, trimmed. The span id is the event id and the idempotency key; a span without
    one raises. An error is status 2 or STATUS_CODE_ERROR. Integers may arrive as texts or numbers. Attribute values of
    other kinds are dropped. Without a start time the event is of ``now_ms``.
    """
    j = payloads.select(F.from_json(column, OTLP, {"mode": "FAILFAST"}).alias("j"))
    r = j.select(F.explode("j.resourceSpans").alias("r"))
    empty = F.array().cast(_PAIRS)
    s = r.select(F.coalesce("r.resource.attributes", empty).alias("ra"), F.explode("r.scopeSpans").alias("ss")).select("ra", F.explode("ss.spans").alias("s"))
    s = s.withColumn("a", F.coalesce("s.attributes", empty))
    s = s.withColumns({"prompt": _find(F.col("a"), PROMPT_KEYS), "completion": _find(F.col("a"), COMPLETION_KEYS)}).filter("prompt is not null or completion is not null")
    body = F.trim(F.concat(F.coalesce("prompt", F.lit("")), F.lit("\n"), F.coalesce("completion", F.lit(""))))
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    v = lambda p: p["value"]
    known = F.filter(
        "a", lambda p: ~p["key"].isin(*PROMPT_KEYS, *COMPLETION_KEYS) & (
            v(p)["stringValue"].isNotNull() | v(p)["intValue"].isNotNull() | v(p)["doubleValue"].isNotNull() | v(p)["boolValue"].isNotNull()
        )
    )
    kind = lambda p: F.when(v(p)["stringValue"].isNotNull(), "str").when(v(p)["intValue"].isNotNull(), "int").when(v(p)["doubleValue"].isNotNull(), "double").otherwise("bool")
    value = lambda p: F.coalesce(v(p)["stringValue"], v(p)["intValue"], v(p)["doubleValue"], v(p)["boolValue"])
    # The last of equal keys counts.
    last = F.filter(known, lambda p, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda r: r["key"] == p["key"]))
    attributes = F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], _tagged(kind(p), value(p)))))
    span = F.when(F.coalesce(F.length("s.spanId"), F.lit(0)) > 0, F.col("s.spanId")).otherwise(F.raise_error(F.lit("span without spanId")).cast("string"))
    time = F.coalesce((F.col("s.startTimeUnixNano").try_cast("decimal(20,0)") / 1_000_000).cast("long"), F.lit(now_ms).cast("long"))
    return s.select(
        span.alias("event_id"), F.coalesce(
            _find(F.col("ra"), TENANT_KEYS), F.lit(tenant)
        ).alias("tenant_id"), time.alias("event_time"), F.lit(now_ms).cast("long").alias("observed_time"), F.col("s.name").alias("event_name"),
        F.coalesce(_find(F.col("a"), COST_KEYS).try_cast("double"), F.lit(0.0)).alias("cost"), F.coalesce(
            F.col("s.status.code").isin("2", "STATUS_CODE_ERROR"), F.lit(False)
        ).alias("error"), body.alias("body"),
        F.coalesce("s.traceId", F.lit("")).alias("trace_id"), span.alias("span_id"), attributes.alias("attributes"), span.alias("idempotency_key"),
    )


_TOPICS = ["refund payment", "login failure", "latency spike", "export report", "model answer", "search index", "invoice tax", "deploy rollback"]
_PHRASES = ["customer asks about {}", "agent resolved {} quickly", "{} needs escalation", "unclear message on {}"]


def corpus(spark: SparkSession, n: int, kind: str = "zipf", seed: int = 1234) -> DataFrame:
    """A synthetic corpus for tests: uniform, zipf, tenant-skew, late, duplicates or edge; the seed decides all of it."""
    rng = Random(seed)
    rows = []
    weights = np.array([1 / (i + 1) if kind == "zipf" else 1.0 for i in range(len(_TOPICS))])
    steps = np.cumsum(weights / weights.sum())
    for i in range(n):
        topic = _TOPICS[min(int(np.searchsorted(steps, rng.float())), len(_TOPICS) - 1)]
        body = f"{_PHRASES[rng.below(4)].format(topic)} case {rng.below(6)}"
        tenant = "acme" if kind == "tenant-skew" and rng.float() < 0.9 else f"t{rng.below(5)}"
        at = 1_760_000_000_000 + i * 1000
        name = f"e{i // 3 * 3 if kind == 'duplicates' and i % 3 == 2 else i:08d}"
        if kind == "late" and i % 3 == 2:
            at -= rng.below(71 * 3_600_000)
        if kind == "edge":
            body = [body, " \t ", "!!!", "x" * (1 << 20) + "y"][i % 4]
        rows.append((name, tenant, at, at, "agent.turn", round(rng.float() * 0.05, 6), rng.float() < 0.12, body, "", "", {}, None))
    return spark.createDataFrame(rows, EVENT)


def cluster_corpus(spark: SparkSession, n: int, shape: str = "balanced", seed: int = 9, clusters: int = 8, novel: int = 0) -> DataFrame:
    """Labelled bodies (the label is event_name): balanced, zipf, overlap or noise; ``novel`` rows more of unseen classes nv0, nv1."""
    rng = Random(seed)
    vocabulary = [[f"w{c}x{j}" for j in range(6)] for c in range(clusters)]
    shared = [f"common{j}" for j in range(6)]
    steps = np.cumsum([1 / (i + 1) for i in range(clusters)])
    rows = []
    for i in range(n):
        c = i % clusters if shape != "zipf" else min(int(np.searchsorted(steps, rng.float() * steps[-1])), clusters - 1)
        if shape == "noise":
            words = [f"n{rng.below(100_000)}" for _ in range(5)]
        else:
            words = [vocabulary[c][rng.below(6)] if shape != "overlap" or rng.float() < 0.8 else shared[rng.below(6)] for _ in range(5)]
        rows.append((f"e{i:08d}", "alpha", 1_760_000_000_000 + i, 1_760_000_000_000 + i, "noise" if shape == "noise" else f"c{c}", 0.01, False, " ".join(words), "", "", {}, None))
    for i in range(novel):
        c = i % 2
        rows.append(
            (
                f"nv{c}_{i}", "alpha", 1_770_000_000_000 + i, 1_770_000_000_000 + i, f"nv{c}", 0.01, False, " ".join(f"v{c}q{rng.below(4)}" for _ in range(3)),
                "", "", {}, None
            )
        )
    return spark.createDataFrame(rows, EVENT)
