"""The driver's contract: queries run at the smallest scale and agree with their SQL."""

import collections
import os
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from semevra import cli
from semevra import queries as Q
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_its_sql(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in Q.ORACLE:
        want = con.execute(Q.ORACLE[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert _plain(rows, df.columns) == _plain(want.fetchall(), columns)
    else:
        assert len(rows) == len({str(r) for r in rows}) > 0


def test_long_event_ids_stay_apart(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").limit(1)
    numbers = [7, 99_999_999, *range(100_000_000, 100_000_012), 2**63 - 1]
    e.crossJoin(spark.createDataFrame([(n,) for n in numbers], "number long")).withColumn("event_id", F.col("number")).drop("number").write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(f"e{n:08d}" for n in numbers)
    for name in ("merge_dedup", "merge_supersede_hash"):
        assert sorted(r.event_id for r in Q.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_every_embedding_finds_its_exact_neighbours(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toArrow()
    x = np.array(t.column("embedding").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
    ids = [f"v{i:08d}" for i in t.column("vec_id").to_pylist()]
    got = collections.defaultdict(dict)
    for r in Q.QUERIES["ivf_pq_topk"](spark, SF).collect():
        got[r.query_id][r.event_id] = r.score
    s = x @ x.T
    want = {q: {ids[j]: s[i, j] for j in np.argsort(-s[i], kind="stable")[:10]} for i, q in enumerate(ids)}
    assert set(got) == set(ids) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(want[q].keys() & got[q].keys()) / 10 for q in ids]) >= 0.9
    assert all(abs(got[q][e] - want[q][e]) < 1e-5 for q in ids for e in want[q].keys() & got[q].keys())


def test_queries_do_not_depend_on_partitioning(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    names = ("agg_sum_avg_min_max", "group_by_two", "topk_ties", "semantic_cluster", "stratified_sample", "idempotency_verdicts")
    want = {n: sorted(map(str, Q.QUERIES[n](spark, SF).collect())) for n in names}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        for n in names:
            assert sorted(map(str, Q.QUERIES[n](spark, SF).collect())) == want[n], n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_entry_works_without_the_other_subpackage(spark, monkeypatch):
    for name in [m for m in sys.modules if m in ("__spark_entry__", "corpus_pipeline") or m.startswith("semevra.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "semevra.llm", None)
    import __spark_entry__ as e

    assert "topk_hybrid" in e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_plans_push_filters_and_prune_columns(spark):
    plan = Q.QUERIES["filter_cmp_matrix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "Exchange" not in plan
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "props" not in schema
    top = Q.QUERIES["topk_hybrid"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top and "Python" not in top


def test_command_line(spark, tmp_path):
    root = (tmp_path / "s").as_uri()
    go = lambda *a: cli.run(spark, ["--root", root, *a])
    go("init", "--dim", "16", "--nlist", "2", "--pq-m", "2")
    (tmp_path / "x.tsv").write_text(
        "event_id\ttenant_id\tevent_time\tevent_name\tcost\terror\tbody\n" + "".join(
            f"e{i}\tt\t{1_760_000_000_000 + i}\tn\t0.5\t0\thello number {i}\n" for i in range(9)
        )
    )
    go("ingest", str(tmp_path / "x.tsv"))
    assert go("sql", "SELECT count(*) FROM events", "--tenant", "t") == [{"count(*)": 9}]
    assert len(go("search", "hello number 3", "--tenant", "t", "--k", "2")) == 2
    assert go("delete", "e1") == [{"deleted": 1}]
    page = go("sql", "SELECT event_id FROM events LIMIT 3", "--tenant", "t")
    assert [r["event_id"] for r in page[:3]] == ["e0", "e2", "e3"] and "next_cursor" in page[3]
    assert go("merge") and go("verify") == [{"wrong": []}] and go("inspect")[0]["rows"] == 8
    assert go("baseline", "--tenant", "t") and go("drift", "--tenant", "t") and len(go("cluster", "--tenant", "t", "--k", "2")) == 3


def test_lists_follow_the_rows(spark, monkeypatch):
    from semevra.operators import search

    assert search.lists_for(2000) == 32 and all(1024 < n / search.lists_for(n) <= 2048 for n in (100_000, 600_000, 5_000_000))
    monkeypatch.setattr(search, "ROWS_OF_LIST", 8)  # many short lists find as much
    test_every_embedding_finds_its_exact_neighbours(spark)
