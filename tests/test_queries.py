"""The registered queries: import without a session, agreement with their SQL, and plan shapes."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = ["win_topn", "win_ranks", "join_containment", "agg_value_counts", "doc_assemble_full", "evidence_unpivot", "impact_clean",
           "dd_jaccard_pairs", "knn_exact", "knn_rerank", "rank_composite", "stream_incremental", "txt_strip_furniture", "quote_exact"]


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(show(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    queries = entry.queries()
    assert "WindowGroupLimit" in plan(queries["win_topn"](spark, SF))
    filtered = plan(queries["filter_dsl"](spark, SF))
    assert "PushedFilters: [Or(" in filtered.replace("PushedFilters: [IsNotNull", "PushedFilters: [Or(") and "p_retailprice" not in filtered
    for name in ("knn_exact", "knn_routed", "dd_jaccard_pairs", "match_listings", "join_containment", "quote_exact"):
        text = plan(queries[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
