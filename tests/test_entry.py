import duckdb
import pytest

import __spark_entry__ as E
from conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"
FAST = ["s1_read_table", "e2_normalize_term", "f1_filter_contains", "f3_filter_related_frame",
        "f6_with_row_id", "m3_build_requests", "m5_evaluate_rules", "r4_standardize_verdict",
        "r5_quarantine", "p1_analyze_rules", "p1_analyze_callable"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["row_id", "p_partkey", "p_name", "p_size", "p_brand", "verdict", "notes"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(E.own_queries()) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in E.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _canon(rows):
    out = []
    for r in rows:
        out.append(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    got = _canon(tuple(r[c] for c in cols) for r in sdf.collect())
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = _canon(rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want


def test_analyze_empty_and_log(spark, tmp_out):
    from rowsift.plans import analyze
    review = analyze(spark, SF, "orders", "o_orderpriority", "no such priority", "o_orderkey",
                     scorer=[(1, "o_totalprice", "ge", "0", "x")], out_dir=tmp_out,
                     log_path=f"{tmp_out}/log")
    assert review.result is None and review.rows_kept == 0
    steps = {r.step: r.message for r in spark.read.parquet(f"{tmp_out}/log").collect()}
    assert steps["filter"].startswith("No data found") and "start" in steps


def test_analyze_with_matcher(spark, tmp_out):
    from rowsift.plans import analyze
    from rowsift.plans.reviewers import same_initial
    review = analyze(spark, SF, "events", "event_type", "sale", "event_id",
                     scorer=[(1, "value", "ge", "5", "low value")], out_dir=tmp_out,
                     matcher=same_initial)
    kinds = {r.event_type for r in review.result.select("event_type").distinct().collect()}
    assert kinds == {"signup"}
    assert {"Meets Guidelines", "Notes on Compliance", "row_id"} <= set(review.result.columns)


def test_analyze_callable_logs_rejections(spark, tmp_out):
    from rowsift.plans import analyze

    def picky(prompt):
        if '"row_id":0,' in prompt or '"row_id":0}' in prompt:
            return "no json here"
        return '[{"Meets Guidelines":"False"}]'  # no id, not one per row: nothing merges

    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    review = analyze(spark, SF, "orders", "o_orderpriority", "urgent", "o_orderkey", scorer=picky,
                     out_dir=tmp_out, pages=conv, guideline_doc=0, doc_col="conv_id",
                     page_col="turn", text_col="text", batch=10)
    steps = {e[0]: e for e in review.log.entries}
    assert steps["score"][2] == 1
    assert review.errors.count() == 1
    assert review.result.where("`Meets Guidelines`").count() == 0


def _orders(spark, path, fmt, rename=None):
    from rowsift.sources import write_table
    df = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority")
    write_table(df.withColumnRenamed("o_orderpriority", rename or "o_orderpriority"), path, "orders", format=fmt)


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_analyze_other_formats(spark, tmp_out, fmt):
    from rowsift.plans import analyze
    _orders(spark, tmp_out, fmt)
    review = analyze(spark, tmp_out, "orders", "o_orderpriority", "urgent", "o_orderkey",
                     scorer=E.ORDER_RULES[:1], out_dir=f"{tmp_out}/out", format=fmt)
    want = spark.read.parquet(f"{SF}/orders.parquet").where("lower(o_orderpriority) like '%urgent%'")
    assert review.result.count() == want.count() == review.rows_kept
    assert review.result.where("`Meets Guidelines`").count() == want.where("o_totalprice >= 50000").count()


def test_analyze_dotted_column_and_default(spark, tmp_out):
    from rowsift.plans import analyze
    from rowsift.plans.reviewers import price_reviewer
    _orders(spark, tmp_out, "parquet", "Dx.priority (mg.)")
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    review = analyze(spark, tmp_out, "orders", "Dx.priority (mg.)", "urgent", "o_orderkey", scorer=price_reviewer,
                     out_dir=f"{tmp_out}/out", pages=conv, guideline_doc=0, doc_col="conv_id", page_col="turn")
    assert "Dx.priority (mg.)" in review.result.columns and review.result.where("`Meets Guidelines`").count() > 0
    first = analyze(spark, tmp_out, "orders", None, "1", "o_orderkey", scorer=[], out_dir=f"{tmp_out}/out2")
    assert first.result.where("not contains(cast(o_orderkey as string), '1')").count() == 0


def test_analyze_guards_before_paid_work(spark, tmp_out):
    """Missing pages, an unknown guideline or an unknown order column end the run before the matcher is asked."""
    import os

    from rowsift.plans import analyze

    def matcher(term, values, folder=tmp_out):
        open(os.path.join(folder, "asked"), "w").close()
        return values

    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    args = dict(scorer=lambda p: "[]", out_dir=tmp_out, matcher=matcher, doc_col="conv_id", page_col="turn")
    for more, order in ((dict(), "o_orderkey"), (dict(pages=conv, guideline_doc=-99), "o_orderkey"), (dict(pages=conv, guideline_doc=0), "nope")):
        with pytest.raises(ValueError):
            analyze(spark, SF, "orders", "o_orderpriority", "urgent", order, **args, **more)
    assert not os.path.exists(f"{tmp_out}/asked")


def test_analyze_with_table_matcher_reads_source_twice(spark, tmp_path):
    """Once for the distinct values, whose matches are written, and once by the filter, one scan without a join."""
    from rowsift.operators import distinct_values, filter_related, match_values
    from rowsift.plans import analyze
    related = spark.createDataFrame(E.RELATED, "term string, value string, explanation string")
    events = spark.read.parquet(f"{SF}/events.parquet")
    matches = match_values(distinct_values(events, "event_type", order_by="event_id", limit=None), "purchase", related)
    plan = filter_related(events, "event_type", "purchase", matches)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    review = analyze(spark, SF, "events", "event_type", "purchase", "event_id", scorer=[(1, "value", "ge", "5", "low")],
                     out_dir=str(tmp_path), matcher=related)
    kinds = {r.event_type for r in review.result.select("event_type").distinct().collect()}
    assert kinds == {"purchase", "signup", "click"}


def test_analyze_stray_ids_are_reported(spark, tmp_out):
    from rowsift.plans import analyze

    def stray(prompt):
        return '[{"row_id": 999999, "Meets Guidelines": "True"}]'

    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    review = analyze(spark, SF, "orders", "o_orderpriority", "urgent", "o_orderkey", scorer=stray, out_dir=tmp_out,
                     pages=conv, guideline_doc=0, doc_col="conv_id", page_col="turn", batch=100)
    assert review.result.where("`Meets Guidelines`").count() == 0
    assert {r.reason for r in review.errors.collect()} == {"row id of another request"}
