"""Plan shape: the columnar operators stay in one scan stage, in generated
code, with no shuffle and no Python."""

from pyspark.sql import functions as F

from conftest import TESTDATA
from rowsift.functions import extract_json, verdict
from rowsift.operators import evaluate_rules, filter_any_term, filter_contains, filter_related

SF = f"{TESTDATA}/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _assert_narrow(df):
    plan = _plan(df)
    assert "Exchange" not in plan, plan
    assert "Python" not in plan and "ArrowEval" not in plan, plan


def test_f1_f2_f3_narrow_and_pruned(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    for df in (filter_contains(part, "p_name", "widget|bolt").select("p_partkey"),
               filter_any_term(part, "p_name", ["bolt", "ring"]).select("p_partkey"),
               filter_related(part, "p_name", "small", ["ring"]).select("p_partkey")):
        _assert_narrow(df)
        plan = _plan(df)
        assert "WholeStageCodegen" in plan or "*(" in plan
        assert "p_brand" not in plan  # column pruning reached the scan


def test_m5_and_r4_narrow(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    _assert_narrow(evaluate_rules(li, [(1, "l_quantity", "ge", "10", "q")]))
    c = spark.read.parquet(f"{SF}/customer.parquet")
    reply = F.concat(F.lit('[{"Meets Guidelines":"'), F.col("c_mktsegment"), F.lit('"}]'))
    v = F.try_parse_json(extract_json(reply))
    _assert_narrow(c.select(verdict(F.try_variant_get(v, "$[0]", "variant"))))


def test_scorer_and_matcher_spread_over_tasks(spark):
    """Requests grouped by batch id (and values grouped by value) must still
    reach the callable in many tasks: a hash repartition on the grouping key
    would be dropped and AQE would pack the few bytes into one task."""
    from rowsift.operators import (build_requests, distinct_values, match_values,
                                   render_records, score_requests, with_row_id)
    from rowsift.plans.reviewers import length_scorer, same_initial

    c = spark.read.parquet(f"{SF}/customer.parquet")
    kept = with_row_id(c, "c_custkey")
    req = build_requests(render_records(kept), "g", "t", "c_name", batch=5)
    plan = _plan(req)
    assert "REPARTITION_BY_NUM" in plan and "RoundRobinPartitioning" in plan, plan
    wide = build_requests(render_records(kept), "g", "t", "c_name", batch=5, partitions=4)
    assert wide.rdd.getNumPartitions() == 4
    scored = score_requests(wide, length_scorer)
    assert scored.count() == wide.count() and "FileScan" in _plan(scored)  # written, then read
    vals = distinct_values(c, "c_mktsegment", order_by="c_custkey", limit=None)
    assert "FileScan" in _plan(match_values(vals, "b", same_initial, partitions=3))


def test_no_prompt_text_is_exchanged(spark):
    """The guideline joins the records above the exchange that deals them out."""
    from rowsift.operators import build_requests, render_records, with_row_id

    c = spark.read.parquet(f"{SF}/customer.parquet")
    plan = _plan(build_requests(render_records(with_row_id(c, "c_custkey")), "GUIDETEXT", "t", "c_name", batch=5))
    assert "GUIDETEXT" in plan
    at = plan.index("RoundRobinPartitioning")
    assert "GUIDETEXT" in plan[:at] and "GUIDETEXT" not in plan[at:], plan


def test_long_lists_run_in_the_jvm(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    for n in (5, 40, 400):
        plan = _plan(filter_any_term(part, "p_name", [f"term{i}" for i in range(n)]))
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_containment_join_keeps_texts_in_scan_tasks(spark):
    """Large term sets: candidates are broadcast after being measured, and the
    rows are verified by a LeftSemi hash join on the text hash with the
    contains test as its condition; the texts are not shuffled."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("text").alias("value"))
    out = filter_any_term(docs, "text", bench, max_list_values=0).select("doc_id")
    plan = _plan(out)
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan, plan
    assert "Contains(lower(text" in plan, plan
    assert "Exchange hashpartitioning" not in plan and "CartesianProduct" not in plan, plan
    assert "NestedLoop" not in plan, plan


def test_f3_large_match_set_scans_rows_once(spark):
    """F3 with a match DataFrame beyond the inline bound: the term filter and
    the containment test are one filter (EXISTS as an ExistenceJoin), not a
    union of two scans."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("text").alias("value"))
    out = filter_related(docs, "text", "zzz", bench, max_list_values=0).select("doc_id")
    plan = _plan(out)
    assert "ExistenceJoin" in plan and "Union" not in plan, plan
    assert plan.count("documents.parquet") == 1, plan
