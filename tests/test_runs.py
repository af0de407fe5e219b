"""Runs that are taken up again, and what a run leaves behind."""

import functools
import os
import sys
import uuid

import pytest

import __spark_entry__ as E
from conftest import TESTDATA
from rowsift.operators.replystore import ROUNDS
from rowsift.plans import Run, analyze
from rowsift.session import Scratch, written
from rowsift.streaming import append_batch, review_stream_append

SF = f"{TESTDATA}/sf0.001"


def _files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)


def _reviewer(folder):
    def review(prompt):
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return '[{"Meets Guidelines": "True"}]'
    return review


def _analyze(spark, tmp, asked, **more):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    return analyze(spark, SF, "orders", "o_orderpriority", "urgent", None, scorer=_reviewer(str(asked)), out_dir=f"{tmp}/out",
                   pages=conv, guideline_doc=0, doc_col="conv_id", page_col="turn", batch=1, **more)


@pytest.mark.parametrize("dies_in", ["parse_replies", "merge_verdicts", "write_results"])
def test_resume_asks_nobody_again(spark, tmp_path, monkeypatch, dies_in):
    """The run dies after M4 (before its replies are parsed, merged or written) and goes on behind it."""
    module = sys.modules["rowsift.plans.analyze"]  # the package shows the function under this name

    asked = tmp_path / "asked"
    asked.mkdir()
    run = dict(run_id="r1", run_folder=str(tmp_path / "runs"))

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(module, dies_in, killed)
        with pytest.raises(KeyboardInterrupt):
            _analyze(spark, tmp_path, asked, **run)
    # parse_replies fails before its frame is made: M4 has run by then
    calls = len(os.listdir(asked))
    review = _analyze(spark, tmp_path, asked, **run)
    assert calls == review.rows_kept == len(os.listdir(asked)) > 0
    assert review.result.where("`Meets Guidelines`").count() == review.rows_kept
    again = _analyze(spark, tmp_path, asked, **run)  # a finished run
    assert len(os.listdir(asked)) == calls and again.outputs == review.outputs
    assert sorted(map(str, again.result.collect())) == sorted(map(str, review.result.collect()))
    with pytest.raises(ValueError, match="other parameters"):
        _analyze(spark, tmp_path, asked, **run, literal=True)


def test_run_of_many_waves_has_few_jobs(spark, tmp_path, monkeypatch):
    """A run's requests go out in a number of jobs that does not grow with its waves; each is asked once."""
    module = sys.modules["rowsift.plans.analyze"]
    asked, store = tmp_path / "asked", tmp_path / "store"
    asked.mkdir()
    monkeypatch.setattr(module, "score_requests", functools.partial(module.score_requests, wave=8))
    review = _analyze(spark, tmp_path, asked, run_id="r3", run_folder=str(tmp_path / "runs"), reply_store=str(store))
    assert len(os.listdir(asked)) == review.rows_kept > 8 * ROUNDS  # batches of one record
    assert len([f for f in os.listdir(store / "reviews") if f.startswith("wave-")]) <= ROUNDS
    assert review.result.where("`Meets Guidelines`").count() == review.rows_kept


def test_killed_between_the_two_outputs(spark, tmp_path, monkeypatch):
    import rowsift.sources.writers as writers

    asked = tmp_path / "asked"
    asked.mkdir()
    run = dict(run_id="r2", run_folder=str(tmp_path / "runs"))

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(writers, "_new_table", killed)
        with pytest.raises(KeyboardInterrupt):
            _analyze(spark, tmp_path, asked, **run)
    assert [f for f in os.listdir(tmp_path / "out") if f.endswith(".json")]
    review = _analyze(spark, tmp_path, asked, **run)
    assert spark.read.json(review.outputs["json_path"]).count() == review.rows_kept == review.result.count()


def test_run_leaves_results_and_replies_only(spark, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    monkeypatch.setattr("rowsift.session.checkpoint_base", lambda s: str(shared))
    asked = tmp_path / "asked"
    asked.mkdir()
    review = _analyze(spark, tmp_path, asked, reply_store=f"{shared}/replies")
    assert {f.split("/")[0] for f in _files(shared) if not f.startswith("rowsift/rejected")} == {"replies"}
    assert review.errors.count() == 0 and review.result.count() == review.rows_kept
    rules = analyze(spark, SF, "orders", "o_orderpriority", "urgent", "o_orderkey", scorer=E.ORDER_RULES, out_dir=f"{tmp_path}/o2")
    assert rules.result.count() == rules.rows_kept
    assert {f.split("/")[0] for f in _files(shared) if not f.startswith("rowsift/rejected")} == {"replies"}


def test_scratch_deletes_what_was_written_inside(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rowsift.session.checkpoint_base", lambda s: str(tmp_path))
    with Scratch(spark):
        assert written(spark.range(5), "inside").count() == 5
        with Scratch(spark) as inner:
            written(spark.range(5), "nested")
            assert len(inner.paths) == 1
        assert any("inside" in f for f in _files(tmp_path)) and not any("nested" in f for f in _files(tmp_path))
    assert not _files(tmp_path)
    assert written(spark.range(5), "outside").count() == 5 and _files(tmp_path)


def test_run_steps(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(7)

    for _ in range(2):
        run = Run(spark, "x", str(tmp_path), p=1)
        assert run.table("s", make).count() == 7 and run.rows["s"] == 7
        assert run.value("v", lambda: {"k": made[:]}) == {"k": [1]}
    assert made == [1]
    with pytest.raises(ValueError):
        Run(spark, "x", str(tmp_path), p=2)
    with pytest.raises(ValueError):
        Run(spark, "a/b", str(tmp_path))


def test_replayed_micro_batches_add_nothing(spark, tmp_path):
    base, src = str(tmp_path), f"{tmp_path}/in"
    spark.read.parquet(f"{SF}/part.parquet").repartition(4).write.parquet(src)
    args = (spark, src, "p_name", "widget", E.STREAM_RULES, "parts", f"{base}/s.json", base, "t")
    for k in range(2):  # the second starts from the beginning: the same batches come again
        review_stream_append(*args, log_path=f"{base}/log", checkpoint=f"{base}/c{k}", max_files_per_trigger=1).awaitTermination()
    want = spark.read.parquet(src).where("lower(p_name) like '%widget%'").count()
    assert spark.read.json(f"{base}/s.json").count() == want == spark.read.parquet(f"{base}/t").count()
    log = spark.read.parquet(f"{base}/log")
    assert log.count() == 4 and log.agg({"rows": "sum"}).first()[0] == want
    # a crash between two effects: the JSON add of batch 9 happened, the table's did not
    from rowsift.sources import append_json
    rows = spark.read.parquet(f"{base}/t").limit(3)
    append_json(rows, f"{base}/s.json", add_id="parts-9")
    append_batch(rows, "parts", 9, f"{base}/s.json", base, "t", f"{base}/log")
    assert spark.read.json(f"{base}/s.json").count() == want + 3 == spark.read.parquet(f"{base}/t").count()
