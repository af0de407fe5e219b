"""Replies by content: what was answered is never asked again, whoever died in between."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from rowsift.operators import ReplyStore, build_requests, match_values, render_records, score_requests


def _requests(spark, n=200, batch=5):
    return build_requests(render_records(spark.range(n).withColumnRenamed("id", "row_id")), "guide", "t", "id", batch=batch)


def _asked(folder):
    """Prompts asked, by a name for each, with how often."""
    out = {}
    for f in os.listdir(folder):
        name = f.split("@")[0]
        out[name] = out.get(name, 0) + 1
    return out


def _counting(folder, die_after=None):
    import hashlib

    def scorer(prompt):
        if die_after is not None and len(os.listdir(folder)) >= die_after:
            os._exit(1)  # the worker is gone, as with a lost executor
        name = hashlib.sha1(prompt.encode()).hexdigest()
        open(os.path.join(folder, f"{name}@{uuid.uuid4().hex}"), "w").close()
        return f"ok {len(prompt)}"
    return scorer


def test_a_scorer_that_dies_loses_one_wave(spark, tmp_path):
    """40 requests in waves of 8; the first run dies in the third, a second session goes on."""
    asked, store, req = tmp_path / "asked", str(tmp_path / "store"), _requests(spark)
    asked.mkdir()
    with pytest.raises(Exception):
        score_requests(req, _counting(str(asked), die_after=20), store=store, wave=8, partitions=2)
    before = _asked(asked)
    done = ReplyStore(spark, store).rows().where("response is not null").count()
    assert 8 <= done <= 20
    other = spark.newSession()
    again = score_requests(_requests(other), _counting(str(asked)), store=store, wave=8, partitions=2)
    assert again.count() == 40 and again.where("response like 'ok %' and error is null").count() == 40
    total = _asked(asked)
    assert len(total) == 40
    repeated = [k for k, n in total.items() if n > 1]
    assert all(k in before for k in repeated) and len(repeated) <= sum(before.values()) - done  # the open wave only
    third = score_requests(_requests(spark, batch=5), _counting(str(asked)), store=store)
    assert third.count() == 40 and _asked(asked) == total  # nothing is asked


def test_equal_requests_and_other_names(spark, tmp_path):
    asked, store = tmp_path / "asked", str(tmp_path / "store")
    asked.mkdir()
    req = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other"), (4, None)], "batch_id long, prompt string")
    out = {r.batch_id: r.response for r in score_requests(req, _counting(str(asked)), store=store).collect()}
    assert out == {1: "ok 4", 2: "ok 4", 3: "ok 5", 4: None} and sorted(_asked(asked).values()) == [1, 1]
    score_requests(req, _counting(str(asked)), store=store, scorer_name="another model")
    assert sorted(_asked(asked).values()) == [2, 2]


def test_failures_are_asked_again(spark, tmp_path):
    store = str(tmp_path / "store")
    req = spark.createDataFrame([(k, f"p{k}") for k in range(6)], "batch_id long, prompt string")

    def moody(prompt):
        if prompt in ("p1", "p3"):
            raise RuntimeError("busy")
        return " " if prompt == "p5" else prompt.upper()

    first = {r.batch_id: (r.response, r.error) for r in score_requests(req, moody, retries=0, store=store).collect()}
    assert first[1] == (None, "RuntimeError: busy") and first[5] == (None, "empty reply") and first[0] == ("P0", None)
    second = {r.batch_id: (r.response, r.error) for r in score_requests(req, lambda p: "second", store=store).collect()}
    assert second == {k: ("second", None) if k in (1, 3, 5) else (f"P{k}", None) for k in range(6)}


def test_parts_of_a_request_are_its_key(spark, tmp_path):
    """head, body and tail put together are the same request as the whole prompt."""
    store = str(tmp_path / "store")
    rows = render_records(spark.range(20).withColumnRenamed("id", "row_id"))
    whole = build_requests(rows, "guide", "t", "id", batch=5)
    parts = build_requests(rows, "guide", "t", "id", batch=5, whole=False)
    assert "prompt" not in parts.columns
    a = {r.batch_id: r.response for r in score_requests(whole, lambda p: p[::-1], store=store).collect()}
    b = {r.batch_id: r.response for r in score_requests(parts, lambda p: "new", store=store).collect()}
    assert a == b and len(a) == 4
    plain = {r.batch_id: r.response for r in score_requests(parts, lambda p: p[::-1]).collect()}
    assert plain == a


def test_matches_are_asked_once_per_value(spark, tmp_path):
    asked, store = tmp_path / "asked", str(tmp_path / "store")
    asked.mkdir()

    def matcher(term, values, folder=str(asked)):
        for v in values:
            open(os.path.join(folder, f"{v}@{uuid.uuid4().hex}"), "w").close()
        return [(v, f"has {term}") for v in values if "a" in v] + (["stray"] if "q1" in values else [])

    def values(*words):
        return spark.createDataFrame([(w,) for w in words], "value string")

    first = match_values(values("xa", "b", "q1"), "z", matcher, store=store, batch_size=2)
    assert {(r.value, r.explanation) for r in first.collect()} == {("xa", "has z"), ("stray", None)}
    second = match_values(values("xa", "b", "q1", "ya", "c"), "z", matcher, store=store, batch_size=2)
    assert {r.value for r in second.collect()} == {"xa", "ya", "stray"}
    assert set(_asked(asked).values()) == {1} and set(_asked(asked)) == {"xa", "b", "q1", "ya", "c"}
    match_values(values("b"), "other term", matcher, store=store)
    assert _asked(asked)["b"] == 2

    def broken(term, values):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="down"):
        match_values(values("b", "new"), "z", broken, store=store)
    assert match_values(values("b", "new"), "z", lambda t, v: v, store=store).first().value == "new"


def test_wave_reads_only_its_keys(spark, tmp_path):
    """Waves cut the key space into ranges of bounded size; together they cover it once."""
    store = ReplyStore(spark, str(tmp_path / "s"))
    rows = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").cast("string").alias("t"))
    sizes = tmp_path / "sizes"
    sizes.mkdir()

    def ask(frames):
        for pdf in frames:
            yield pdf.assign(response=pdf["t"], error=None)[["key", "response", "error"]]

    assert store.fill(rows, ask, wave=100) == 1000 and store.fill(rows, ask, wave=100) == 0
    waves = [spark.read.parquet(f"{store.path}/{f}").count() for f in sorted(os.listdir(store.path))]
    assert 10 <= len(waves) <= 12 and sum(waves) == 1000 and max(waves) <= 100
    with pytest.raises(ValueError):
        store.fill(rows, ask, wave=0)


def test_many_small_waves_share_jobs(spark, tmp_path):
    """The number of jobs does not grow with the waves; requests are asked once, and a task has a wave's share of them."""
    from rowsift.operators.replystore import ROUNDS

    asked, store = tmp_path / "asked", str(tmp_path / "store")
    asked.mkdir()
    req = spark.createDataFrame([(k, f"p{k % 60}") for k in range(70)], "batch_id long, prompt string")
    out = score_requests(req, _counting(str(asked)), store=store, wave=2)
    assert out.count() == 70 and out.where("response is null").count() == 0
    assert len(_asked(asked)) == 60 and set(_asked(asked).values()) == {1}
    jobs = [f for f in os.listdir(store) if f.startswith("wave-")]
    assert len(jobs) <= ROUNDS  # 30 waves
    files = [os.path.join(store, j, f) for j in jobs for f in os.listdir(os.path.join(store, j)) if f.endswith(".parquet")]
    assert max(spark.read.parquet(f).count() for f in files[:5]) == 1  # at most 2, however many tasks run at once
    score_requests(req, _counting(str(asked)), store=store, wave=2)
    assert set(_asked(asked).values()) == {1}


def test_a_failed_task_leaves_the_replies_of_others(spark, tmp_path):
    """Many waves in a job: what its other tasks have answered is in the store when one of them dies."""
    asked, store = tmp_path / "asked", str(tmp_path / "store")
    asked.mkdir()
    req = spark.createDataFrame([(k, f"p{k}") for k in range(120)], "batch_id long, prompt string")
    with pytest.raises(Exception):
        score_requests(req, _counting(str(asked), die_after=60), store=store, wave=1)
    done, before = ReplyStore(spark, store).rows().where("response is not null").count(), sum(_asked(asked).values())
    assert before - done <= 2 * spark.sparkContext.defaultParallelism  # a request for each running task
    score_requests(req, _counting(str(asked)), store=store, wave=1)
    assert len(_asked(asked)) == 120 and sum(_asked(asked).values()) <= 120 + before - done


def test_compacted_store_answers_alike(spark, tmp_path):
    store = ReplyStore(spark, str(tmp_path / "s"))
    req = spark.createDataFrame([(k, f"p{k}") for k in range(40)], "batch_id long, prompt string")

    def moody(prompt, word):
        if prompt.endswith("7"):
            raise RuntimeError(word)
        return f"{word} {prompt}"

    for word in ("first", "second"):
        score_requests(req, lambda p, w=word: moody(p, w), retries=0, store=store.path, wave=7)
    keys = spark.createDataFrame([(r.key,) for r in store.rows().select("key").distinct().collect()], "key string")
    before = sorted(map(str, store.answers(keys).collect()))
    store.compact()
    assert len([f for f in os.listdir(store.path) if f.startswith("wave-")]) == 1 and store.rows().count() == 40
    assert sorted(map(str, store.answers(keys).collect())) == before
    assert sum("second" in x for x in before) == 4 and sum("first" in x for x in before) == 36
    third = score_requests(req, lambda p: "third", store=store.path)
    assert third.where("response = 'third'").count() == 4
