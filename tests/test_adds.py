"""Adds to result sets: at the same time, cut short, repeated; types without inference."""

import json
import os
import random
import threading
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import rowsift.sources.adds as adds
import rowsift.sources.writers as writers
from rowsift.sources import add_table, append_json, append_table, read_json, write_json, write_results


def rows(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "a long")


def _together(*jobs):
    errors = []

    def run(job):
        try:
            job()
        except Exception as err:  # noqa: BLE001
            errors.append(err)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors, errors


@pytest.mark.parametrize("form", ["new", "lines", "file", "list"])
def test_sessions_that_add_at_once_lose_nothing(spark, tmp_path, form):
    path = str(tmp_path / "set.json")
    if form == "lines":
        write_json(rows(spark, 0), path)
    elif form == "file":
        open(path, "w").write('{"a": 0}\n')
    elif form == "list":
        json.dump([{"a": 0}], open(path, "w"), indent=1)
    sessions = [spark.newSession() for _ in range(4)]
    _together(*[lambda s=s, k=k: append_json(rows(s, *range(10 * k + 1, 10 * k + 6)), path) for k, s in enumerate(sessions)])
    want = {10 * k + i for k in range(4) for i in range(1, 6)} | (set() if form == "new" else {0})
    got = [r.a for r in read_json(spark, path).collect()]
    assert len(got) == len(want) and set(got) == want
    assert not [f for f in os.listdir(tmp_path) if f != "set.json" and "crc" not in f]


def test_tables_added_at_once_get_names_of_their_own(spark, tmp_path):
    sessions, names = [spark.newSession() for _ in range(4)], []
    _together(*[lambda s=s, k=k: names.append((add_table(rows(s, k), str(tmp_path), "t"), k)) for k, s in enumerate(sessions)])
    assert sorted(n for n, _ in names) == ["t", "t_1", "t_2", "t_3"]
    assert all(spark.read.parquet(f"{tmp_path}/{n}").first().a == k for n, k in names)


def test_reservation_left_behind(spark, tmp_path, monkeypatch):
    """A name that a dead session reserved is passed over, and taken once it is stale."""
    (tmp_path / "_rowsift_names").mkdir()
    (tmp_path / "_rowsift_names" / "t").write_text(json.dumps({"since": __import__("time").time()}))
    assert add_table(rows(spark, 1), str(tmp_path), "t") == "t_1"
    monkeypatch.setattr(adds, "STALE_SECONDS", -1)
    assert add_table(rows(spark, 1), str(tmp_path), "t") == "t"


def test_killed_between_the_two_renames(spark, tmp_path, monkeypatch):
    """The rewrite of a list dies when the old file is out of the way and the new folder not yet in place."""
    path = str(tmp_path / "legacy.json")
    json.dump([{"a": 1}, {"a": 2}], open(path, "w"), indent=2)
    real = writers._settle_rewrite
    calls = []

    def killed(s, p):
        calls.append(p)
        if len(calls) == 2:
            raise KeyboardInterrupt
        real(s, p)

    monkeypatch.setattr(writers, "_settle_rewrite", killed)
    with pytest.raises(KeyboardInterrupt):
        append_json(rows(spark, 3), path)
    assert not os.path.exists(path) and os.path.exists(path + "_rs_old") and os.path.exists(path + "_rs_new")
    monkeypatch.setattr(writers, "_settle_rewrite", real)
    append_json(rows(spark, 3), path)
    assert sorted(r.a for r in read_json(spark, path).collect()) == [1, 2, 3]
    assert not os.path.exists(path + "_rs_old") and not os.path.exists(path + "_rs_new")


def test_killed_while_moving_files(spark, tmp_path, monkeypatch):
    """An add dies after the first of its files; the next one, of anyone, finishes it first."""
    path = str(tmp_path / "s.json")
    write_json(rows(spark, 0), path)
    real, moved = adds.rename, []

    def dies(s, old, new):
        if "part-" in new:
            moved.append(new)
            if len(moved) == 2:
                raise KeyboardInterrupt
        return real(s, old, new)

    monkeypatch.setattr(adds, "rename", dies)
    with pytest.raises(KeyboardInterrupt):
        append_json(rows(spark, *range(1, 9)).repartition(4), path, add_id="cut")
    monkeypatch.setattr(adds, "rename", real)
    assert 1 < spark.read.json(path).count() < 9
    append_json(rows(spark, 99), path)
    assert sorted(r.a for r in read_json(spark, path).collect()) == [*range(9), 99]
    append_json(rows(spark, *range(1, 9)), path, add_id="cut")  # the same add once more
    assert read_json(spark, path).count() == 10


def test_named_adds_happen_once(spark, tmp_path):
    base = str(tmp_path)
    for _ in range(3):
        append_json(rows(spark, 1, 2), f"{base}/s.json", add_id="one")
        append_table(rows(spark, 1, 2), base, "grows", add_id="one")
        assert add_table(rows(spark, 5), base, "t", add_id="one") == "t"
        out = write_results(rows(spark, 7), base, "in.parquet", "in", "a", add_id="run-1")
    append_table(rows(spark, 3), base, "grows", add_id="two")
    assert read_json(spark, f"{base}/s.json").count() == 2
    assert sorted(r.a for r in spark.read.parquet(f"{base}/grows").collect()) == [1, 2, 3]
    assert read_json(spark, out["json_path"]).count() == 1 == spark.read.parquet(out["table_path"]).count()
    with pytest.raises(Exception):
        write_results(rows(spark, 7), base, "in.parquet", "in", "a", add_id="run-2")  # new_file is new
    with pytest.raises(ValueError):
        append_json(rows(spark, 1), f"{base}/s.json", add_id="../x")


def test_single_file_of_lines(spark, tmp_path):
    path = str(tmp_path / "one.json")
    open(path, "w").write('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    for k in (3, 4):
        append_json(spark.createDataFrame([(k, 0.5)], "a long, c double"), path)
    back = read_json(spark, path)
    assert back.columns == ["a", "b", "c"] and sorted(r.a for r in back.collect()) == [1, 2, 3, 4]
    bad = str(tmp_path / "bad.json")
    open(bad, "w").write('{"a": 1}\nnot json\n')
    with pytest.raises(ValueError, match="nothing was added"):
        append_json(rows(spark, 1), bad)
    assert open(bad).read() == '{"a": 1}\nnot json\n'


KINDS = [("long", [1, -5, None]), ("double", [0.5, 1e300, None]), ("string", ["x", "", None]), ("boolean", [True, None]),
         ("decimal(30,2)", [None, "12345678901234567890123456.25"]), ("array<long>", [[1], [], None]), ("array<string>", [["x", None], []]),
         ("struct<n:long,m:string>", [(1, None), (None, None), None]), ("struct<n:double,k:array<boolean>>", [(1.5, [True]), (2.0, [])]),
         ("date", [date(2024, 1, 2)]), ("map<string,long>", [{"u": 1}, {}]), ("array<struct<p:long>>", [[(1,)], [(None,)], []])]


@pytest.mark.parametrize("seed", range(6))
def test_types_of_the_ledger_are_those_of_full_inference(spark, tmp_path, seed):
    rng, path = random.Random(seed), str(tmp_path / "s.json")
    for k in range(4):
        names = rng.sample(["a", "b", "c", "d", "e"], 3)
        kinds = [rng.choice(KINDS) for _ in names]
        data = [tuple(rng.choice(vals) for _, vals in kinds) for _ in range(rng.randint(0, 5))]
        texts = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, (t, _) in zip(names, kinds)))
        data = [tuple(__import__("decimal").Decimal(x) if isinstance(f.dataType, T.DecimalType) and x else x for x, f in zip(r, texts)) for r in data]
        append_json(spark.createDataFrame(data, texts), path)
    mine = read_json(spark, path)
    assert mine.schema == spark.read.json(path).schema
    assert sorted(map(str, mine.collect())) == sorted(map(str, spark.read.json(path).collect()))


def test_reading_an_appended_set_is_one_scan(spark, tmp_path):
    path = str(tmp_path / "s.json")
    for k in range(3):
        append_json(rows(spark, k).withColumn(f"c{k}", F.lit(k)), path)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("read-types", "x")
    df = read_json(spark, path)
    assert not tracker.getJobIdsForGroup("read-types")  # no pass over the records to find their types
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1 and df.columns == ["a", "c0", "c1", "c2"] and df.count() == 3


def test_foreign_folder_of_lines(spark, tmp_path):
    """Records that were there before the first add keep their types in the ledger."""
    path = str(tmp_path / "f.json")
    spark.createDataFrame([('{"x": 1, "n": null, "s": {"q": null}}',), ('{"x": 2.5}',)], "value string").write.text(path)
    append_json(spark.createDataFrame([(3, True)], "x long, n boolean"), path)
    assert read_json(spark, path).schema == spark.read.json(path).schema
