import os
import random
import string

from pyspark.sql import functions as F

import __spark_entry__ as E
from rowsift.operators import rows_containing, with_row_id
from rowsift.operators import rowid


def test_row_id_dense_numeric(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 + 3).alias("k")).where("k % 3 != 0")
    out = with_row_id(df, "k", rows_per_part=100)  # many buckets
    rows = sorted(out.collect(), key=lambda r: r.k)
    assert [r.row_id for r in rows] == list(range(len(rows)))


def test_row_id_parts_follow_rows_and_bytes(spark, monkeypatch):
    df = spark.range(0, 3000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("t"))
    stats = {}
    assert rowid._parts(df, 500, stats) == 6 and stats["rows"] == 3000
    monkeypatch.setattr(rowid, "PART_BYTES", 100_000)
    assert rowid._parts(df, 1_000_000, None) >= 30
    assert [r.row_id for r in with_row_id(df, "k").orderBy("k").collect()] == list(range(3000))


def test_row_id_parts_are_bounded(spark, monkeypatch):
    """Few rows a partition make no more of them than MAX_PARTS; bytes do. The ids are the same."""
    df = spark.range(0, 3000).select((F.col("id") % 5).alias("k"), "id")
    assert rowid._parts(spark.range(0, 3000), 1, None) == rowid.MAX_PARTS < 3000
    monkeypatch.setattr(rowid, "MAX_PARTS", 4)
    assert rowid._parts(df, 1, None) == 4
    got = sorted((r.row_id, r.k, r.id) for r in with_row_id(df, "k", rows_per_part=1).collect())
    assert got == [(i, k, v) for i, (k, v) in enumerate(sorted((v % 5, v) for v in range(3000)))]
    monkeypatch.setattr(rowid, "PART_BYTES", 10_000)
    assert rowid._parts(df, 1_000_000, None) == 10


def test_multi_query_reports_from_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    """f6_with_row_id_multi: what sorts and writes the rows is no more tasks than MAX_PARTS, and the ids are the same."""
    monkeypatch.setattr(rowid, "MAX_PARTS", 3, raising=False)
    keys = [None if i % 50 == 0 else (i * 7919) % 4001 for i in range(4000)]
    spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = E.queries()["f6_with_row_id_multi"](spark, str(tmp_path))
    folder = {os.path.dirname(f) for f in got.inputFiles()}
    assert len(folder) == 1 and len(got.inputFiles()) <= 3  # 8 by rows
    want = sorted(range(4000), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
    assert sorted((r.row_id, r.o_custkey) for r in got.collect()) == list(enumerate(want))


def test_small_part_queries_write_no_more_files_for_more_rows(spark, tmp_path, monkeypatch):
    """f6_with_row_id_multi, f6_ties, f6_input_order: four times the rows are as many files (a task each), ids still dense."""
    monkeypatch.setattr(rowid, "MAX_PARTS", 2, raising=False)
    for name in ("f6_with_row_id_multi", "f6_ties", "f6_input_order"):
        files = []
        for n in (2100, 8400):
            folder = f"{tmp_path}/{name}-{n}"
            rows = spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") * 3).alias("o_custkey"), (F.col("id") % 5).cast("string").alias("o_orderpriority"))
            rows.coalesce(1).write.parquet(f"{folder}/orders.parquet")
            got = E.queries()[name](spark, folder)
            files.append(len(got.inputFiles()))
            keys = sorted(range(n), key=lambda i: (i % 5, i)) if name == "f6_ties" else range(n)
            assert sorted((r.row_id, r.o_orderkey) for r in got.collect()) == list(enumerate(keys))
        assert files == [2, 2], name  # 3 or 5, and 12 or 17, by rows


def test_row_id_repeated_keys_and_nulls(spark):
    """One key holds most rows, some are null: dense ids in key order, and the same for every reader."""
    df = spark.range(0, 2000).select(F.when(F.col("id") % 10 == 0, F.col("id")).when(F.col("id") % 10 != 1, F.lit(7)).alias("k"), "id")
    out = with_row_id(df, "k", rows_per_part=100)
    rows = sorted(((r.row_id, r.k, r.id) for r in out.collect()))
    assert [r[0] for r in rows] == list(range(2000))
    keys = [-1 if k is None else k for _, k, _ in rows]
    assert keys == sorted(keys) and rows == sorted(((r.row_id, r.k, r.id) for r in out.collect()))
    hot = spark.range(0, 5000).select(F.lit(1).alias("k"), "id")
    parts = with_row_id(hot, "k", rows_per_part=500)
    assert sorted(r.row_id for r in parts.collect()) == list(range(5000))


def test_row_id_wall_clock_order(spark):
    """TIMESTAMP_NTZ keys are ordered by their wall clock, whatever the session's zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = [f"2024-03-10 {h:02d}:{m:02d}:00" for h in (1, 2, 3) for m in range(0, 60, 5)]
        df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
        got = [r.s for r in with_row_id(df, "t", rows_per_part=4).orderBy("row_id").select(F.col("t").cast("string").alias("s")).collect()]
        assert got == times
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_row_id_empty_and_clash(spark):
    import pytest

    assert with_row_id(spark.range(0), "id").collect() == []
    with pytest.raises(ValueError, match="row_id"):
        with_row_id(spark.range(3).withColumnRenamed("id", "ROW_ID"), "ROW_ID")


def test_row_id_string_key_and_stats(spark):
    words = ["".join(random.Random(i).choices(string.ascii_lowercase, k=8)) + str(i) for i in range(700)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    stats = {}
    out = with_row_id(df, "w", stats=stats)
    got = {r.w: r.row_id for r in out.collect()}
    assert stats["rows"] == 700
    assert [got[w] for w in sorted(words)] == list(range(700))


def test_row_id_timestamp_and_double(spark):
    df = spark.createDataFrame([(1.5,), (-2.0,), (10.25,), (3.0,)], "x double")
    assert [r.row_id for r in with_row_id(df, "x").orderBy("x").collect()] == [0, 1, 2, 3]
    ts = spark.range(0, 50).select(F.timestamp_seconds(F.col("id") * 3600).alias("t"))
    assert [r.row_id for r in with_row_id(ts, "t").orderBy("t").collect()] == list(range(50))


def _brute(texts, values):
    return sorted(t for t in texts if any(v.lower() in t.lower() for v in values))


def test_containment_qgram_matches_brute_force(spark):
    rng = random.Random(7)
    alphabet = "abcé ÉxyZ"
    texts = sorted({"".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(150)})
    values = list({"".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(120)})
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    for some in (values, values[:3], [v for v in values if len(v) > 4]):
        v = spark.createDataFrame([(x,) for x in some], "v string")
        assert sorted(r.t for r in rows_containing(t, F.col("t"), v, "v").collect()) == _brute(texts, some)


def test_rows_containing_words_and_grams_match_brute_force(spark):
    """Word keys (values with interior words), q-gram keys and short values
    together, over texts with mixed white space and repeated texts."""
    rng = random.Random(11)
    words = ["ab", "abc", "Éa", "zz", "xyzzy", "b", "cé"]
    seps = [" ", "\t", "\n", "  ", " \r\n"]

    def phrase(n):
        out = ""
        for i in range(n):
            out += rng.choice(words) + (rng.choice(seps) if i < n - 1 else "")
        return out

    texts = [phrase(rng.randint(0, 12)) for _ in range(120)]
    texts += texts[:10] + [None]
    values = list({phrase(rng.randint(1, 4)) for _ in range(60)} | {"é", "zzx", " ab ", "c\té"})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    v = spark.createDataFrame([(x,) for x in values], "v string")
    low = [x.lower() for x in values]
    want = sorted(i for i, t in enumerate(texts) if t is not None and any(x in t.lower() for x in low))
    got = sorted(r.i for r in rows_containing(df, F.col("t"), v, "v").collect())
    assert got == want
    # with an extra predicate: its rows are kept once, whatever the values say
    extra = F.col("i") % 5 == 0
    want_x = sorted(set(want) | {i for i in range(len(texts)) if i % 5 == 0})
    got_x = [r.i for r in rows_containing(df, F.col("t"), v, "v", extra=extra).collect()]
    assert sorted(got_x) == want_x and len(got_x) == len(set(got_x))


def test_gram_keys_of_texts_in_one_pass(spark):
    """Texts yield each value's gram keys, of all lengths at once, and cut their grams out once."""
    import rowsift.operators.containment as C

    texts = ["Se que os", "ab", "", "éñ\n😀 xyz ", "aaaaaaaaaa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for lengths in ([1, 2, 4, 8], [4, 8], [8], [3]):
        keys = C.explode_keys(df, F.lower("t"), [C.GRAM + n for n in lengths], F.col("i"))
        want = None
        for n in lengths:
            one = df.select("i", F.explode(C._gram_keys(F.lower("t"), n)).alias("_key"))
            want = one if want is None else want.union(one)
        low = [t.lower() for t in texts]
        at_least = {(i, t[k:k + n]) for i, t in enumerate(low) for n in lengths for k in range(len(t) - n + 1)}
        got = {tuple(r) for r in keys.collect()}
        assert got >= {tuple(r) for r in want.collect()} and len(got) >= len(at_least)
        assert keys._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_key_count_decides_the_broadcast(spark, monkeypatch):
    """Value keys beyond the bound are joined without a broadcast; the rows are the same."""
    import rowsift.operators.containment as C

    texts = ["alpha beta gamma delta", "beta gamma", "delta alpha beta", "zeta"]
    values = ["a beta g", "gamma", "alpha beta", "eta"]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    v = spark.createDataFrame([(x,) for x in values], "v string")
    assert C.KeyPlan(v, "v").small
    for name, bound in (("MAX_BROADCAST_BYTES", 64), ("MAX_BROADCAST_KEYS", 3)):
        with monkeypatch.context() as m:
            m.setattr(C, name, bound)
            assert not C.KeyPlan(v, "v").small
            got = sorted(r.t for r in C.rows_containing(t, F.col("t"), v, "v").collect())
        assert got == _brute(texts, values)


def test_many_value_keys(spark):
    """1.5 million possible keys, more than are broadcast."""
    from rowsift.operators.containment import KeyPlan

    v = spark.range(0, 15_000).select(F.concat(*[F.sha2(F.concat("id", F.lit(f"{k}")), 256) for k in range(2)]).alias("v"))
    plan = KeyPlan(v, "v")
    assert plan.n_values == 15_000 and not plan.small
    texts = v.where("v like '00%'").select(F.concat(F.lit("<"), F.upper("v"), F.lit(">")).alias("t")).unionByName(
        v.limit(100).select(F.reverse("v").alias("t")))
    want = v.where("v like '00%'").count()
    assert 20 < want == rows_containing(texts, F.col("t"), v, "v", plan=plan).where("t like '<%'").count()


def test_rows_containing_without_broadcasts(spark, monkeypatch):
    """Candidates beyond the broadcast bound: both sides shuffle on the text
    hash (sort-merge left-semi join with the contains condition)."""
    import rowsift.operators.containment as C

    monkeypatch.setattr(C, "MAX_BROADCAST_BYTES", 16)
    texts = ["one two three", "two three four", "four five", None, "one two three", "xyz"]
    values = ["two three", "five", "x y", "ee"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    v = spark.createDataFrame([(x,) for x in values], "v string")
    out = C.rows_containing(df, F.col("t"), v, "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan, plan
    want = sorted(i for i, t in enumerate(texts) if t and any(x in t for x in values))
    assert sorted(r.i for r in out.collect()) == want


def test_identical_rows_spread(spark):
    """200,000 equal rows fill at least eight parts alike, and get every id once."""
    seen = []

    def keep(rows, name):
        from rowsift.session import written
        seen.append(written(rows, name))
        return seen[-1]

    same = spark.range(0, 200_000, numPartitions=6).select(F.lit("x").alias("t"), F.lit(1).alias("k"))
    out = with_row_id(same, "k", rows_per_part=20_000, write=keep)
    sizes = [r["count"] for r in seen[0].groupBy("_rs_part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 40_000
    got = out.agg(F.count("row_id").alias("n"), F.countDistinct("row_id").alias("d"), F.max("row_id").alias("m")).first()
    assert (got.n, got.d, got.m) == (200_000, 200_000, 199_999)


def test_ties_keep_the_input_order(spark, tmp_path):
    """Equal keys, and no key at all: the order of the rows in the file."""
    path = str(tmp_path / "t")
    spark.range(0, 5000, numPartitions=1).select("id", (F.col("id") % 3).alias("k")).write.parquet(path)
    df = spark.read.parquet(path)
    assert [r.id for r in with_row_id(df, rows_per_part=300).orderBy("row_id").collect()] == list(range(5000))
    ties = [(r.k, r.id) for r in with_row_id(df, "k", rows_per_part=300).orderBy("row_id").collect()]
    assert ties == sorted(ties)
    named = df.withColumn("_rs_place", F.col("id") * 2)
    with __import__("pytest").raises(ValueError):
        with_row_id(named, "k")
    out = with_row_id(named.withColumnRenamed("_rs_place", "at"), "k", place="at")  # a place of the caller's, given up
    assert out.columns == ["id", "k", "row_id"]


def test_value_of_common_words_has_few_candidates(spark):
    """Every interior word stands in most texts; the phrase that is taken as key does not."""
    import rowsift.operators.containment as C

    rng = random.Random(3)
    words = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "his", "but", "at"]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(3000)]
    value = "he was not with the in of his"
    for i in range(0, 3000, 75):
        texts[i] = texts[i] + " " + value + " " + rng.choice(words)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    v = spark.createDataFrame([(value,), ("of AND",), ("as by",)], "v string").where("v like 'he%'")
    assert all(sum(w in t.split() for t in texts) > 0.7 * len(texts) for w in value.split()[1:-1])
    hits = sorted(i for i, t in enumerate(texts) if value in t)
    cand = C.candidates(df, F.col("t"), v, "v")
    assert len(hits) >= 40 and len(hits) <= cand.count() < 2 * len(hits)
    assert sorted(r.i for r in rows_containing(df, F.col("t"), v, "v").collect()) == hits


def test_keys_of_every_kind_match_brute_force(spark):
    """Values of 0 to 6 words, common and rare, with all white space, ends cut inside words."""
    rng = random.Random(5)
    common, rare = ["of", "the", "a", "in"], [f"w{k}x" for k in range(40)]
    seps = [" ", "  ", "\t", "\n", "\r\n"]
    texts = ["".join(rng.choice(common * 6 + rare) + rng.choice(seps) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    values = []
    for _ in range(150):
        t = rng.choice(texts)
        if t:
            a = rng.randrange(len(t))
            values.append(t[a:a + rng.choice([1, 2, 4, 7, 9, 15, 30])].upper())
    values = [v for v in set(values) if v] + ["no such thing at all", "of the a in of the a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for some in (values, values[:5], [v for v in values if len(v) > 8], [v for v in values if len(v.split()) > 3]):
        v = spark.createDataFrame([(x,) for x in some], "v string")
        got = sorted(r.i for r in rows_containing(df, F.col("t"), v, "v").collect())
        assert got == sorted(i for i, t in enumerate(texts) if any(x.lower() in t.lower() for x in some))


def test_sample_of_texts_reads_some_files(spark, tmp_path):
    import rowsift.operators.containment as C

    path = str(tmp_path / "many")
    spark.range(0, 4000).select(F.concat(F.lit("text "), "id").alias("t")).repartition(40).write.parquet(path)
    df = spark.read.parquet(path)
    sample = C.sample_texts(df, F.col("t"))
    files = {r.f for r in sample.select(F.input_file_name().alias("f")).distinct().collect()}
    assert 8 <= len(files) <= C.SAMPLE_FILES and 0 < sample.count() < 4000 / C.SAMPLE_ONE_IN
