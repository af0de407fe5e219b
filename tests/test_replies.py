import pytest
from pyspark.sql import functions as F

from rowsift.functions import extract_json, notes, verdict, verdict_raw
from rowsift.operators import (
    explode_records,
    merge_verdicts,
    parse_matches,
    quarantine,
    records_to_table,
    parse_replies,
    standardize,
)

REPLIES = [
    ('Sure: [{"id":1,"Meets Guidelines":" TRUE "}] done', True, None),
    ('[{"id":1,"Meets Guidelines":"Partially"}]', False, None),
    ('[{"id":1,"Meets Guidelines":true}]', True, None),
    ('[{"id":1,"Meets Guidelines":null}]', None, None),
    ('[{"id":1,"Meets Guidelines":1}]', None, "1"),
    ('[{"id":1}]', False, None),
    ('{"records":[{"id":1,"Meets Guidelines":"true"}]}', True, None),
]


def test_replies_are_parsed_twice_at_most(spark, capsys):
    """Strictness takes two parses of a reply; kinds are told without the text of its schema."""
    odd = [('[null]', "non-object element"), ('[{"id":1}, null]', "non-object element"), ('["{}"]', "non-object element"), ('[{}]', None),
           ('{"a":1}', "not a list"), ('{"a":{"b":2}}', "not a list"), ('[]', "empty list"), ('[true]-1]', "no valid json")]
    df = spark.createDataFrame([(t,) for t, _ in odd], "response string")
    out = parse_replies(df, error_col=None)
    assert [r.reason for r in out.collect()] == [reason for _, reason in odd]
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("parseJson") == 2 and "schemaofvariant" not in plan.lower()


@pytest.mark.parametrize("reply,want,raw", REPLIES)
def test_r4_verdict_shapes(spark, reply, want, raw):
    df = spark.createDataFrame([(reply,)], "response string")
    good, bad = quarantine(df, error_col=None)
    assert bad.count() == 0
    rec = explode_records(good, keep=()).select(verdict("record").alias("v"),
                                                 verdict_raw("record").alias("raw")).collect()
    assert len(rec) == 1 and rec[0].v == want and rec[0].raw == raw


@pytest.mark.parametrize("reply,reason", [
    ('See [1]. [{"id":1}]', "no valid json"),
    ('{"id":1}', "not a list"),
    ('[{"id":1}, "x"]', "non-object element"),
    ("[]", "empty list"),
    ("no json", "no valid json"),
    ("", "empty reply"),
    (None, "empty reply"),
    ('[{"id":1,"id":2}]', "no valid json"),
    ("[NaN]", "no valid json"),
])
def test_r5_rejects(spark, reply, reason):
    df = spark.createDataFrame([(reply,)], "response string")
    assert parse_replies(df).first().reason == reason


def test_r5_error_column_wins(spark):
    df = spark.createDataFrame([(None, "TimeoutError: slow")], "response string, error string")
    good, bad = quarantine(df)
    assert good.count() == 0 and bad.first().reason == "TimeoutError: slow"


def test_r1_prefer_object(spark):
    df = spark.createDataFrame([('x {"matches":["a"],"explanation":"z"} y',)], "t string")
    assert df.select(extract_json("t")).first()[0] == '["a"]'
    assert df.select(extract_json("t", prefer="object")).first()[0] == '{"matches":["a"],"explanation":"z"}'


def test_r2_matches(spark):
    df = spark.createDataFrame([('x {"matches":["a","b"],"explanation":"z"} y',), ('{"matches":"a"}',),
                                ("no json",)], "response string")
    got = parse_matches(df).collect()
    assert got[0].matches == ["a", "b"] and got[0].explanation == "z"
    assert got[1].matches is None and got[2].matches is None


def test_r3_r4_row_ids(spark):
    df = spark.createDataFrame([
        (0, [10, 11], '[{"Meets Guidelines":"True","Notes on Compliance":"ok"},{"Meets Guidelines":"False"}]'),
        (1, [12, 13], '[{"row_id":13,"Meets Guidelines":"True"}]'),
    ], "batch_id long, row_ids array<long>, response string")
    recs = standardize(explode_records(df)).orderBy("batch_id", "pos").collect()
    assert [(r.row_id, r.verdict, r.notes) for r in recs] == [(10, True, "ok"), (11, False, None), (13, True, None)]


def test_r6_union_of_keys(spark):
    df = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"c":null,"a":2.5}',)], "t string") \
        .select(F.parse_json("t").alias("record"))
    out = records_to_table(df)
    assert out.columns == ["a", "b", "c"]
    assert sorted((r.a, r.b, r.c) for r in out.collect()) == [(1.0, "x", None), (2.5, None, None)]


def test_r7_merge_defaults(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, x string")
    verdicts = spark.createDataFrame([(0, True, "n", None, 0, 0), (0, False, "dup", None, 1, 0)],
                                     "row_id long, verdict boolean, notes string, verdict_raw string, batch_id long, pos int")
    got = {r.row_id: (r.verdict, r.notes) for r in merge_verdicts(rows, verdicts).collect()}
    assert got == {0: (True, "n"), 1: (False, None)}


def test_notes_non_string(spark):
    df = spark.createDataFrame([('{"Notes on Compliance":[1,2]}',)], "t string").select(F.parse_json("t").alias("r"))
    assert df.select(notes("r")).first()[0] == "[1,2]"


def test_r4_id_of_another_request_judges_nothing(spark):
    """Batch 1 holds rows 2 and 3 but states row 0: the record is set aside."""
    from rowsift.operators import explode_records, merge_verdicts, parse_replies, standardize

    df = spark.createDataFrame([
        (0, [0, 1], "no json"),
        (1, [2, 3], '[{"row_id":0,"Meets Guidelines":"True","Notes on Compliance":"stray"},'
                    '{"row_id":3,"Meets Guidelines":"True","Notes on Compliance":"own"}]'),
        (2, [4], '[{"Meets Guidelines":"True","Notes on Compliance":"by place"}]')], "batch_id long, row_ids array<long>, response string")
    out = standardize(explode_records(parse_replies(df).where("reason is null")))
    got = {(r.batch_id, r.pos): (r.row_id, r.reason) for r in out.collect()}
    assert got == {(1, 0): (None, "row id of another request"), (1, 1): (3, None), (2, 0): (4, None)}
    merged = merge_verdicts(spark.range(5).withColumnRenamed("id", "row_id"), out)
    assert {r.row_id: r.notes for r in merged.collect()} == {0: None, 1: None, 2: None, 3: "own", 4: "by place"}


def test_r6_mixed_kinds_exact_numbers_and_surplus_keys(spark):
    from rowsift.operators import records_to_table

    recs = spark.createDataFrame([('{"d":"N/A","n":12345678901234567890,"f":1.25,"z.z":1,"o":{"k":"v"}}',),
                                  ('{"d":5,"n":1,"f":2.5,"o":"plain","q":null}',)], "j string").selectExpr("parse_json(j) AS record")
    rows = sorted(records_to_table(recs).collect(), key=lambda r: r.f)
    assert [r.d for r in rows] == ["N/A", "5"] and [int(r.n) for r in rows] == [12345678901234567890, 1]
    assert [r.f for r in rows] == [1.25, 2.5] and [r.o for r in rows] == ['{"k":"v"}', "plain"]
    few = records_to_table(recs, max_columns=2).orderBy("f").collect()
    assert few[0].__fields__ == ["d", "f", "more_fields"]
    assert few[0].more_fields == {"n": "12345678901234567890", "z.z": "1", "o": '{"k":"v"}'}


def test_r7_keeps_source_columns(spark):
    from rowsift.operators import merge_verdicts

    rows = spark.createDataFrame([(0, "mine", True)], "row_id long, notes string, Verdict boolean")
    judged = spark.createDataFrame([(0, False, "b"), (0, False, "a")], "row_id long, verdict boolean, notes string")
    with pytest.raises(ValueError, match="notes"):
        merge_verdicts(rows, judged)
    out = merge_verdicts(rows, judged, names=("v", "why", "raw")).first()
    assert tuple(out) == (0, "mine", True, False, "a", None)  # judged twice: the smallest by content


def test_r6_keys_that_differ_in_case(spark, tmp_path):
    df = spark.createDataFrame([('{"a":1,"A":2}',), ('{"A":3,"a_1":"x"}',), ('{"b":true}',)], "t string") \
        .select(F.parse_json("t").alias("record"))
    out = records_to_table(df)
    assert out.columns == ["A", "a_2", "a_1", "b"]
    out.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted([(2, 1, None, None), (3, None, "x", None), (None, None, None, True)], key=repr)
