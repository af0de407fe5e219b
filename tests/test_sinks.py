import pytest

import datetime
import json
import os

from rowsift.operators import RunLog
from rowsift.sources import (
    add_table,
    append_json,
    output_names,
    read_json,
    write_json,
    write_results,
    write_table,
)


def test_k1_k2_json(spark, tmp_out, records):
    path = f"{tmp_out}/r.json"
    write_json(records.where("PatientID < 3"), path)
    with pytest.raises(Exception):
        write_json(records, path)  # new means new
    other = spark.createDataFrame([(9, "x")], "PatientID long, Extra string")
    append_json(other, path)
    back = read_json(spark, path)
    assert sorted(back.columns) == ["Age", "DiseaseName", "Dose", "Extra", "PatientID"]
    assert sorted(r.PatientID for r in back.collect()) == [1, 2, 9]
    assert back.where("PatientID = 9").first().Age is None


def test_k2_refuses_non_records(spark, tmp_out):
    bad = f"{tmp_out}/bad.json"
    spark.createDataFrame([("[1, 2]",), ("not json",)], "value string").write.text(bad)
    with pytest.raises(ValueError, match="something else than JSON records"):
        append_json(spark.createDataFrame([(1,)], "a int"), bad)
    assert spark.read.text(bad).count() == 2  # unchanged


def test_k2_foreign_jsonl_accepted(spark, tmp_out):
    good = f"{tmp_out}/good.json"
    spark.createDataFrame([('{"a": 1}',), ("",)], "value string").write.text(good)
    append_json(spark.createDataFrame([(2,)], "a long"), good)
    assert sorted(r.a for r in read_json(spark, good).collect()) == [1, 2]


def test_k3_k4_names(spark, tmp_out, records):
    write_table(records, tmp_out, "t")
    with pytest.raises(Exception):
        write_table(records, tmp_out, "t")
    assert add_table(records, tmp_out, "t") == "t_1"
    assert add_table(records, tmp_out, "t") == "t_2"
    assert spark.read.parquet(f"{tmp_out}/t_2").count() == 6


def test_k5_names_and_both_outputs(spark, tmp_out, records):
    assert output_names("clinic.xlsx", "Sheet1", "DiseaseName") == (
        "clinic_by_DiseaseName_Analyzed", "Sheet1_by_DiseaseName_Analyzed")
    out = write_results(records, tmp_out, "clinic.xlsx", "Sheet1", "DiseaseName")
    assert spark.read.parquet(out["table_path"]).count() == 6
    assert read_json(spark, out["json_path"]).count() == 6
    again = write_results(records, tmp_out, "clinic.xlsx", "Sheet1", "DiseaseName", option="same_file")
    assert again["table_name"] == "Sheet1_by_DiseaseName_Analyzed_1"
    assert read_json(spark, out["json_path"]).count() == 12


def test_k6_log(spark):
    log = RunLog()
    log.add("filter", "Found 2 records", 2)
    df = log.to_df(spark)
    assert df.columns == ["step", "message", "rows", "ts"] and df.first().rows == 2
    log.add("a", "b")
    assert log.to_df(spark).where("step = 'a'").first().rows is None


def test_k6_time_is_an_instant(spark):
    """The logged time is now, in whatever zone the session shows it."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        log = RunLog()
        log.add("x", "y")
        micros = log.to_df(spark).selectExpr("unix_micros(ts) AS t").first().t
        now = datetime.datetime.now(datetime.timezone.utc).timestamp()
        assert abs(micros / 1e6 - now) < 60
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("single_file", [True, False])
def test_k2_adds_to_an_indented_list(spark, tmp_out, single_file):
    """The form with one indented list per file: old records, then the new ones."""
    path = f"{tmp_out}/legacy.json"
    if not single_file:
        os.makedirs(path)
    with open(path if single_file else f"{path}/a.json", "w") as fh:
        json.dump([{"a": 1, "b": "x"}, {"a": 2, "c": None}], fh, indent=4)
    for k in (3, 4):
        append_json(spark.createDataFrame([(k, True)], "a long, d boolean"), path)
    back = read_json(spark, path)
    assert sorted(r.a for r in back.collect()) == [1, 2, 3, 4] and set(back.columns) >= {"a", "b", "d"}
    assert not os.path.exists(path + "_rs_new")


def test_k2_refuses_lists_of_other_things(spark, tmp_out):
    path = f"{tmp_out}/odd.json"
    with open(path, "w") as fh:
        json.dump([{"a": 1}, 5], fh, indent=1)
    with pytest.raises(ValueError, match="something else"):
        append_json(spark.createDataFrame([(1,)], "a int"), path)
    assert json.load(open(path)) == [{"a": 1}, 5]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_k3_formats_round_trip(spark, tmp_out, records, fmt):
    from rowsift.sources import read_table

    odd = records.withColumnRenamed("DiseaseName", "Dx, name").where("PatientID <> 4")
    write_table(odd, tmp_out, f"t_{fmt}", format=fmt)
    back = read_table(spark, tmp_out, f"t_{fmt}", format=fmt, schema=odd.schema)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, odd.collect()), key=repr)
    assert sorted(read_table(spark, tmp_out, f"t_{fmt}", format=fmt).columns) == sorted(odd.columns)


def test_k5_chosen_targets(spark, tmp_out, records):
    write_json(records.limit(1), f"{tmp_out}/mine/all.json")
    out = write_results(records, f"{tmp_out}/out", "c.parquet", "c", "Age", option="same_file",
                        json_target=f"{tmp_out}/mine/all.json", table_source=f"{tmp_out}/lake")
    assert read_json(spark, out["json_path"]).count() == 7 and out["json_path"].endswith("mine/all.json")
    assert spark.read.parquet(f"{tmp_out}/lake/{out['table_name']}").count() == 6


def test_k5_same_base_and_sheet_names(spark, tmp_out, records):
    out = write_results(records, tmp_out, "clinic.parquet", "clinic", "DiseaseName", option="same_file")
    assert out["table_name"] == "clinic_by_DiseaseName_Analyzed"
    again = write_results(records, tmp_out, "clinic.parquet", "clinic", "DiseaseName", option="same_file")
    assert again["table_name"] == "clinic_by_DiseaseName_Analyzed_1"
