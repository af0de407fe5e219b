import pytest

from conftest import ids
from rowsift.functions import normalize_term, text_value
from rowsift.operators import (
    distinct_values,
    filter_any_term,
    filter_contains,
    filter_related,
    is_empty,
    keep_columns,
    match_count,
    observe_count,
)
from rowsift.sources import default_column


@pytest.mark.parametrize("term,expected", [
    ("diabetes", [1, 2]),
    ("DIABETES|asthma", [1, 2, 6]),
    ("éclampsie", [5]),
    ("^d", [2]),
    ("none", []),
])
def test_f1_regex(records, term, expected):
    assert ids(filter_contains(records, "DiseaseName", term)) == expected


def test_f1_bad_regex_fails_on_driver(records):
    with pytest.raises(ValueError, match="Invalid search pattern"):
        filter_contains(records, "DiseaseName", "asthma (")


def test_f1_literal(records):
    assert ids(filter_contains(records, "DiseaseName", "asthma (", literal=True)) == [6]


def test_f1_null_as(records):
    assert ids(filter_contains(records, "DiseaseName", "none", null_as="None")) == [4]


def test_f1_numeric_column(records):
    assert ids(filter_contains(records, "Age", "4")) == [1, 3]


def test_f1_unicode_word_class(spark):
    df = spark.createDataFrame([(1, "café"), (2, "cafe"), (3, "caf-")], "id long, t string")
    assert ids(filter_contains(df, "t", r"caf\w$"), "id") == [1, 2]


def test_guards(records):
    with pytest.raises(ValueError, match="Column 'Nope' not found"):
        filter_contains(records, "Nope", "x")
    with pytest.raises(ValueError, match="search term"):
        filter_contains(records, "DiseaseName", "   ")
    with pytest.raises(ValueError, match="filter column"):
        filter_contains(records, "", "x")


def test_default_column(records, spark):
    assert default_column(records) == "DiseaseName"
    assert default_column(records.drop("DiseaseName")) == "PatientID"
    assert default_column(spark.range(1).select()) is None


def test_f2_any_term(records):
    assert ids(filter_any_term(records, "DiseaseName", ["GLYCEMIA", "severe)"])) == [3, 6]
    assert ids(filter_any_term(records, "DiseaseName", [])) == []


def test_f2_terms_frame_both_paths(records, spark):
    terms = spark.createDataFrame([("GLYCEMIA",), ("severe)",), (None,)], "value string")
    assert ids(filter_any_term(records, "DiseaseName", terms)) == [3, 6]
    assert ids(filter_any_term(records, "DiseaseName", terms, max_list_values=0)) == [3, 6]


def test_f3_related(records, spark):
    assert ids(filter_related(records, "DiseaseName", "diabetes", ["Hyperglycemia"])) == [1, 2, 3]
    assert ids(filter_related(records, "DiseaseName", "diabetes", [])) == [1, 2]
    assert ids(filter_related(records, "DiseaseName", "diabetes", None)) == [1, 2]
    frame = spark.createDataFrame([("hyperGLYCEMIA",)], "value string")
    assert ids(filter_related(records, "DiseaseName", "diabetes", frame)) == [1, 2, 3]
    assert ids(filter_related(records, "DiseaseName", "diabetes", frame, max_list_values=0)) == [1, 2, 3]


def test_f4_first_seen(records):
    out = distinct_values(records, "DiseaseName", order_by="PatientID", limit=3).collect()
    assert [r.value for r in out] == ["Type 2 Diabetes", "diabetes mellitus", "Hyperglycemia"]
    assert distinct_values(records, "DiseaseName", "PatientID", limit=None).count() == 5


def test_f7_count_and_empty(records):
    kept = filter_contains(records, "DiseaseName", "diabetes")
    assert match_count(kept).first().rows_kept == 2
    assert not is_empty(kept)
    assert is_empty(filter_contains(records, "DiseaseName", "zzz"))
    observed, obs = observe_count(kept)
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 2


def test_e1_e2_e3(records, spark):
    assert records.select(text_value("Age")).where("PatientID = 6").first()[0] is None
    assert records.select(text_value("Age", "nan")).where("PatientID = 6").first()[0] == "nan"
    df = spark.createDataFrame([("\t  Mixed Case \n",)], "t string")
    assert df.select(normalize_term("t")).first()[0] == "Mixed Case"
    assert df.select(normalize_term("t", lower=True)).first()[0] == "mixed case"
    assert keep_columns(records, "PatientID", "Age").columns == ["PatientID", "Age"]
    assert keep_columns(records).columns == records.columns


def test_lower_term_reproduces_original(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "123")], "id long, t string")
    # \D (non-digit) as written; the original tool lower-cased it to \d.
    assert ids(filter_contains(df, "t", r"\D"), "id") == [1]
    assert ids(filter_contains(df, "t", r"\D", lower_term=True), "id") == [2]


def test_lists_and_frames_agree(spark):
    """One rule for both forms and every length: empty terms, nulls, letters that engines fold differently."""
    fillers = [f"w{i}" for i in range(200)]
    rows = [(1, "aazzb"), (2, "none"), (3, None), (4, "W12!"), (5, "x \u1c89 y"), (6, "\u0130stanbul"), (7, ""), (8, "stra\u00dfe")]
    df = spark.createDataFrame(rows, "id long, t string")
    for terms in (["ZZ"], ["\u1c8a"], ["\u1c8a", *fillers[:20]], ["\u1c89", *fillers], ["ZZ", None, *fillers], ["i\u0307s"],
                  [""], ["", *fillers], [], ["STRASSE", "STRA\u00dfE"]):
        frame = spark.createDataFrame([(t,) for t in terms], "value string")
        forms = [ids(filter_any_term(df, "t", x, max_list_values=n), "id") for x in (terms, frame) for n in (0, 8, 64, 1000)]
        assert all(f == forms[0] for f in forms), (terms[:2], forms)
        related = [ids(filter_related(df, "t", "none", x, max_list_values=n), "id") for x in (terms, frame) for n in (0, 64)]
        assert all(f == sorted({*forms[0], 2}) for f in related)
    assert ids(filter_any_term(df, "t", [""]), "id") == [1, 2, 4, 5, 6, 7, 8]
    assert ids(filter_any_term(df, "t", ["\u1c8a", *fillers]), "id") == [4, 5]


def test_dotted_names(spark, records):
    df = records.withColumnRenamed("DiseaseName", "Dx.name").withColumnRenamed("Dose", "Dose (mg.)`")
    assert ids(filter_contains(df, "Dx.name", "diabetes")) == [1, 2]
    assert ids(filter_any_term(df, "Dx.name", ["asthma"])) == [6]
    assert ids(filter_related(df, "Dx.name", "asthma", spark.createDataFrame([("hyper",)], "value string"))) == [3, 6]
    assert keep_columns(df, "Dx.name", "Dose (mg.)`").columns == ["Dx.name", "Dose (mg.)`"]
    assert distinct_values(df, "Dx.name", order_by="Dose (mg.)`").count() == 5
