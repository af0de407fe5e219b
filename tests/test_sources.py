import pytest

from conftest import TESTDATA
from rowsift.sources import assemble_document, list_columns, list_tables, read_many, read_table

SF = f"{TESTDATA}/sf0.001"


def test_s1_read_and_missing(spark):
    assert read_table(spark, SF, "nation").count() == 25
    with pytest.raises(ValueError, match="Table 'nope' not found. Available tables: benchmark"):
        read_table(spark, SF, "nope")


def test_s1_csv_json(spark, tmp_out):
    spark.createDataFrame([(1, "a")], "id int, s string").write.option("header", True).csv(f"{tmp_out}/t")
    df = read_table(spark, tmp_out, "t", format="csv")
    assert df.columns == ["id", "s"] and df.first().id == 1


def test_s2_list_tables(spark, tmp_out):
    names = [r.table_name for r in list_tables(spark, SF).collect()]
    assert "lineitem" in names and len(names) == 14
    assert list_tables(spark, tmp_out + "/missing").count() == 0


def test_s3_list_columns(spark):
    cols = list_columns(read_table(spark, SF, "region")).collect()
    assert [(c.ordinal, c.name, c.type) for c in cols] == [(0, "r_regionkey", "int"), (1, "r_name", "string")]


def test_s4_read_many(spark):
    df = read_many(spark, [f"{SF}/region.parquet", f"{TESTDATA}/sf0.01/region.parquet"])
    got = {r.source_file: r["count"] for r in df.groupBy("source_file").count().collect()}
    assert sorted(got.values()) == [5, 5]  # one entry per file, of equal names too
    assert {k.rsplit("/", 2)[1] for k in got} == {"sf0.001", "sf0.01"}


def test_s5_pages(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 10, "c"), (2, 1, None), (2, 2, "z")],
                                  "doc_id long, page_no int, text string")
    for per_part in (None, 2, 1024):
        got = {r.doc_id: r.text for r in assemble_document(pages, pages_per_part=per_part).collect()}
        assert got == {1: "a\nb\nc", 2: "\nz"}


def test_s1_catalog_source(spark, records):
    records.createOrReplaceTempView("clinic_records")
    assert read_table(spark, "catalog:", "clinic_records").count() == 6
    with pytest.raises(ValueError, match="not found"):
        read_table(spark, "catalog:", "no_such_view")


def test_multi_line_json_array(spark, tmp_out):
    import json
    from rowsift.sources import read_json
    path = f"{tmp_out}/legacy.json"
    with open(path, "w") as fh:
        json.dump([{"a": 1, "b": "x"}, {"a": 2, "c": None}], fh, indent=4)
    rows = read_json(spark, path, multi_line=True).orderBy("a").collect()
    assert [(r.a, r.b) for r in rows] == [(1, "x"), (2, None)]


def test_shared_folder_required_on_a_cluster():
    """Outside local mode a missing spark.checkpoint.dir is an error, never a
    machine-local temporary folder; a configured folder is used as given."""
    import pytest

    from rowsift.session import shared_dir

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

    class Ctx:
        def __init__(self, master):
            self.master, self.dir = master, None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Session:
        def __init__(self, master, value):
            self.conf, self.sparkContext = Conf(value), Ctx(master)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session("yarn", None), "x")
    s = Session("spark://host:7077", "hdfs://nn/ckpt/")
    assert shared_dir(s, "k1").startswith("hdfs://nn/ckpt/rowsift/k1/")
    assert s.sparkContext.dir == "hdfs://nn/ckpt/"


def test_s2_lists_one_level(spark, tmp_path):
    from rowsift.sources import list_tables, list_table_names

    for name in ("a.parquet", "b", "b.csv", "_hidden", ".dot", "deep"):
        (tmp_path / name).mkdir()
    (tmp_path / "deep" / "inner.parquet").mkdir()
    (tmp_path / "file.json").write_text("{}")
    (tmp_path / "sub").mkdir()
    want = ["a", "b", "deep", "file", "sub"]
    for source in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}", f"{tmp_path}/sub/.."):
        assert list_table_names(spark, source) == want
    assert [r.table_name for r in list_tables(spark, str(tmp_path)).collect()] == want
    assert list_table_names(spark, f"{tmp_path}/absent") == []


def test_s1_csv_is_split_among_tasks(spark, tmp_path):
    """One CSV file is many tasks; fields with line ends are read on request."""
    lines = "".join(f'{i},"text {i}, quoted ""q"" {"x" * 80}"\n' for i in range(20_000))
    (tmp_path / "t.csv").write_text("id,s\n" + lines)
    (tmp_path / "m.csv").write_text('id,s\n1,"two\nlines"\n2,one\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        df = read_table(spark, str(tmp_path), "t", format="csv", schema="id long, s string")
        assert df.rdd.getNumPartitions() > 5
        rows = df.collect()
        assert len(rows) == 20_000 and sorted(r.id for r in rows) == list(range(20_000)) and all('"q"' in r.s for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    multi = read_table(spark, str(tmp_path), "m", format="csv", multi_line=True)
    assert [(r.id, r.s) for r in multi.orderBy("id").collect()] == [(1, "two\nlines"), (2, "one")]
