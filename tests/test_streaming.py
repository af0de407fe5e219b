from conftest import TESTDATA
from rowsift.streaming import review_stream


def test_stream_review_matches_batch(spark, tmp_out):
    src = f"{tmp_out}/in"
    spark.read.parquet(f"{TESTDATA}/sf0.001/part.parquet").repartition(3).write.parquet(src)
    rules = [(1, "p_size", "ge", "10", "too small")]
    q = review_stream(spark, src, "p_name", "widget", rules, sink=f"{tmp_out}/out",
                      checkpoint=f"{tmp_out}/ckpt", max_files_per_trigger=1)
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_out}/out")
    batch = spark.read.parquet(src).where("lower(p_name) like '%widget%'")
    assert out.count() == batch.count()
    assert out.where("verdict").count() == batch.where("p_size >= 10").count()
