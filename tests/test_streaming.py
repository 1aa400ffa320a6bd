from locusflow.config import Analysis, HardFilter
from locusflow.sources.adapter import sites
from locusflow.streaming import stats


def test_stream_equals_batch(spark, tmp_path):
    batch = sites(spark, "/root/testdata/sf0.001")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second run finds nothing new
        stats.start(stream, "2p2b", Analysis(), HardFilter(), out, str(tmp_path / "c")).awaitTermination()
    want = sorted(map(tuple, stats.statistics(batch, "2p2b", Analysis(), HardFilter()).collect()))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want and want
