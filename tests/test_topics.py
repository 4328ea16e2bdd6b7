from pyspark.sql import functions as F

from sensorloom.streaming import runner, topics


def test_topics_to_sinks(spark, tmp_path):
    rows = {"front": [(1, 3 * k, 1_000_000_000 + k * 100_000, 8.0) for k in range(40)], "rear": [(1, 3 * k + 1, 1_000_000_000 + k * 100_000, 8.0) for k in range(40)], "cmd": [(1, 3 * k + 2, 1_000_000_000 + k * 100_000, 0.0) for k in range(40)]}
    rows["rear"][7] = (1, 22, None, 8.0)
    for name, data in rows.items():
        spark.createDataFrame(data, topics.MESSAGE).coalesce(1).write.parquet(str(tmp_path / name))
    stream = topics.topic_streams(spark, {n: str(tmp_path / n) for n in rows})
    good, _ = topics.quarantined(stream)
    topics.publish(runner.estimate_stream(good), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/speed")).count() == 119
    assert spark.read.parquet(str(tmp_path / "out/diagnostics")).agg(F.sum("n")).first()[0] == 119
    assert spark.read.parquet(str(tmp_path / "out/slip")).count() == 0


def test_quarantine_keeps_every_message(spark):
    df = spark.createDataFrame([(1, 0, 5, 1.0), (1, None, 5, 1.0), (1, 2, None, 1.0), (1, 3, 5, float("nan")), (1, 4, 5, None)], topics.MESSAGE)
    good, bad = topics.quarantined(df)
    assert (good.count(), bad.count()) == (1, 4)


def test_release_and_blend(spark):
    fixes = spark.createDataFrame([(1, 10), (1, 30), (2, 5)], "run long, t long")
    starts = spark.createDataFrame([(1, 10), (2, 0)], "run long, t long")
    assert topics.until_released(fixes, starts, 15).count() == 2
    b = lambda x: round(spark.range(1).select(topics.blended(F.lit(0.0), F.lit(1.0), F.lit(x), F.lit(3.0))).first()[0], 6)
    assert b(4.0) == 1.0 and b(100.0) == 1.5
