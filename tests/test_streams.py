"""Windowed counts of a stream."""

from topiloom.streaming.assign import topic_counts


def test_topic_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    from pyspark.sql import functions as F

    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = topic_counts(stream, span="1 day").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()
