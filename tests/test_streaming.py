from lakemill.streaming.windows import tumbling

from .support import DATA


def test_stream_equals_batch(spark, tmp_path):
    path = f"{DATA}/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    want = sorted(map(tuple, tumbling(batch, "ts", ["event_type"], "value", "1 day").selectExpr("cast(begin as string)", "event_type", "n", "round(total, 4)").collect()))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = tumbling(stream, "ts", ["event_type"], "value", "1 day").writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(map(tuple, spark.table("tumbled").selectExpr("cast(begin as string)", "event_type", "n", "round(total, 4)").collect()))
    assert got == want
