import pandas as pd

from tesselwork.operators.sequence import islands
from tesselwork.streaming import events as streams

FOLDER = "/root/testdata/sf0.001"


def drained(spark, frame, name, mode="append"):
    frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def source(spark):
    static = spark.read.parquet(f"{FOLDER}/events.parquet")
    return static, spark.readStream.schema(static.schema).parquet(f"{FOLDER}/events.parquet*")


def test_windowed_counts_equal_the_batch(spark):
    static, live = source(spark)
    got = drained(spark, streams.windowed_counts(live, "ts", "event_type", "1 day"), "w", "complete").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, streams.windowed_counts(static, "ts", "event_type", "1 day").collect())) and got


def test_sessions_equal_the_batch(spark):
    static, live = source(spark)
    got = drained(spark, streams.session_counts(live, "ts", "user_id"), "s", "complete").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, streams.session_counts(static, "ts", "user_id").collect())) and got


def test_running_islands_equal_the_batch(spark):
    static, live = source(spark)
    got = drained(spark, streams.running_islands(live, "user_id", "event_type", "event_id"), "i").toPandas()
    want = islands(static, "user_id", ["event_id"], "event_type").select("user_id", "event_id", "event_type", "run").toPandas()
    key = ["user_id", "event_id"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)


def test_first_seen(spark):
    _, live = source(spark)
    got = drained(spark, streams.first_seen(live, "ts", ["user_id"], "365 days"), "f").toPandas()
    assert got.user_id.is_unique and len(got)
