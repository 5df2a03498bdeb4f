"""The event queue as a stream."""

from pyspark.sql import functions as F

from cinderplan.streaming import events


def test_first_arrivals_and_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", k % 2, k % 3, 0) for k, m in enumerate(range(0, 59, 2))]
    d = spark.createDataFrame(rows, "ts string, rz int, r int, c int").withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"file://{tmp_path}/in")
    for name, out, mode in (("first", events.first_arrivals(stream), "append"), ("windows", events.burned_by_window(stream, every="10 minutes"), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("first").select("rz", "r", "c").distinct().count() == spark.table("first").count() == 6
    assert sum(r.n for r in spark.table("windows").collect()) == len(rows)
