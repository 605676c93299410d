from collections import Counter

from pyspark.sql import functions as F


def test_events_by_area_and_window(spark, tmp_path):
    from urbanlattice.functions import geometry as G
    from urbanlattice.streaming.events import counts_by_area

    areas = spark.createDataFrame([(k, 10.0 * k) for k in range(4)], "id bigint, x0 double").select("id", G.rectangle(F.col("x0"), F.lit(0.0), F.col("x0") + 9, F.lit(9.0)).alias("geom"))
    rows = [(i, float(i * 7 % 50), float(i % 12), i * 30) for i in range(200)]
    spark.createDataFrame(rows, "id bigint, x double, y double, s bigint").withColumn("ts", F.timestamp_seconds("s")).repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, x double, y double, s bigint, ts timestamp").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    # all files come within one watermark, so that none is late
    counted = counts_by_area(stream, areas, "10 minutes", "1 day", 20.0)
    run = counted.writeStream.outputMode("update").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r["window"]["start"].timestamp(), r["area"]): r["n"] for r in spark.table("counted").orderBy("n").collect()}
    want = Counter((s // 600 * 600, k) for _, x, y, s in rows for k in range(4) if 10 * k <= x <= 10 * k + 9 and y <= 9)
    assert got == dict(want)
