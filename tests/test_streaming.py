"""The stream gives the windows of the batch, duplicates removed."""

import datetime as dt

from pyspark.sql import functions as F

from tracelab.streaming.ingest import clean_stream, rollup_stream


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 3, t0 + dt.timedelta(minutes=11 * i), float(i % 600)) for i in range(900)]
    schema = "series_id INT, ts TIMESTAMP, value DOUBLE"
    for n in range(3):
        part = rows[n * 300 : (n + 1) * 300]
        spark.createDataFrame(part + part[:50], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = rollup_stream(clean_stream(stream, late="20 days"))
    q = out.writeStream.outputMode("update").format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {
        (r.series_id, r.bucket): (r.value, r.n)
        for r in spark.table("rolled").groupBy("series_id", "bucket").agg(F.max_by("value", "n").alias("value"), F.max("n").alias("n")).collect()
    }
    want = {}
    for s, t, v in rows:
        if v <= 480:
            k = (s, t.replace(minute=0))
            a, n = want.get(k, (0.0, 0))
            want[k] = (a + v, n + 1)
    assert got == want
