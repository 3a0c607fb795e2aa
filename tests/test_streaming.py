"""Queries on streams give what they give on tables, and a restart doesn't repeat rows."""

import datetime as dt

from tessera import F
from tessera.streaming.stream import run_available, stream_parquet, windowed_counts

KIND = "id long, ts timestamp, kind string"


def events(spark, ids):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, at + dt.timedelta(minutes=i), "ab"[i % 2]) for i in ids], KIND)


def test_rows_once_over_restarts(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    events(spark, range(10)).write.parquet(src)
    q = lambda: stream_parquet(spark, src, KIND, 1).where(["kind", "==", "a"]).select({"id": "id", "twice": F.id * 2})
    run_available(q(), out, check)
    events(spark, range(10, 20)).write.mode("append").parquet(src)
    run_available(q(), out, check)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(i, 2 * i) for i in range(0, 20, 2)]


def test_windows(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    events(spark, range(60)).coalesce(1).write.parquet(src)
    counted = windowed_counts(stream_parquet(spark, src, KIND).df, "ts", "30 minutes", "kind", "10 minutes")
    job = counted.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted((r.window.start.minute, r.kind, r.n) for r in spark.table("windows").collect()) == [(0, "a", 15), (0, "b", 15), (30, "a", 15), (30, "b", 15)]
    batch = windowed_counts(events(spark, range(60)), "ts", "30 minutes", "kind", "10 minutes")
    assert batch.count() == 4
