"""Streams read to their end against the same files read as a table."""

from datetime import datetime, timedelta

from larkspur import col
from larkspur import len as count
from larkspur.streaming import drop_repeats, group_by_window, scan_stream, sink_stream


def events(spark, path):
    start = datetime(2024, 1, 1)
    for part in range(3):  # later files have later times
        rows = [(k % 7, "ab"[k % 2], start + timedelta(minutes=part * 60 + k), float(k)) for k in range(60)]
        spark.createDataFrame(rows, "id int, kind string, ts timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def test_windows_of_a_stream_are_those_of_the_table(spark, tmp_path):
    table = events(spark, f"{tmp_path}/in")
    stream = scan_stream(f"{tmp_path}/in", table.schema, files_per_batch=1).filter(col("v") >= 5)
    out = group_by_window(stream, "ts", "30 minutes", "kind", late="10 minutes").agg(count().alias("n"), col("v").sum().alias("total"))
    sink_stream(out, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    found = {(r.window_start, r.kind): (r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    plain: dict = {}
    for r in table.where("v >= 5").collect():
        key = r.ts.replace(minute=r.ts.minute // 30 * 30), r.kind
        n, total = plain.get(key, (0, 0.0))
        plain[key] = n + 1, total + r.v
    last = max(k for k, _ in plain)
    closed = {k: v for k, v in plain.items() if k[0] < last}
    assert closed == {k: v for k, v in found.items() if k[0] < last} and len(found) >= len(closed) > 4


def test_repeats_of_a_stream_go(spark, tmp_path):
    table = events(spark, f"{tmp_path}/in")
    sink_stream(drop_repeats(scan_stream(f"{tmp_path}/in", table.schema), "id", time="ts", late="10 days"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(7))
