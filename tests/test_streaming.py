"""Streams against the same work in batch."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from foreshock.config import Geometry
from foreshock.operators import alerts
from foreshock.streaming import online

START = dt.datetime(2024, 1, 1)


def write(spark, folder, name, rows):
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])
    df = spark.createDataFrame(pdf, "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE")
    df.coalesce(1).write.mode("append").parquet(str(folder / name))


def reading(i, minutes, value, kind="click"):
    return (i, START + dt.timedelta(minutes=minutes), 1, kind, float(value))


def stream_of(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return online.as_readings(spark.readStream.schema(online.EVENTS_SCHEMA).parquet(str(folder / "*")))


def test_ingest_over_two_runs_lets_the_refetch_win(spark, tmp_path):
    keys, out = ("station", "idx", "event_type"), str(tmp_path / "out")
    step = online.ingest_step(out, keys, "event_id")

    def run():
        cols = ["station", "idx", "event_type", "value", "event_id"]
        online.drain_batches(stream_of(spark, tmp_path / "in").select(*cols), step, str(tmp_path / "check"))

    write(spark, tmp_path / "in", "a", [reading(1, 5, 1), reading(2, 6, 2), reading(3, 15, 3)])
    run()
    write(spark, tmp_path / "in", "b", [reading(0, 7, 9), reading(4, 25, 4)])
    run()
    got = sorted(r.value for r in online.read_ingested(spark, out, keys).collect())
    assert got == [3.0, 4.0, 9.0]
    run()
    assert online.read_ingested(spark, out, keys).count() == 3


def test_complete_windows_equal_batch(spark, tmp_path):
    geom = Geometry(1.0, 0.5, 1.0)
    rows = [reading(i, 10 * i, i % 37) for i in range(144 * 5)]
    write(spark, tmp_path / "in", "a", rows)
    source = stream_of(spark, tmp_path / "in").select("station", F.lit("rsam").alias("stream"), "ts", F.col("value").alias("x"))
    stats = online.window_stats(source, geom, "1 hour")
    online.drain(stats, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r.win_end: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    begin = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    full = [r for r in got.values() if r.n == geom.iw]
    assert len(full) >= 7
    for r in full:
        first = (r.win_end - begin) // 600 - 144
        x = [i % 37 for i in range(first, first + 144)]
        assert r.mean * 144 == sum(x) or abs(r.mean - sum(x) / 144) < 1e-9
        assert (r.maximum, r.minimum) == (max(x), min(x))


def test_sessions_equal_batch_alerts(spark, tmp_path):
    geom = Geometry()
    hop = geom.hop_seconds // 60
    hot = [0, 1, 5, 9, 14, 30, 31]
    rows = [reading(i, hop * i, 1.0 if i in hot else 0.0) for i in range(60)]
    write(spark, tmp_path / "in", "a", rows)
    source = stream_of(spark, tmp_path / "in")
    online.drain(online.alert_sessions(source.filter("value > 0.8").select("station", "ts"), online.session_gap(geom), "1 second"),
                 str(tmp_path / "out"), str(tmp_path / "check"))
    begin = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    cons = spark.createDataFrame([(0, begin + i * geom.hop_seconds, 1.0 if i in hot else 0.0) for i in range(60)],
                                 "station BIGINT, win_end BIGINT, consensus DOUBLE")
    batch = {(r.start * 1_000_000, int(r.stop) * 1_000_000) for r in alerts.alert_islands(cons, geom, 0.8).collect()}
    got = {(r.start_us, r.stop_us) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(batch) == 3
    # The last session is still open: nothing later than its own rows has arrived.
    assert got == {b for b in batch if b[0] < (begin + 30 * geom.hop_seconds) * 1_000_000}


def test_flag_step_appends_state(spark, tmp_path):
    cons = spark.createDataFrame([(0, 1000, 0.9)], "station BIGINT, win_end BIGINT, consensus DOUBLE")
    cons.write.parquet(str(tmp_path / "c"))
    step = online.flag_step(str(tmp_path / "c"), cons.select("station"), 2000, Geometry(), str(tmp_path / "f"))
    step(cons, 7)
    assert spark.read.parquet(str(tmp_path / "f")).first().in_alert == 1
