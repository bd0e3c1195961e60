"""The online cycle as streams: ingest, sliding features, votes, alert sessions, alert state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.config import Geometry
from foreshock.operators import alerts, consensus, store, trees
from foreshock.operators.grid import dedup_last
from foreshock.sources.landing import EVENTS_SCHEMA, as_readings

LATE = "1 day"


def reading_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """Readings as files arrive in a folder."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", pattern).parquet(folder)
    return as_readings(raw)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is available to Parquet and stop."""
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def drain_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    writer = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


# ---- ingest ----------------------------------------------------------------------------------------------


def ingest_step(path: str, keys: tuple[str, ...], seq: str) -> Callable[[DataFrame, int], None]:
    """One batch: its last row per key, written to a folder of its own. A repeated batch overwrites itself, so
    every reading counts once; a refetched day needs no rewrite of what is stored."""

    def step(batch: DataFrame, number: int) -> None:
        dedup_last(batch, keys, seq).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def read_ingested(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """Stored rows with refetches applied: per key the row of the latest batch."""
    return dedup_last(spark.read.parquet(path), keys, "batch").drop("batch")


# ---- sliding features ------------------------------------------------------------------------------------


def window_stats(stream: DataFrame, geom: Geometry, late: str = LATE) -> DataFrame:
    """Count, mean, deviation and extremes per station, stream and window: ``x`` at ``ts``.

    The window is dated by its end and emitted once, when the watermark has passed it.
    """
    width, hop = f"{geom.window_seconds} seconds", f"{geom.hop_seconds} seconds"
    return (
        stream.withWatermark("ts", late)
        .groupBy("station", "stream", F.window("ts", width, hop))
        .agg(
            F.count("x").alias("n"),
            F.avg("x").alias("mean"),
            F.stddev_pop("x").alias("standard_deviation"),
            F.max("x").alias("maximum"),
            F.min("x").alias("minimum"),
        )
        .select(
            "station", "stream", F.unix_seconds("window.end").alias("win_end"), "n", "mean", "standard_deviation", "maximum", "minimum"
        )
    )


# ---- votes and alert state -------------------------------------------------------------------------------


def score_step(rules: DataFrame, n_models: int, path: str) -> Callable[[DataFrame, int], None]:
    """Votes of frozen models on each batch of finished windows, averaged to a consensus per window."""

    def step(batch: DataFrame, number: int) -> None:
        rows = store.melt(batch.drop("n"))
        ys = consensus.consensus(trees.predict_rules(rows, rules), n_models)
        ys.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def flag_step(consensus_path: str, stations: DataFrame, now: DataFrame | int, geom: Geometry, path: str, level: float = alerts.ALERT_LEVEL):
    """Alert state after each batch, from the consensus stored so far."""

    def step(batch: DataFrame, number: int) -> None:
        ys = batch.sparkSession.read.parquet(consensus_path)
        alerts.alert_flag(ys, stations, now, geom, level).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def alert_sessions(stream: DataFrame, gap_seconds: int, late: str = LATE) -> DataFrame:
    """Alerts as sessions of exceedances (``station, ts``): a session runs until one gap after its last row,
    and a row exactly one gap later still joins."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("station", F.session_window("ts", f"{gap_seconds} seconds").alias("session"))
        .agg(F.count("*").alias("n"))
        .select(
            "station", F.unix_micros("session.start").alias("start_us"), F.unix_micros("session.end").alias("stop_us"), "n"
        )
    )


def session_gap(geom: Geometry) -> int:
    """Gap that joins exceedances into one alert."""
    return round(geom.alert_span * geom.hop_seconds)
