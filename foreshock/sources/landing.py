"""Series views over the given tables: event readings become station signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.config import SIGNALS
from foreshock.functions.numbers import floor_div, snap
from foreshock.functions.times import grid_index
from foreshock.operators.grid import interpolate_linear

# Which event type feeds which signal, the type that marks an event to forecast and its level.
SIGNAL_TYPES = {"rsam": "click", "mf": "view", "hf": "purchase", "dsar": "error"}
EVENT_TYPE = "signup"
EVENT_LEVEL = 250.0
USERS_PER_STATION = 50

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE"


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single readings: ``station, ts, us, idx, event_type, value, event_id``."""
    events = table(spark, sf_dir, "events", EVENTS_SCHEMA)
    return as_readings(events)


def as_readings(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.select(
        floor_div(F.col("user_id"), USERS_PER_STATION).alias("station"),
        ts.alias("ts"),
        F.unix_micros(ts).alias("us"),
        grid_index(ts).alias("idx"),
        "event_type",
        "value",
        "event_id",
    )


def binned(rows: DataFrame) -> DataFrame:
    """Mean reading per station, grid step and signal; partial means form before the shuffle."""
    return (
        rows.filter(F.col("event_type").isin(*SIGNAL_TYPES.values()))
        .groupBy("station", "idx")
        .agg(
            *[
                snap(F.avg(F.when(F.col("event_type") == kind, F.col("value")))).alias(signal)
                for signal, kind in SIGNAL_TYPES.items()
            ]
        )
    )


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(readings(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free signals on the 10-minute grid, from where all four are known."""
    filled = interpolate_linear(bins(spark, sf_dir), trim_leading=True)
    return filled.withColumns({s: snap(F.col(s)) for s in SIGNALS})


def marked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to forecast: ``station, te_us``."""
    return readings(spark, sf_dir).filter(
        (F.col("event_type") == EVENT_TYPE) & (F.col("value") >= EVENT_LEVEL)
    ).select("station", F.col("us").alias("te_us"))
