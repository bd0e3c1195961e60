"""Window labels and time-range filters around events.

Events are ``station, te_us`` (epoch microseconds). Range conditions are met by bucketing time, so each join is
an equality join on (station, bucket) whichever side is large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.config import STEP_SECONDS, Geometry
from foreshock.functions.numbers import floor_div
from foreshock.functions.times import to_seconds

DAY = 86400
MICRO = 1_000_000


def _event_buckets(events: DataFrame, width: int, reach: int) -> DataFrame:
    """Events by time bucket, as one short array per (station, bucket).

    Only the first and last event of a step can decide whether a range no shorter than the step holds an event of
    it, so at most two per step are kept, whatever their number. Steps are those of the grid, or the ranges' length if that is less.
    """
    step = min(STEP_SECONDS * MICRO, max(width, 1), max(reach, 1))
    kept = events.groupBy("station", floor_div(F.col("te_us"), step).alias("step")).agg(
        F.min("te_us").alias("a"), F.max("te_us").alias("b")
    )
    buckets = F.sequence(floor_div(F.col("a") - reach, width), floor_div(F.col("b"), width))
    return (
        kept.select("station", "a", "b", F.explode(buckets).alias("bucket"))
        .groupBy("station", "bucket")
        .agg(F.flatten(F.collect_set(F.array("a", "b"))).alias("tes"))
    )


def label_windows(dates: DataFrame, events: DataFrame, geom: Geometry) -> DataFrame:
    """Add ``label``: 1 when an event falls strictly between the window date and the look-forward after it."""
    look = geom.look_micros
    buckets = _event_buckets(events, look, look)
    dated = dates.withColumn("bucket", floor_div(F.col("win_end") * MICRO, look))
    hit = F.expr(f"exists(tes, te -> te > win_end * {MICRO} AND te < win_end * {MICRO} + {look})")
    return (
        dated.join(buckets, ["station", "bucket"], "left")
        .withColumn("label", F.coalesce(hit, F.lit(False)).cast("double"))
        .drop("bucket", "tes")
    )


def exclude_ranges(df: DataFrame, ranges: Sequence[tuple], column: str = "win_end") -> DataFrame:
    """Drop rows with ``t0 <= t < t1`` for any of the listed ranges."""
    out = df
    for t0, t1 in ranges:
        out = out.filter((F.col(column) < to_seconds(t0)) | (F.col(column) >= to_seconds(t1)))
    return out


def exclude_range_table(df: DataFrame, ranges: DataFrame, column: str = "win_end") -> DataFrame:
    """The same for a table of ranges ``station, t0, t1`` (epoch seconds): anti-join by day."""
    days = F.sequence(floor_div(F.col("t0"), DAY), floor_div(F.col("t1"), DAY))
    listed = ranges.select("station", F.col("t0").alias("r0"), F.col("t1").alias("r1"), F.explode(days).alias("day"))
    dated = df.withColumn("day", floor_div(F.col(column), DAY))
    inside = (
        (dated["station"] == listed["station"])
        & (dated["day"] == listed["day"])
        & (dated[column] >= listed["r0"])
        & (dated[column] < listed["r1"])
    )
    return dated.join(listed, inside, "left_anti").drop("day")


def around_events(events: DataFrame, days: float) -> DataFrame:
    """Ranges ``station, t0, t1`` reaching ``days`` to both sides of each event."""
    reach = round(days * DAY * MICRO)
    return events.select(
        "station", ((F.col("te_us") - reach) / MICRO).alias("t0"), ((F.col("te_us") + reach) / MICRO).alias("t1")
    )


def event_neighbourhood(labelled: DataFrame, events: DataFrame, days: float = 5.0) -> DataFrame:
    """Positive windows closer than ``days`` to each event: ``station, te_us`` and the window's columns."""
    reach = round(days * DAY * MICRO)
    t = F.col("win_end") * MICRO
    near = events.select(
        "station",
        "te_us",
        F.explode(
            F.sequence(floor_div(F.col("te_us") - reach, reach), floor_div(F.col("te_us") + reach, reach))
        ).alias("bucket"),
    )
    positive = labelled.filter("label > 0").withColumn("bucket", floor_div(t, reach))
    return positive.join(near, ["station", "bucket"]).filter(F.abs(F.col("te_us") - t) < reach).drop("bucket")


def training_range(df: DataFrame, ti=None, tf=None, column: str = "win_end") -> DataFrame:
    """Rows with ``ti <= t < tf``."""
    out = df if ti is None else df.filter(F.col(column) >= to_seconds(ti))
    return out if tf is None else out.filter(F.col(column) < to_seconds(tf))


def unmatched_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Windows that occur on one side only; empty when matrix and labels match."""
    keys = ["station", "win_end"]
    left = features.select(*keys).distinct()
    right = labels.select(*keys).distinct()
    return (
        left.join(right, keys, "left_anti").withColumn("side", F.lit("features"))
    ).unionByName(right.join(left, keys, "left_anti").withColumn("side", F.lit("labels")))
