"""Overlapping windows over gridded series.

Window ``k`` of a station is dated by its end ``win_end`` (epoch seconds) and holds the ``iw`` samples before
it, not the sample at its own date. ``e`` is the grid index of the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreshock.config import CHUNK, STEP_SECONDS, Geometry
from foreshock.functions.numbers import ceil_div, floor_div
from foreshock.operators.chunks import place


def window_bounds(
    geom: Geometry, ti: float | None = None, tf: float | None = None
) -> tuple[Column, Column, Column]:
    """Columns of a row with ``t0, t1``: first window date (seconds), its grid index, number of windows.

    A start too close to the series start moves to one window after it, an end beyond the data to its last
    sample.
    """
    earliest = (F.col("t0") + geom.iw) * STEP_SECONDS
    latest = F.col("t1") * STEP_SECONDS
    first = earliest if ti is None else F.greatest(earliest, F.lit(math.ceil(ti)))
    last = latest if tf is None else F.least(latest, F.lit(math.floor(tf)))
    count = F.greatest(floor_div(last - first, geom.hop_seconds), F.lit(0))
    return first, ceil_div(first, STEP_SECONDS), count


def window_dates(
    df: DataFrame, geom: Geometry, ti: float | None = None, tf: float | None = None
) -> DataFrame:
    """All windows per station: ``station, k, e, win_end``. One aggregate, no pass over ordered data."""
    extent = df.groupBy("station").agg(F.max("t0").alias("t0"), F.max("t1").alias("t1"))
    first, e0, count = window_bounds(geom, ti, tf)
    return (
        extent.select("station", first.alias("first"), e0.alias("e0"), count.alias("nw"))
        .filter("nw > 0")
        .select("station", "first", "e0", F.explode(F.sequence(F.lit(0), F.col("nw") - 1)).alias("k"))
        .select(
            "station",
            "k",
            (F.col("e0") + F.col("k") * geom.hop).alias("e"),
            (F.col("first") + F.col("k") * geom.hop_seconds).alias("win_end"),
        )
    )


def window_runs(wanted: DataFrame, geom: Geometry) -> DataFrame:
    """Windows (``station, k, e``) as runs of consecutive ones: ``station, k_from, k_to`` and the samples ``lo <= idx < hi`` that
    they hold. The order is over a station's window numbers, which the calendar bounds."""
    order = Window.partitionBy("station").orderBy("k")
    numbered = wanted.select("station", "k", "e").distinct().withColumn("run", F.col("k") - F.row_number().over(order))
    return numbered.groupBy("station", "run").agg(
        F.min("k").alias("k_from"), F.max("k").alias("k_to"), (F.min("e") - geom.iw).alias("lo"), F.max("e").alias("hi")
    ).drop("run")


def run_chunks(runs: DataFrame, before: int = 0, size: int = CHUNK) -> DataFrame:
    """Each run once per chunk of the series that it reads, or that lies ``before`` samples ahead of it."""
    return runs.select(
        "*", F.explode(F.sequence(floor_div(F.col("lo") - before, size), floor_div(F.col("hi") - 1, size))).alias("chunk")
    )


def prune_series(df: DataFrame, runs: DataFrame, before: int = 0, size: int = CHUNK) -> DataFrame:
    """The rows of a series that runs of windows read, with ``before`` rows ahead of each. Ranges are merged by chunk, so a row is kept once."""
    reach = run_chunks(runs, before, size).groupBy("station", "chunk").agg(
        (F.min("lo") - before).alias("lo"), F.max("hi").alias("hi")
    )
    near = df.withColumn("chunk", floor_div(F.col("idx"), size)).join(reach, ["station", "chunk"])
    return near.filter("idx >= lo AND idx < hi").select(*df.columns)


def window_rows(
    df: DataFrame, geom: Geometry, ti: float | None = None, tf: float | None = None, runs: DataFrame | None = None
) -> DataFrame:
    """Each sample once per window that holds it, with its position ``pos`` in the window; with ``runs`` only for windows of these.

    The assignment is arithmetic on the sample index: no join (but one with the chunks of ``runs``), and the copies exist only inside
    the pipelined explode that feeds a partial aggregate.
    """
    if runs is not None:
        df = df.withColumn("chunk", floor_div(F.col("idx"), CHUNK)).join(run_chunks(runs).drop("lo", "hi"), ["station", "chunk"]).drop("chunk")
    k_from, k_to = (F.lit(0), F.col("nw") - 1) if runs is None else (F.col("k_from"), F.col("k_to"))
    first, e0, count = window_bounds(geom, ti, tf)
    offset = F.col("idx") - (F.col("e0") - geom.iw)
    low = F.greatest(k_from, ceil_div(offset - geom.iw + 1, geom.hop))
    high = F.least(k_to, floor_div(offset, geom.hop))
    return (
        df.withColumns({"first": first, "e0": e0, "nw": count})
        .withColumns({"low": low, "high": high})
        .filter("low <= high")
        .withColumn("k", F.explode(F.sequence("low", "high")))
        .withColumns(
            {
                "e": F.col("e0") + F.col("k") * geom.hop,
                "win_end": F.col("first") + F.col("k") * geom.hop_seconds,
            }
        )
        .withColumn("pos", F.col("idx") - (F.col("e") - geom.iw))
        .drop("first", "e0", "nw", "low", "high", "k_from", "k_to")
    )


def window_arrays(
    df: DataFrame,
    geom: Geometry,
    streams: Sequence[str],
    ti: float | None = None,
    tf: float | None = None,
    size: int | None = None,
    runs: DataFrame | None = None,
) -> DataFrame:
    """One row per window and stream with its ordered samples: ``station, k, e, win_end, stream, x``; with ``runs`` only for
    windows of these.

    Samples move once per chunk (plus one window of halo), not once per window: a chunk is gathered into
    one array per stream and windows are cut from it by position. At hop 1 this shuffles about a seventh more
    than the data instead of 288 copies. Short windows are left out.
    """
    size = size or max(CHUNK, 4 * geom.iw)
    idx = F.col("idx")
    low, high = floor_div(idx + 1, size), floor_div(idx + geom.iw, size)
    copies = df.select("station", "t0", "t1", "idx", *streams, F.explode(F.sequence(low, high)).alias("chunk"))
    keys = ["station", "chunk", "t0", "t1"]
    if runs is not None:
        # the chunk of a window is that of its end
        ends = runs.withColumn("chunk", F.explode(F.sequence(floor_div(F.col("lo") + geom.iw, size), floor_div(F.col("hi"), size))))
        copies = copies.join(ends, ["station", "chunk"]).filter("idx >= lo AND idx < hi").drop("lo", "hi")
        keys += ["k_from", "k_to"]
    chunks = (
        place(copies, "station", "chunk")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("idx", *streams))).alias("rows"))
        .select(
            *keys,
            F.col("rows")[0]["idx"].alias("base"),
            F.size("rows").alias("len"),
            *[F.col("rows").getField(s).alias(s) for s in streams],
        )
    )
    first, e0, count = window_bounds(geom, ti, tf)
    bounded = chunks.withColumns({"first": first, "e0": e0, "nw": count})
    k_low = F.greatest(F.lit(0), ceil_div(F.col("chunk") * size - F.col("e0"), geom.hop))
    k_high = F.least(F.col("nw") - 1, floor_div((F.col("chunk") + 1) * size - 1 - F.col("e0"), geom.hop))
    if runs is not None:
        k_low, k_high = F.greatest(k_low, F.col("k_from")), F.least(k_high, F.col("k_to"))
    begin = F.col("e") - geom.iw - F.col("base")
    cut = [F.slice(F.col(s), (F.col("begin") + 1).cast("int"), geom.iw) for s in streams]
    return (
        bounded.withColumns({"k_low": k_low, "k_high": k_high})
        .filter("k_low <= k_high")
        .withColumn("k", F.explode(F.sequence("k_low", "k_high")))
        .withColumn("e", F.col("e0") + F.col("k") * geom.hop)
        .withColumn("begin", begin)
        .filter((F.col("begin") >= 0) & (F.col("begin") + geom.iw <= F.col("len")))
        .select(
            "station",
            "k",
            "e",
            (F.col("first") + F.col("k") * geom.hop_seconds).alias("win_end"),
            F.explode(
                F.array(*[F.struct(F.lit(s).alias("stream"), x.alias("x")) for s, x in zip(streams, cut)])
            ).alias("w"),
        )
        .select("station", "k", "e", "win_end", "w.stream", "w.x")
    )


def skip_windows(df: DataFrame, skip_first: int = 0, stop: int | None = None) -> DataFrame:
    """Windows numbered ``skip_first`` up to, not including, ``stop``."""
    keep = F.col("k") >= skip_first
    return df.filter(keep if stop is None else keep & (F.col("k") < stop))


def complete_only(df: DataFrame, geom: Geometry, count: str = "n") -> DataFrame:
    """Aggregated windows that hold all their samples."""
    return df.filter(F.col(count) == geom.iw)
