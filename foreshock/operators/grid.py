"""Regular grid: de-duplicate, reindex, fill gaps, repair the midnight sample.

A gridded series has columns ``station, idx, t0, t1`` and its signals. ``idx`` counts grid steps since the
epoch; ``t0`` and ``t1`` are the first and last ``idx`` of the station and ride along on each row, so later
steps need no join to learn where a series starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreshock.config import CHUNK, SAMPLES_PER_DAY, SIGNALS
from foreshock.functions.numbers import floor_div
from foreshock.operators.chunks import chunk_order, drop_halo, place, with_halo


def dedup_last(
    df: DataFrame, keys: Sequence[str] = ("station", "ts"), seq: str = "load_seq"
) -> DataFrame:
    """One row per key, the one loaded last. A plain aggregate: copies meet before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(seq))
    return df.groupBy(*keys).agg(last.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def data_extent(df: DataFrame, column: str = "idx") -> DataFrame:
    return df.groupBy("station").agg(F.min(column).alias("first"), F.max(column).alias("last"))


def _known(signal: str):
    return F.when(F.col(signal).isNotNull(), F.struct(F.col("idx").alias("i"), F.col(signal).alias("v")))


def _chunk_carry(rows: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Per (station, chunk): the known samples next to it on both sides, and the extent of the station.

    The window below runs over one row per chunk. Rows are unique per grid step here, so a station has at
    most 52,596 rows a year and 37 chunk rows a year: small whatever the volume of raw readings.
    """
    summary = rows.groupBy("station", "chunk").agg(
        F.min("idx").alias("lo"),
        F.max("idx").alias("hi"),
        *[F.min(F.when(F.col(s).isNotNull(), F.col("idx"))).alias(f"fi_{s}") for s in signals],
        *[F.max(F.when(F.col(s).isNotNull(), F.col("idx"))).alias(f"li_{s}") for s in signals],
        *[F.min_by(s, F.when(F.col(s).isNotNull(), F.col("idx"))).alias(f"fv_{s}") for s in signals],
        *[F.max_by(s, F.when(F.col(s).isNotNull(), F.col("idx"))).alias(f"lv_{s}") for s in signals],
    )
    station = Window.partitionBy("station")
    order = station.orderBy("chunk")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    future = station.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)

    def edge(kind: str, s: str):
        index, value = F.col(f"{kind}i_{s}"), F.col(f"{kind}v_{s}")
        return F.when(index.isNotNull(), F.struct(index.alias("i"), value.alias("v")))

    return summary.select(
        "station",
        "chunk",
        F.lead("lo").over(order).alias("next_lo"),
        F.min("lo").over(station).alias("t0"),
        F.max("hi").over(station).alias("t1"),
        F.greatest(*[F.min(f"fi_{s}").over(station) for s in signals], F.min("lo").over(station)).alias("t_all"),
        *[F.last(edge("l", s), ignorenulls=True).over(past).alias(f"before_{s}") for s in signals],
        *[F.last(edge("f", s), ignorenulls=True).over(future).alias(f"after_{s}") for s in signals],
    )


def _spread(df: DataFrame, signals: Sequence[str], size: int) -> DataFrame:
    """Dense grid rows, each with the nearest known sample at or before it and after it."""
    rows = place(
        df.select("station", "idx", floor_div(F.col("idx"), size).alias("chunk"), *signals), "station", "chunk"
    )
    joined = rows.join(_chunk_carry(rows, signals), ["station", "chunk"])
    up = chunk_order()
    upto = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = (
        Window.partitionBy("station", "chunk")
        .orderBy(F.desc("idx"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return joined.select(
        "station",
        "t0",
        "t1",
        "t_all",
        F.col("idx").alias("row_idx"),
        F.coalesce(F.lead("idx").over(up), "next_lo", F.col("idx") + 1).alias("row_next"),
        *[
            F.coalesce(F.last(_known(s), ignorenulls=True).over(upto), f"before_{s}").alias(f"p_{s}")
            for s in signals
        ],
        *[
            F.coalesce(F.last(_known(s), ignorenulls=True).over(down), f"after_{s}").alias(f"n_{s}")
            for s in signals
        ],
    ).select(
        "*", F.explode(F.sequence(F.col("row_idx"), F.col("row_next") - 1)).alias("idx")
    )


def grid_reindex(df: DataFrame, signals: Sequence[str] = SIGNALS, size: int = CHUNK) -> DataFrame:
    """Dense grid with nulls where nothing was read. Input: one row per (station, idx)."""
    spread = _spread(df, signals, size)
    return spread.select(
        "station", "idx", "t0", "t1", *[F.when(F.col(f"p_{s}.i") == F.col("idx"), F.col(f"p_{s}.v")).alias(s) for s in signals]
    )


def interpolate_linear(
    df: DataFrame, signals: Sequence[str] = SIGNALS, size: int = CHUNK, trim_leading: bool = False
) -> DataFrame:
    """Dense grid filled on straight lines; the tail repeats the last value, a leading gap stays null.

    With ``trim_leading`` the series starts where all signals are known.
    """
    spread = _spread(df, signals, size)

    def fill(s: str):
        p, n, idx = F.col(f"p_{s}"), F.col(f"n_{s}"), F.col("idx")
        share = (idx - p["i"]) / (n["i"] - p["i"])
        return (
            F.when((p["i"] == idx) | n.isNull(), p["v"])
            .otherwise(p["v"] + (n["v"] - p["v"]) * share)
            .alias(s)
        )

    start = "t_all" if trim_leading else "t0"
    filled = spread.select("station", "idx", F.col(start).alias("t0"), "t1", *[fill(s) for s in signals])
    return filled.filter("idx >= t0") if trim_leading else filled


def midnight_smooth(
    df: DataFrame, signal: str = "dsar", period: int = SAMPLES_PER_DAY, size: int = CHUNK
) -> DataFrame:
    """Each ``period``-th row of a series (not the first, not in the last part day) becomes the mean of
    its two neighbours. Positions count from the first row of the series."""
    halo = with_halo(df, before=1, after=1, size=size)
    order = chunk_order()
    pos = F.col("idx") - F.col("t0")
    whole = floor_div(F.col("t1") - F.col("t0") + 1, period)
    hit = (pos % period == 0) & (pos > 0) & (floor_div(pos, period) < whole)
    around = F.lit(0.5) * (F.lag(signal).over(order) + F.lead(signal).over(order))
    fixed = halo.withColumn("smoothed", around)
    return drop_halo(fixed.withColumn(signal, F.when(hit, F.col("smoothed")).otherwise(F.col(signal))).drop("smoothed"))
