"""Alert intervals of a consensus series and their match with events.

Input is a consensus ``station, win_end, consensus`` on a regular hop. ``i`` numbers its rows per station from
the first date by arithmetic. An alert opens above a threshold and runs until ``reach`` windows after the last
exceedance; exceedances further apart than that belong to different alerts.

Windows of a station are bounded by the calendar (52,596 a year at hop 1), and the ordered steps below work on
chunks of them all the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreshock.config import CHUNK, Geometry
from foreshock.functions.numbers import ceil_div, floor_div
from foreshock.operators.chunks import drop_halo, with_halo

MICRO = 1_000_000
NO_ALERT_TN = 100_000_000
ALERT_LEVEL = 0.8


def number_windows(cons: DataFrame, geom: Geometry) -> DataFrame:
    """Add ``i`` (row number by date), ``t0`` (first date) and ``t1`` (last date)."""
    span = cons.groupBy("station").agg(F.min("win_end").alias("t0"), F.max("win_end").alias("t1"))
    return cons.join(span, "station").withColumn("i", floor_div(F.col("win_end") - F.col("t0"), geom.hop_seconds))


def _edges(rows: DataFrame, reach: int, size: int = CHUNK) -> DataFrame:
    """Add, per row, the highest ``level`` of the ``reach`` rows before it and after it (0 where none)."""
    size = max(size, 4 * reach)
    order = Window.partitionBy("station", "chunk").orderBy("i")
    halo = with_halo(rows, before=reach, after=reach, size=size, key="i")
    before, after = order.rangeBetween(-reach, -1), order.rangeBetween(1, reach)
    return drop_halo(
        halo.withColumns(
            {
                "prev": F.coalesce(F.max("level").over(before), F.lit(0)),
                "next": F.coalesce(F.max("level").over(after), F.lit(0)),
            }
        )
    )


def alert_islands(cons: DataFrame, geom: Geometry, threshold: float = ALERT_LEVEL) -> DataFrame:
    """Alerts at one threshold: ``station, i0, i1, start, stop`` (row numbers and epoch seconds).

    A row opens an alert when nothing within reach before it exceeds the threshold, and ends one when nothing
    after it does; the n-th opening of a station belongs to its n-th end.
    """
    rows = number_windows(cons, geom).withColumn("level", (F.col("consensus") > threshold).cast("int"))
    marked = _edges(rows, geom.alert_reach).filter("level = 1")
    ends = marked.filter("prev = 0 OR next = 0").select(
        "station",
        "t0",
        F.explode(F.expr("filter(array(IF(prev = 0, struct(i AS i, 0 AS kind), NULL), IF(next = 0, struct(i AS i, 1 AS kind), NULL)), s -> s IS NOT NULL)")).alias("s"),
    ).select("station", "t0", "s.i", "s.kind")
    order = Window.partitionBy("station").orderBy("i", "kind")
    paired = ends.withColumn("last", F.lead("i").over(order)).filter("kind = 0")
    hop = geom.hop_seconds
    return paired.select(
        "station",
        F.col("i").alias("i0"),
        (F.col("last") + geom.alert_span).alias("i1"),
        (F.col("t0") + F.col("i") * hop).alias("start"),
        (F.col("t0") + (F.col("last") + geom.alert_span) * hop).alias("stop"),
    )


def last_before(rows: DataFrame, keys: list[str], at: str, value: str, chunk: int) -> DataFrame:
    """Adds ``last``: per row without ``value`` the value of the last row of its keys that has one, at or before it (``at`` counts
    from anywhere; of rows at one place those without ``value`` come first, unless ``kind`` orders them). Rows meet by stretches of ``chunk``;
    beyond its stretch a row sees one carried value per stretch."""
    rows = rows.withColumn("_chunk", floor_div(F.col(at), chunk))
    has = F.when(F.col(value).isNotNull(), F.col(value))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(at, "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = rows.groupBy(*keys, "_chunk").agg(F.max_by(has, F.when(F.col(value).isNotNull(), F.col(at))).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "_chunk", F.last("_tail", ignorenulls=True).over(earlier).alias("_carried"))
    own = rows.withColumn("_own", F.last(has, ignorenulls=True).over(inner)).filter(F.col(value).isNull())
    return own.join(carried, [*keys, "_chunk"]).withColumn("last", F.coalesce("_own", "_carried")).drop("_own", "_carried", "_chunk")


def alert_match(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Events with the alert that holds them: ``station, te_us, start`` (null when missed).

    Alerts of a station do not overlap, so an event can only lie in the last one that opened before it: found within the day, or
    carried over from the days before, one row a station and day.
    """
    span = "named_struct('start', start, 'stop', stop)"
    opened = alerts.selectExpr("station", "CAST(start * 1000000 AS BIGINT) AS t", "1 AS kind", f"{span} AS alert")
    marks = events.selectExpr("station", "te_us AS t", "0 AS kind")
    seen = last_before(opened.unionByName(marks, allowMissingColumns=True), ["station"], "t", "alert", 86400 * MICRO)
    inside = F.col("t") <= F.col("last.stop") * MICRO
    return seen.select("station", F.col("t").alias("te_us"), F.when(inside, F.col("last.start")).alias("start"))


def alert_flag(cons: DataFrame, stations: DataFrame, now: DataFrame | int, geom: Geometry, level: float = ALERT_LEVEL) -> DataFrame:
    """State over the last look-forward: 1 when any consensus exceeds the level, 0 when none, -1 without rows.

    ``now`` is one time for all stations (epoch seconds) or a table ``station, now``.
    """
    clock = stations.select("station").distinct()
    clock = clock.withColumn("now", F.lit(now).cast("bigint")) if isinstance(now, int) else clock.join(now, "station")
    recent = cons.join(clock, "station").filter(F.col("win_end") * MICRO > F.col("now") * MICRO - geom.look_micros)
    state = recent.groupBy("station").agg(F.max((F.col("consensus") > level).cast("int")).alias("state"))
    return clock.join(state, "station", "left").select("station", F.coalesce("state", F.lit(-1)).alias("in_alert"))


def alert_cover(cons: DataFrame, geom: Geometry, threshold: float = 0.75) -> DataFrame:
    """Shaded spans ``[t, t + look-forward]`` of all exceedances, joined where they touch, per calendar year:
    ``station, year, start, stop``."""
    look = round(geom.look_forward * 86400)
    touch = look // geom.hop_seconds
    rows = number_windows(cons, geom).withColumn("level", (F.col("consensus") > threshold).cast("int"))
    marked = _edges(rows, touch).filter("level = 1 AND (prev = 0 OR next = 0)")
    order = Window.partitionBy("station").orderBy("i", "kind")
    ends = marked.selectExpr(
        "station",
        "inline(filter(array(IF(prev = 0, named_struct('i', i, 't', win_end, 'kind', 0), NULL),"
        f" IF(next = 0, named_struct('i', i, 't', win_end + {look}, 'kind', 1), NULL)), s -> s IS NOT NULL))",
    )
    spans = ends.withColumn("stop", F.lead("t").over(order)).filter("kind = 0").selectExpr("station", "t AS start", "stop")
    year = "year(timestamp_seconds({0}))"
    return spans.selectExpr(
        "station", "start", "stop", f"explode(sequence({year.format('start')}, {year.format('stop')})) AS year"
    ).selectExpr(
        "station",
        "year",
        "greatest(start, unix_seconds(CAST(make_date(year, 1, 1) AS TIMESTAMP))) AS start",
        "least(stop, unix_seconds(CAST(make_date(year + 1, 1, 1) AS TIMESTAMP))) AS stop",
    )


def first_candidate(te_us, t0, geom: Geometry):
    """Lowest window number whose alert can still hold an event."""
    reach = round(geom.alert_span * geom.hop_seconds * MICRO)
    return F.greatest(F.lit(0), ceil_div(te_us - reach - t0 * MICRO, geom.hop_seconds * MICRO))
