"""Scores of a consensus at 101 thresholds, or at any others.

A row's ``level`` is how many thresholds its consensus exceeds, so the state of all thresholds is in one
number. A row opens alerts at the thresholds above the highest level within reach before it and up to its own;
ends likewise. Counts at all thresholds are then sums of such ranges: the windows are read once, not once
per threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.config import CHUNK, Geometry
from foreshock.operators.alerts import NO_ALERT_TN, _edges, first_candidate, last_before, number_windows
from foreshock.sources.tables import cut_lineage

THRESHOLDS = tuple(j / 100 for j in range(1, 101))


def _array(thresholds: Sequence[float]) -> str:
    return f"array({', '.join(f'{float(t)!r}D' for t in thresholds)})"


def levelled(cons: DataFrame, geom: Geometry, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Windows with the number of (ascending) thresholds below their consensus; without a consensus that is 0."""
    level = f"size(filter({_array(thresholds)}, t -> consensus > t AND NOT isnan(consensus)))"
    return _edges(number_windows(cons, geom).withColumn("level", F.expr(level)), geom.alert_reach)


def _tally(rows: DataFrame, low: str, high: str, values: dict[str, str]) -> DataFrame:
    """Sums over rows per threshold, a row counting at the thresholds ``low < j <= high``.

    Rows meet in a partial aggregate by (station, low, high), of which there are at most 5,050 a station, and
    only those are spread over thresholds.
    """
    groups = (
        rows.filter(f"{low} < {high}")
        .groupBy("station", F.expr(f"{low} AS _a"), F.expr(f"{high} AS _b"))
        .agg(*[F.sum(F.expr(v)).alias(n) for n, v in values.items()])
    )
    spread = groups.withColumn("j", F.expr("explode(sequence(_a + 1, _b))"))
    return spread.groupBy("station", "j").agg(*[F.sum(n).alias(n) for n in values])


def _all_thresholds(stations: DataFrame, n: int) -> DataFrame:
    return stations.select("station", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("j"))


def event_levels(rows: DataFrame, events: DataFrame, geom: Geometry) -> DataFrame:
    """Events with the rows whose alert can hold them: ``station, te_us, i, level``.

    Window dates before an event and within reach of it are known by arithmetic, so this is an equality join.
    """
    hop = geom.hop_seconds * 1_000_000
    span = rows.groupBy("station").agg(F.max("t0").alias("t0"), F.max("i").alias("last"))
    placed = events.join(span, "station").select(
        "station",
        "te_us",
        first_candidate(F.col("te_us"), F.col("t0"), geom).alias("lo"),
        F.least("last", F.ceil((F.col("te_us") - F.col("t0") * 1_000_000) / hop) - 1).alias("hi"),
    )
    near = placed.filter("lo <= hi").select("station", "te_us", F.explode(F.sequence("lo", "hi")).alias("i"))
    return near.join(rows.filter("level > 0").select("station", "i", "level"), ["station", "i"])


def threshold_sweep(
    cons: DataFrame, labels: DataFrame, events: DataFrame, geom: Geometry, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Score table per station: ``station, threshold, FP, FN, TP, TN, alert_fraction, MCC`` for the ascending thresholds above 0,
    and for 0. Events at one time count as many.

    False alerts are one fewer when the last event is missed and an alert opens after it.
    """
    # Both feed several branches below, so they are computed once: a row per window, a row per event.
    rows = cut_lineage(levelled(cons.join(labels.select("station", "win_end", "label"), ["station", "win_end"]), geom, thresholds))
    events = cut_lineage(events.groupBy("station", "te_us").agg(F.count("*").alias("m")))
    stations = rows.groupBy("station").agg(
        F.count("*").alias("n"),
        F.sum("label").alias("positives"),
        F.max("t0").alias("t0"),
        F.max("t1").alias("t1"),
    )
    span = geom.alert_span
    opened = _tally(rows, "prev", "level", {"alerts": "1L", "sum_start": "i"})
    closed = _tally(rows, "next", "level", {"sum_stop": f"i + {span!r}D"})
    above = _tally(rows.withColumn("zero", F.lit(0)), "zero", "level", {"flagged": "1L", "right": "CAST(label AS BIGINT)"})

    # Hits: an event is hit at every threshold up to the highest level of its rows.
    inside = stations.join(events.groupBy("station").agg(F.sum("m").alias("events"), F.max("te_us").alias("last_te")), "station", "left")
    per_event = event_levels(rows, events, geom)
    best = per_event.groupBy("station", "te_us").agg(F.max("level").alias("level"))
    hits = _tally(best.join(events, ["station", "te_us"]).withColumn("zero", F.lit(0)), "zero", "level", {"hits": "m"})

    # Alerts that hold an event: the last opening at or before any of the event's rows, per threshold.
    starts = rows.filter("prev < level").selectExpr("station", "i", "explode(sequence(prev + 1, level)) AS j")
    wanted = (
        per_event.groupBy("station", "te_us", "level").agg(F.max("i").alias("i"))
        .selectExpr("station", "te_us", "i", "explode(sequence(1, level)) AS j")
        .groupBy("station", "te_us", "j").agg(F.max("i").alias("i"))
    )
    both = starts.selectExpr("station", "j", "i", "0 AS kind", "i AS opening").unionByName(
        wanted.selectExpr("station", "j", "i", "1 AS kind"), allowMissingColumns=True
    )
    held = last_before(both, ["station", "j"], "i", "opening", CHUNK).groupBy("station", "j").agg(F.countDistinct("last").alias("held"))

    # The miscount: is the last event missed, and does an alert open after it?
    ends = events.groupBy("station").agg(F.max("te_us").alias("te_us"))
    last_level = ends.join(best, ["station", "te_us"], "left").selectExpr("station", "te_us AS last_te", "coalesce(level, 0) AS last_level")
    late = (
        _tally(rows.join(ends, "station").filter("win_end * 1000000 > te_us"), "prev", "level", {"late": "1L"})
        .join(last_level.select("station", "last_level"), "station")
        .filter("j > last_level AND late > 0").select("station", "j", F.lit(1).alias("skipped"))
    )

    keys = ["station", "j"]
    table = _all_thresholds(stations, len(thresholds)).join(inside, "station")
    for part in (opened, closed, above, hits, held, late):
        table = table.join(part, keys, "left")
    table = table.fillna(0).withColumn("length", F.col("sum_stop") - F.col("sum_start"))
    tn = (
        f"CAST((n - length) / (length / alerts) AS BIGINT) - (events - hits)"
    )
    mcc = (
        "coalesce(try_divide(CAST(right AS DOUBLE) * (n - positives - flagged + right) - CAST(flagged - right AS DOUBLE) * (positives - right), "
        "sqrt(CAST(flagged AS DOUBLE) * (n - flagged) * positives * (n - positives))), 0D)"
    )
    some = "alerts > 0"
    scored = table.selectExpr(
        "station",
        f"element_at({_array(thresholds)}, j) AS threshold",
        f"CASE WHEN {some} THEN alerts - held - skipped ELSE 0L END AS FP",
        f"CASE WHEN {some} THEN events - hits ELSE events END AS FN",
        f"CASE WHEN {some} THEN hits ELSE 0L END AS TP",
        f"CASE WHEN {some} THEN {tn} ELSE {NO_ALERT_TN}L END AS TN",
        f"CASE WHEN {some} THEN try_divide(length * {geom.hop_seconds}, CAST(t1 - t0 AS DOUBLE)) ELSE 0D END AS alert_fraction",
        f"CASE WHEN {some} THEN {mcc} ELSE 0D END AS MCC",
    )
    zero = inside.selectExpr(
        "station", "0D AS threshold", f"{NO_ALERT_TN}L AS FP", "0L AS FN", "coalesce(events, 0L) AS TP", "1L AS TN",
        "1D AS alert_fraction", "0D AS MCC",
    )
    return zero.unionByName(scored)


def alert_score(cons: DataFrame, labels: DataFrame, events: DataFrame, geom: Geometry, threshold: float = 0.8) -> DataFrame:
    """The row of the score table at exactly ``threshold``, per station."""
    if threshold <= 0:
        return threshold_sweep(cons, labels, events, geom, [1.0]).filter("threshold = 0")
    return threshold_sweep(cons, labels, events, geom, [threshold]).filter("threshold > 0")


def score_curves(scores: DataFrame) -> DataFrame:
    """Derived scores and curve points per threshold; undefined ratios are null."""
    tp, fp, fn, tn = (f"CAST({c} AS DOUBLE)" for c in ("TP", "FP", "FN", "TN"))
    ratio = "try_divide({}, {})".format
    square = f"(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
    return scores.selectExpr(
        "station",
        "threshold",
        f"CASE WHEN {square} > 0 THEN ({tp} * {tn} - {fp} * {fn}) / sqrt({square}) END AS mcc",
        f"{ratio(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})')} AS f1",
        f"{ratio(f'({tp} + {tn})', f'({tp} + {tn} + {fp} + {fn})')} AS accuracy",
        f"{ratio(fp, f'({fp} + {tn})')} AS false_positive_rate",
        f"{ratio(tp, f'({tp} + {fn})')} AS true_positive_rate",
        f"{ratio(fp, f'({fp} + {tp})')} AS false_alert_rate",
        "FN AS missed",
        "alert_fraction",
    )
