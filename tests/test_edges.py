"""Values at the edge: NaN, infinity and null in results, short look-forwards, equal event times, any threshold."""

import math

import pytest
from pyspark.sql import functions as F

from foreshock.config import Geometry
from foreshock.functions.numbers import snap
from foreshock.operators import evaluate, labels, store
from foreshock.plans.catalog import tidy

NAN, INF = float("nan"), float("inf")


def test_nan_infinity_and_null_survive_rounding(spark):
    df = spark.createDataFrame([(0, NAN), (1, INF), (2, -INF), (3, None), (4, 1.23456789), (5, 1e300)], "k INT, x DOUBLE")
    for out in (tidy(df), df.withColumn("x", snap(F.col("x")))):
        x = [r.x for r in out.orderBy("k").collect()]
        assert math.isnan(x[0]) and x[1:4] == [INF, -INF, None] and x[4] == pytest.approx(1.234568) and x[5] == pytest.approx(1e300)


def test_labels_with_a_look_forward_below_one_step(spark):
    geom = Geometry(window=2.0, overlap=0.75, look_forward=0.003)
    end = 1_700_000_400
    dates = spark.createDataFrame([(0, end)], "station BIGINT, win_end BIGINT")
    events = spark.createDataFrame([(0, (end + s) * 1_000_000) for s in (-100, 100, 390)], "station BIGINT, te_us BIGINT")
    assert labels.label_windows(dates, events, geom).first().label == 1.0
    assert labels.label_windows(dates, events.where(f"te_us <> {(end + 100) * 1_000_000}"), geom).first().label == 0.0


def scores(spark, consensus, events, **how):
    geom = Geometry(window=2.0, overlap=0.75, look_forward=2.0)
    hop, begin = geom.hop_seconds, 1_700_000_000
    cons = [(0, begin + i * hop, c) for i, c in enumerate(consensus)]
    marks = [(0, (begin + int(e * hop)) * 1_000_000) for e in events]
    return (
        spark.createDataFrame(cons, "station BIGINT, win_end BIGINT, consensus DOUBLE"),
        spark.createDataFrame([(0, w, 0.0) for _, w, _ in cons], "station BIGINT, win_end BIGINT, label DOUBLE"),
        spark.createDataFrame(marks, "station BIGINT, te_us BIGINT"),
        geom,
    )


def test_equal_event_times_count_as_many(spark):
    row = evaluate.alert_score(*scores(spark, [0.0, 0.0, 0.9, 0.9, 0.0, 0.0, 0.0, 0.0], [3.5, 3.5]), threshold=0.8).first()
    assert (row.TP, row.FN) == (2, 0)


def test_score_at_any_threshold(spark):
    parts = scores(spark, [0.0, 0.878, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], [1.5])
    found = [evaluate.alert_score(*parts, threshold=t).collect() for t in (0.875, 0.88, 0.0)]
    assert [(r[0].threshold, r[0].TP) for r in found] == [(0.875, 1), (0.88, 0), (0.0, 1)] and all(len(r) == 1 for r in found)


def test_windows_without_consensus_stay_in_the_score(spark):
    full = evaluate.alert_score(*scores(spark, [0.9, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], [0.5]), threshold=0.5).first()
    gaps = evaluate.alert_score(*scores(spark, [0.9, None, NAN, 0.0, None, 0.0, 0.0, 0.0], [0.5]), threshold=0.5).first()
    assert full == gaps


def test_store_reads_prune_months_and_calculators(spark, tmp_path):
    rows = [(s, 1_704_067_200 + d * 86400, "rsam", "", f"rsam__{c}", 1.0, c) for s in (1, 2) for d in range(60) for c in ("mean", "median")]
    df = spark.createDataFrame(rows, "station BIGINT, win_end BIGINT, stream STRING, params STRING, feature STRING, value DOUBLE, calculator STRING")
    store.write_features(df, str(tmp_path / "store"))
    held = store.read_features(spark, str(tmp_path / "store"), 1_704_067_200 + 40 * 86400, None, ["mean"])
    assert held.count() == 2 * 20
    plan = held._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.split("\n") if "PartitionFilters" in line).split("PartitionFilters")[1]
    assert "month" in filters and "calculator" in filters
