"""Alert intervals and scores against a sequential matcher written from the rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreshock.config import Geometry
from foreshock.operators import alerts, evaluate

HOP, T0 = 43200, 1_700_006_400


def sequential(y, tes, threshold, span):
    """(false, missed, hits, true negatives, fraction) of one station by walking the alerts in order."""
    idx = [i for i, v in enumerate(y) if v > threshold]
    if not idx:
        return 0, len(tes), 0, 100_000_000, 0.0
    spans = [[idx[0], idx[0]]]
    for i in idx[1:]:
        if i - spans[-1][1] > span:
            spans.append([i, i])
        spans[-1][1] = i
    spans = [(a, b + span) for a, b in spans]
    left, hits, missed, false = sorted(tes), 0, 0, 0
    for a, b in spans:
        begin, end = T0 + a * HOP, T0 + b * HOP
        if not left:
            false += 1
            continue
        while left and left[0] < begin:
            left.pop(0)
            missed += 1
        if not left:
            continue
        held = [t for t in left if begin < t <= end]
        if not held:
            false += 1
        hits += len(held)
        left = left[len(held):]
    missed += len(left)
    lengths = [b - a for a, b in spans]
    tn = int((len(y) - sum(lengths)) / np.mean(lengths)) - missed
    return false, missed, hits, tn, sum(lengths) * HOP / ((len(y) - 1) * HOP)


def mcc(y, labels, threshold):
    p, t = np.asarray(y) > threshold, np.asarray(labels) > 0
    a, b, c, d = (p & t).sum(), (~p & ~t).sum(), (p & ~t).sum(), (~p & t).sum()
    den = float((a + c) * (a + d) * (b + c) * (b + d))
    return (a * b - c * d) / np.sqrt(den) if den else 0.0


def tables_of(spark, cases):
    cons = [(s, T0 + i * HOP, float(v)) for s, (y, _, _) in cases.items() for i, v in enumerate(y)]
    labs = [(s, T0 + i * HOP, float(v)) for s, (_, lab, _) in cases.items() for i, v in enumerate(lab)]
    evs = [(s, int(t * 1_000_000)) for s, (_, _, tes) in cases.items() for t in tes]
    return (
        spark.createDataFrame(cons, "station BIGINT, win_end BIGINT, consensus DOUBLE"),
        spark.createDataFrame(labs, "station BIGINT, win_end BIGINT, label DOUBLE"),
        spark.createDataFrame(evs, "station BIGINT, te_us BIGINT"),
    )


def test_sweep_equals_sequential_matcher(spark):
    rng = np.random.default_rng(5)
    cases = {}
    for s in range(25):
        n = int(rng.integers(20, 60))
        y = np.round(rng.random(n) ** 3, 2)
        tes = sorted(T0 + rng.random(int(rng.integers(1, 5))) * n * HOP + 0.5)
        cases[s] = (y, rng.integers(0, 2, n), [round(t, 3) for t in tes])
    geom = Geometry()
    got = {(r.station, round(r.threshold * 100)): r for r in evaluate.threshold_sweep(*tables_of(spark, cases), geom).collect()}
    assert len(got) == 25 * 101
    for s, (y, lab, tes) in cases.items():
        zero = got[(s, 0)]
        assert (zero.FP, zero.FN, zero.TP, zero.TN, zero.alert_fraction, zero.MCC) == (10**8, 0, len(tes), 1, 1.0, 0.0)
        for j in range(1, 101):
            r, want = got[(s, j)], sequential(y, tes, j / 100, 4)
            assert (r.FP, r.FN, r.TP, r.TN) == want[:4], (s, j)
            assert r.alert_fraction == pytest.approx(want[4])
            if want[3] != 10**8 or r.TP:
                assert r.MCC == pytest.approx(mcc(y, lab, j / 100))


def test_islands_join_at_exactly_the_span_and_are_disjoint(spark):
    y = [0.9, 0, 0, 0, 0.9, 0, 0, 0, 0, 0.9]
    cons, _, ev = tables_of(spark, {1: (y, y, [T0 + 1.5 * HOP, T0 + 8.5 * HOP, T0 + 8.0 * HOP])})
    got = alerts.alert_islands(cons, Geometry(), 0.8)
    assert sorted((r.i0, r.i1) for r in got.collect()) == [(0, 8.0), (9, 13.0)]
    matched = {r.te_us: r.start for r in alerts.alert_match(got, ev).collect()}
    assert matched == {
        int((T0 + 1.5 * HOP) * 1e6): T0, int((T0 + 8.0 * HOP) * 1e6): T0, int((T0 + 8.5 * HOP) * 1e6): None,
    }


def test_flag_states(spark):
    cons, _, _ = tables_of(spark, {1: ([0.1, 0.9], [0, 0], []), 2: ([0.1, 0.1], [0, 0], [1.0])})
    stations = spark.createDataFrame([(1,), (2,), (3,)], "station BIGINT")
    got = {r.station: r.in_alert for r in alerts.alert_flag(cons, stations, T0 + 2 * HOP, Geometry()).collect()}
    assert got == {1: 1, 2: 0, 3: -1}


def test_cover_is_cut_at_new_year(spark):
    t = 1_704_067_200 - 86400  # one day before 2024
    cons = spark.createDataFrame([(1, t - HOP, 0.0), (1, t, 1.0), (1, t + HOP, 0.0)], "station BIGINT, win_end BIGINT, consensus DOUBLE")
    got = sorted((r.year, r.start, r.stop) for r in alerts.alert_cover(cons, Geometry(), 0.5).collect())
    assert got == [(2023, t, t + 86400), (2024, t + 86400, t + 172800)]


def test_curves_guard_empty_ratios(spark):
    df = spark.createDataFrame([(1, 0.5, 0, 0, 0, 0, 0.0)], "station BIGINT, threshold DOUBLE, FP BIGINT, FN BIGINT, TP BIGINT, TN BIGINT, alert_fraction DOUBLE")
    r = evaluate.score_curves(df).first()
    assert r.mcc is None and r.f1 is None and r.false_alert_rate is None
    assert evaluate.score_curves(df.withColumn("TN", F.lit(10**8)).withColumn("TP", F.lit(3)).withColumn("FP", F.lit(10**8))).first().mcc is not None
