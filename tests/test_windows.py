"""Windows, labels and range filters."""

import numpy as np
import pytest
from series_rows import make_series

from foreshock.config import Geometry
from foreshock.operators import features_agg, features_array, labels, windows
from foreshock.plans.extract import ALL_CALCULATORS, extract_features

BASE = 2_800_000


def noisy(spark, n=1500, stations=(1,), seed=0):
    rng = np.random.default_rng(seed)
    data = {s: rng.integers(1, 30, (n, 4)).astype(float) for s in stations}
    return make_series(spark, data), data


@pytest.mark.parametrize("geom", [Geometry(), Geometry(2, 1.0, 2), Geometry(0.1, 0.5, 1)])
def test_window_forms_agree_and_exclude_their_own_date(spark, geom):
    df, data = noisy(spark, 700 if geom.hop == 1 else 1500)
    n, iw, hop = len(data[1]), geom.iw, geom.hop
    count = (n - 1 - iw) // hop
    dates = {(r.k, r.e) for r in windows.window_dates(df, geom).collect()}
    assert dates == {(k, BASE + iw + k * hop) for k in range(count)}
    got = {r.k: r.x for r in windows.window_arrays(df, geom, ["mf"], size=400).collect()}
    assert set(got) == set(range(count))
    for k, x in got.items():
        assert x == list(data[1][k * hop : k * hop + iw, 1])
    sums = {(r.k, r.stream): r.sum_values for r in features_agg.window_sums(df, geom, ["mf"], ["sum_values"]).collect()}
    assert sums == {(k, "mf"): sum(x) for k, x in got.items()}


def test_start_moves_to_first_full_window_and_end_is_clamped(spark):
    df, _ = noisy(spark, 1000)
    t = BASE * 600
    early = windows.window_dates(df, Geometry(), t - 99_999, t + 10**9).collect()
    assert min(r.win_end for r in early) == t + 288 * 600
    assert max(r.win_end for r in early) < t + 999 * 600
    late = windows.window_dates(df, Geometry(), t + 400 * 600, t + 600 * 600).collect()
    assert sorted(r.e - BASE for r in late) == [400, 472]


def test_short_windows_are_left_out(spark):
    df, _ = noisy(spark, 1000)
    holed = df.filter(f"idx <> {BASE + 300}")
    full = windows.window_dates(df, Geometry()).count()
    hit = sum(1 for k in range(full) if k * 72 <= 300 < k * 72 + 288)
    assert features_agg.window_sums(holed, Geometry(), ["mf"], ["mean"]).count() == full - hit


def test_label_is_strict_on_both_ends(spark):
    dates = spark.createDataFrame([(1, 172800 * 10)], "station BIGINT, win_end BIGINT")
    t = 172800 * 10 * 1_000_000
    for te, want in ((t, 0), (t + 1, 1), (t + 172800_000_000 - 1, 1), (t + 172800_000_000, 0), (t - 5, 0)):
        ev = spark.createDataFrame([(1, te), (2, t + 10)], "station BIGINT, te_us BIGINT")
        assert labels.label_windows(dates, ev, Geometry()).first().label == want


def test_labels_against_brute_force(spark):
    rng = np.random.default_rng(3)
    dates = [(int(s), int(t) * 600) for s in (1, 2) for t in rng.integers(3000, 9000, 200)]
    evs = [(int(rng.integers(1, 3)), int(rng.integers(3000 * 600, 9000 * 600)) * 1_000_000 + 7) for _ in range(40)]
    got = labels.label_windows(
        spark.createDataFrame(dates, "station BIGINT, win_end BIGINT"), spark.createDataFrame(evs, "station BIGINT, te_us BIGINT"), Geometry()
    ).collect()
    for r in got:
        want = any(s == r.station and 0 < te / 1e6 - r.win_end < 172800 for s, te in evs)
        assert r.label == float(want)


def test_excluded_ranges_are_half_open(spark, rows):
    df = spark.createDataFrame([(1, t) for t in (0, 86400, 2 * 86400)], "station BIGINT, win_end BIGINT")
    kept = labels.exclude_ranges(df, [("1970-01-01 00:00:00", "1970-01-02 00:00:00")])
    assert rows(kept) == [(1, 86400), (1, 172800)]
    table = spark.createDataFrame([(1, 0.0, 86400.0)], "station BIGINT, t0 DOUBLE, t1 DOUBLE")
    assert rows(labels.exclude_range_table(df, table).select("station", "win_end")) == [(1, 86400), (1, 172800)]


def test_unmatched_rows(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "station BIGINT, win_end BIGINT")
    b = spark.createDataFrame([(1, 2), (1, 3)], "station BIGINT, win_end BIGINT")
    assert {(r.win_end, r.side) for r in labels.unmatched_rows(a, b).collect()} == {(1, "features"), (3, "labels")}


def numpy_features(x):
    """Direct definitions of a few calculators."""
    d, n = np.diff(x), len(x)
    m, v = x.mean(), x.var()
    return {
        "abs_energy": (x**2).sum(),
        "skewness": ((x - m) ** 3).mean() / v**1.5 * (n * (n - 1)) ** 0.5 / (n - 2),
        "mean_abs_change": np.abs(d).mean(),
        "cid_ce__normalize_True": np.sqrt((d**2).sum()) / x.std(),
        "c3__lag_2": (x[4:] * x[2:-2] * x[:-4]).mean(),
        "autocorrelation__lag_3": ((x[3:] - m) * (x[:-3] - m)).sum() / ((n - 3) * v),
        "linear_trend__attr_slope": np.polyfit(np.arange(n), x, 1)[0],
        "median": np.median(x),
        "quantile__q_0.3": np.quantile(x, 0.3),
        "has_duplicate": float(len(set(x)) < n),
        "count_above_mean": float((x > m).sum()),
        "ratio_beyond_r_sigma__r_1": (np.abs(x - m) > x.std()).mean(),
        "first_location_of_maximum": x.argmax() / n,
        "last_location_of_minimum": 1 - x[::-1].argmin() / n,
        "sum_of_reoccurring_values": sum(v for v in set(x) if (x == v).sum() > 1),
        "change_quantiles__f_agg_mean__isabs_True__qh_0.8__ql_0.2": np.abs(
            d[[np.quantile(x, 0.2) <= min(a, b) and max(a, b) <= np.quantile(x, 0.8) for a, b in zip(x[:-1], x[1:])]]
        ).mean(),
        "number_peaks__n_3": float(sum(all(x[i] > x[i + j] for j in (-3, -2, -1, 1, 2, 3)) for i in range(3, n - 3))),
    }


def test_all_calculators_run_and_agree_with_numpy(spark):
    geom = Geometry(0.5, 0.0, 1)
    df, data = noisy(spark, 300)
    out = extract_features(df, geom, ["rsam"]).collect()
    assert {r.calculator for r in out} == set(ALL_CALCULATORS)
    x = data[1][:72, 0]
    first = min(r.win_end for r in out)
    got = {r.feature[len("rsam__"):]: r.value for r in out if r.win_end == first}
    for name, want in numpy_features(x).items():
        assert got[name] == pytest.approx(want, abs=1e-9), name
    assert len([r for r in out if r.win_end == first]) == len(got)


def test_subset_of_calculators_only(spark):
    df, _ = noisy(spark, 300)
    out = extract_features(df, Geometry(0.5, 0.0, 1), ["rsam"], only=["mean", "median"])
    assert {r.calculator for r in out.select("calculator").distinct().collect()} == {"mean", "median"}
    with pytest.raises(ValueError):
        extract_features(df, Geometry(), ["rsam"], only=["nothing"])
    assert features_array.CHANGE_QUANTILES in ALL_CALCULATORS


def test_constant_windows_have_finite_or_missing_values(spark):
    df = make_series(spark, {1: [[5, 5, 5, 5]] * 150})
    out = {r.feature: r.value for r in extract_features(df, Geometry(0.5, 0.0, 1), ["rsam"]).collect()}
    assert out["rsam__linear_trend__attr_slope"] == 0 and out["rsam__linear_trend__attr_rvalue"] == 0
    assert out["rsam__autocorrelation__lag_1"] is None and out["rsam__binned_entropy__max_bins_10"] == 0
    assert out["rsam__skewness"] is None and out["rsam__number_peaks__n_1"] == 0


def test_samples_of_chunk_trends_move_once(spark):
    """No aggregate of a window needs an exchange after its samples have met; windows that end in different chunks are all there."""
    geom = Geometry(1.0, 0.75, 1.0)
    rows = spark.range(5000).selectExpr("id % 2 AS station", "id DIV 2 AS idx", "0L AS t0", "2499L AS t1", "CAST((id * 7919) % 101 AS DOUBLE) AS rsam")
    found = features_agg.chunk_trends(rows, geom, ["rsam"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.station, r.k, r.length): r.slope_mean for r in found.collect()}
    n = (2499 - geom.iw) // geom.hop
    assert len(got) == 2 * n * 3 and n * geom.hop > 1440
    x = {s: np.array([((2 * i + s) * 7919) % 101 for i in range(2500)], float) for s in (0, 1)}
    for (s, k, length), slope in got.items():
        window = x[s][k * geom.hop : k * geom.hop + geom.iw]
        means = [window[a : a + length].mean() for a in range(0, geom.iw, length)]
        assert slope == pytest.approx(np.polyfit(np.arange(len(means)), means, 1)[0], abs=1e-9)
