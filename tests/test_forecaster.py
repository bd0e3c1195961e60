"""The whole workflow on a small series with a clear signal before each event."""

import numpy as np
import pytest
from series_rows import make_series

from foreshock.operators import windows
from foreshock.plans.forecaster import EventForecaster, SensorSeries
from foreshock.sources import tables

BASE = 2_800_000
CALCS = ["mean", "maximum", "standard_deviation", "median"]


@pytest.fixture(scope="module")
def forecaster(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    n, at = 144 * 40, [144 * d + 50 for d in (10, 20, 30)]
    x = rng.gamma(4, 5, (n, 4))
    for a in at:
        x[a - 400 : a] += 60
    events = spark.createDataFrame([(1, (BASE + a) * 600 * 1_000_000 + 1) for a in at], "station BIGINT, te_us BIGINT")
    data = SensorSeries(make_series(spark, {1: x.tolist()}), events)
    return EventForecaster(data, 1.0, 0.75, 2.0, data_streams=["rsam", "log_mf"], root=str(tmp_path_factory.mktemp("root")))


def test_workflow(forecaster, spark, tmp_path):
    used = forecaster.train(Nfts=4, Ncl=5, classifier="NB", compute_only_features=CALCS)
    assert used.count() > 0 and {f.split("__")[1] for f in forecaster.top_features(4)} <= set(CALCS)
    ys = forecaster.forecast()
    dates = forecaster.window_labels().count()
    assert ys.count() == dates and ys.filter("consensus IS NULL").count() == 0
    best = forecaster.accuracy(ys).filter("threshold > 0.3").agg({"TP": "max"}).first()[0]
    assert best == 3
    assert forecaster.curves(ys).count() == 101
    again = forecaster.forecast()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, ys.collect()))
    hist, values = forecaster.feature_tables(N=2)
    assert hist.count() > 0 and values.count() > 0
    assert forecaster.feature_correlation(N=3).count() == 3


def test_hires_needs_training_and_saves_state(forecaster, spark, tmp_path):
    with pytest.raises(ValueError):
        EventForecaster(forecaster.data, 1.0, 0.75, 2.0, root=str(tmp_path / "new")).hires_forecast()
    forecaster.train(Nfts=4, Ncl=5, classifier="NB", compute_only_features=CALCS)
    ti, tf = (BASE + 144 * 9) * 600, (BASE + 144 * 10) * 600
    ys = forecaster.hires_forecast(ti, tf, save_alerts=str(tmp_path / "flag"), now=tf)
    assert ys.count() == 144
    assert spark.read.parquet(str(tmp_path / "flag")).first().in_alert in (0, 1)


def test_trees_are_trained_and_reused(forecaster):
    grid = [{"max_depth": 2, "criterion": "gini", "max_features": None}]
    forecaster.train(Nfts=4, Ncl=3, retrain=True, classifier="DT", compute_only_features=CALCS, grid=grid)
    first = sorted(map(tuple, forecaster.forecast(recalculate=True).collect()))
    forecaster.train(Nfts=4, Ncl=3, classifier="DT", compute_only_features=CALCS, grid=grid)
    assert first == sorted(map(tuple, forecaster.forecast(recalculate=True).collect()))


def test_stored_models_are_found_and_retraining_drops_votes(forecaster):
    forecaster.train(Nfts=4, Ncl=5, classifier="NB", compute_only_features=CALCS, retrain=True)
    first = sorted(map(tuple, forecaster.forecast().collect()))
    other = EventForecaster(forecaster.data, 1.0, 0.75, 2.0, data_streams=["rsam", "log_mf"], root=forecaster.root)
    assert sorted(map(tuple, other.forecast().collect())) == first and other.run == forecaster.run
    forecaster.train(Nfts=2, Ncl=3, classifier="NB", compute_only_features=CALCS, retrain=True, random_seed=7)
    assert forecaster.run != other.run
    second = sorted(map(tuple, forecaster.forecast().collect()))
    assert second != first and second == sorted(map(tuple, forecaster.forecast(recalculate=True).collect()))


def test_geometries_do_not_share_tables(forecaster):
    wide = EventForecaster(forecaster.data, 2.0, 0.75, 2.0, data_streams=["rsam", "log_mf"], root=forecaster.root)
    narrow, _ = forecaster.get_features(compute_only_features=CALCS)
    assert wide.get_features(compute_only_features=CALCS)[0].count() != narrow.count()
    with pytest.raises(ValueError):
        wide.forecast()


def test_range_outside_data_is_an_error(forecaster):
    with pytest.raises(ValueError):
        EventForecaster(forecaster.data, 1.0, 0.75, 2.0, tf=(BASE + 10**6) * 600)
    with pytest.raises(ValueError):
        EventForecaster(forecaster.data, 1.0, 0.75, 2.0, ti=0)


def test_updates_compute_only_missing_windows(spark, tmp_path):
    """A day more: only the new windows' part of the series is read, and the store holds what a full computation gives."""
    rng = np.random.default_rng(5)
    x = rng.gamma(4, 5, (144 * 70, 4)).tolist()
    events = spark.createDataFrame([(1, (BASE + 4000) * 600 * 1_000_000)], "station BIGINT, te_us BIGINT")
    calcs = ["mean", "maximum", "median", "agg_linear_trend", "autocorrelation"]
    streams = ["rsam", "diff_mf", "stft_hf"]

    def stored(n, path):
        tables.write_series(make_series(spark, {1: x[:n], 2: x[:n]}), path)
        return SensorSeries(tables.read_series(spark, path), events, path=path)

    old = EventForecaster(stored(144 * 69, str(tmp_path / "s")), 1.0, 0.75, 2.0, data_streams=streams, root=str(tmp_path / "r"))
    before = old.get_features(compute_only_features=calcs[:3])[0].select("station", "win_end").distinct().count()
    data = stored(144 * 70, str(tmp_path / "s2"))
    new = EventForecaster(data, 1.0, 0.75, 2.0, data_streams=streams, root=str(tmp_path / "r"))
    read, months, prune, load = [], [], windows.prune_series, tables.read_series
    windows.prune_series = lambda *a, **k: read.append(prune(*a, **k)) or read[-1]
    tables.read_series = lambda spark, path, m=None: months.append(m) or load(spark, path, m)
    try:
        got = new.get_features(compute_only_features=calcs)[0]
    finally:
        windows.prune_series, tables.read_series = prune, load
    sizes = [r.count() for r in read]
    assert min(sizes) <= 2 * (144 * 2 + 36 + 72) and max(sizes) > 144 * 60  # the day for three calculators, all for the new two
    assert set(months[sizes.index(min(sizes))]) <= {"2023-05", "2023-06"}  # of four stored months
    full = EventForecaster(data, 1.0, 0.75, 2.0, data_streams=streams, root=str(tmp_path / "full")).get_features(compute_only_features=calcs)[0]
    key = lambda df: {(r.station, r.win_end, r.feature): r.value for r in df.collect()}
    a, b = key(got), key(full)
    assert set(a) == set(b) and len({k[:2] for k in a}) == before + 2 * 4
    assert all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-9) for k in a)


def test_windows_are_filled_alike_in_every_request(forecaster):
    """What fills gaps comes from training, not from the period asked for."""
    forecaster.train(Nfts=4, Ncl=3, classifier="NB", compute_only_features=CALCS)
    raw, _ = forecaster._raw_features(compute_only_features=CALCS)
    want = {r.feature: r._med for r in forecaster._statistics().collect()}
    late = (BASE + 144 * 35) * 600
    hole = raw.withColumn("value", raw.value * float("nan"))
    forecaster._raw_features, real = (lambda *a: (hole, None)), forecaster._raw_features
    try:
        got = forecaster.get_features(late, None, (), CALCS, forecaster._statistics())[0]
    finally:
        forecaster._raw_features = real
    assert {(r.feature, r.value) for r in got.select("feature", "value").distinct().collect()} == {(f, v) for f, v in want.items()}


def test_choices_have_models_of_their_own_and_sets_are_taken_up(forecaster, tmp_path):
    forecaster.train(Nfts=4, Ncl=3, classifier="NB", compute_only_features=CALCS)
    first, run = forecaster.choice, forecaster.run
    forecaster.train(Nfts=3, Ncl=3, classifier="NB", compute_only_features=CALCS)
    assert forecaster.choice != first and forecaster.run != run
    forecaster.train(Nfts=4, Ncl=3, classifier="NB", compute_only_features=CALCS)
    assert (forecaster.choice, forecaster.run) == (first, run)  # found again
    ys = sorted(map(tuple, forecaster.forecast().collect()))
    other = EventForecaster(forecaster.data, 1.0, 0.75, 2.0, data_streams=["rsam", "log_mf"], root=str(tmp_path / "o"))
    assert sorted(map(tuple, other.use_model(forecaster.root, first).forecast().collect())) == ys
    with pytest.raises(ValueError):
        EventForecaster(forecaster.data, 1.0, 0.75, 2.0, data_streams=["rsam", "log_mf"], root=str(tmp_path / "p")).use_model(str(tmp_path / "none"))


def test_linear_classifiers_in_the_workflow(forecaster):
    for kind in ("LR", "SVM"):
        forecaster.train(Nfts=3, Ncl=2, classifier=kind, compute_only_features=CALCS, grid=[{"C": 0.1}, {"C": 1}])
        ys = forecaster.forecast()
        assert ys.filter("consensus > 0.5").count() > 0 and ys.filter("consensus IS NULL").count() == 0


def test_forests_in_the_workflow(forecaster):
    grid = [{"n_estimators": n, "max_depth": 2, "criterion": "gini", "max_features": "sqrt"} for n in (2, 4)]
    forecaster.train(Nfts=3, Ncl=2, classifier="RF", compute_only_features=CALCS, grid=grid)
    ys = forecaster.forecast().collect()
    assert ys and all(0 <= r.consensus <= 1 for r in ys)
