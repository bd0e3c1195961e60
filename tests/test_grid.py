"""Grid rules on hand tables; results must not depend on the chunk size."""

import numpy as np
import pandas as pd
import pytest
from series_rows import make_series
from pyspark.sql import functions as F

from foreshock.config import Geometry
from foreshock.functions import times
from foreshock.operators import grid, transforms
from foreshock.sources import tables

SIG = ["rsam", "mf"]


def sparse(spark, seed=0, n=900, keep=0.2):
    rng = np.random.default_rng(seed)
    rows = []
    for station in (1, 2):
        for i in range(n):
            if i in (0, n - 1) or (rng.random() < keep and not 300 < i < 600):
                vals = [float(rng.integers(1, 50)) if rng.random() < 0.7 else None for _ in SIG]
                rows.append((station, 2_800_000 + i, *vals))
    return spark.createDataFrame(rows, "station BIGINT, idx BIGINT, rsam DOUBLE, mf DOUBLE"), rows


def expected(rows):
    out = {}
    for station in (1, 2):
        s = pd.DataFrame([r[1:] for r in rows if r[0] == station], columns=["idx", *SIG]).set_index("idx")
        s = s.reindex(range(s.index.min(), s.index.max() + 1)).astype(float).interpolate("linear")
        out |= {(station, i): tuple(v) for i, v in zip(s.index, s.to_numpy())}
    return out


@pytest.mark.parametrize("size", [50, 144, 10000])
def test_interpolation_equals_pandas_for_any_chunk_size(spark, size):
    df, rows = sparse(spark)
    want = expected(rows)
    got = grid.interpolate_linear(df, SIG, size).collect()
    assert len(got) == len(want)
    for r in got:
        for a, b in zip((r.rsam, r.mf), want[(r.station, r.idx)]):
            assert (a is None and np.isnan(b)) or a == pytest.approx(b, abs=1e-9)


def test_leading_gap_stays_null_and_tail_repeats(spark):
    df = spark.createDataFrame([(1, 10, None), (1, 12, 4.0), (1, 15, None)], "station BIGINT, idx BIGINT, rsam DOUBLE")
    got = {r.idx: r.rsam for r in grid.interpolate_linear(df, ["rsam"]).collect()}
    assert got == {10: None, 11: None, 12: 4.0, 13: 4.0, 14: 4.0, 15: 4.0}


def test_off_grid_samples_are_dropped(spark):
    df = spark.sql("SELECT 1L AS station, timestamp_seconds(s) AS ts, 1D AS rsam FROM VALUES (1200), (1800), (1801) AS t(s)")
    assert [r.idx for r in tables.on_grid_rows(df, ["rsam"]).orderBy("idx").collect()] == [2, 3]


def test_dedup_keeps_the_last_loaded(spark, rows):
    df = spark.createDataFrame([(1, 5, 1.0, 0), (1, 5, 2.0, 1), (1, 6, 3.0, 0)], "station BIGINT, idx BIGINT, v DOUBLE, load_seq INT")
    assert rows(grid.dedup_last(df, ("station", "idx")).select("idx", "v")) == [(5, 2.0), (6, 3.0)]


@pytest.mark.parametrize("size", [50, 144, 10000])
def test_midnight_sample_is_mean_of_neighbours(spark, size):
    n = 144 * 3 + 10
    values = [[0, 0, 0, float(i * i)] for i in range(n)]
    got = {r.idx - 2_800_000: r.dsar for r in grid.midnight_smooth(make_series(spark, {1: values}), size=size).collect()}
    for i in range(n):
        hit = i % 144 == 0 and 0 < i and i // 144 < n // 144
        assert got[i] == (0.5 * ((i - 1) ** 2 + (i + 1) ** 2) if hit else i * i)


def stft_numpy(x):
    w = np.array([0.3635819 - 0.4891775 * np.cos(p) + 0.1365995 * np.cos(2 * p) - 0.0106411 * np.cos(3 * p) for p in 2 * np.pi * np.arange(72) / 72])
    padded = np.concatenate([np.zeros(71), x])
    frames = np.lib.stride_tricks.sliding_window_view(padded, 72) * w
    return np.abs(np.fft.rfft(frames, axis=1)[:, 16:18]).mean(axis=1) / w.sum()


@pytest.mark.parametrize("size", [50, 144, 10000])
def test_transforms_equal_numpy(spark, size, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 400).astype(float)
    x[0] = 3
    df = make_series(spark, {1: [[v, 1, 1, 1] for v in x]})
    got = transforms.add_diff(transforms.with_streams(df, ["rsam", "inv_rsam", "log_rsam", "stft_rsam"]), ["rsam"], size).orderBy("idx").toPandas()
    with np.errstate(divide="ignore"):
        assert np.array_equal(got.inv_rsam, 1 / x)
        assert np.allclose(got.log_rsam, np.log10(x))
    assert np.allclose(got.diff_rsam, np.diff(x, prepend=x[0]))
    assert np.allclose(got.stft_rsam, stft_numpy(x))


def test_log_of_negative_is_nan_and_names_are_checked(spark):
    df = make_series(spark, {1: [[-1, 1, 1, 1]]})
    assert np.isnan(transforms.with_streams(df, ["log_rsam"]).first().log_rsam)
    with pytest.raises(ValueError):
        transforms.check_streams(["inv_inv_rsam"])
    with pytest.raises(ValueError):
        transforms.check_streams(["nope"])


def test_range_is_half_open_and_default_drops_last(spark):
    df = make_series(spark, {1: [[i, 1, 1, 1] for i in range(10)]})
    assert tables.time_range(df).count() == 9
    t = 2_800_000 * 600
    assert sorted(r.rsam for r in tables.time_range(df, t + 600, t + 1800).collect()) == [1.0, 2.0]


def test_time_parsing(spark):
    df = spark.createDataFrame([("2012 08 04 16 52 00",), ("2012-08-04",), ("2012-08-04 16:52:00",)], "s STRING")
    got = [r.t for r in df.select(F.unix_seconds(times.parse_time(F.col("s"), strict=True)).alias("t")).collect()]
    assert got == [1344099120, 1344038400, 1344099120]
    assert times.to_seconds("2012 08 04 16 52 00") == 1344099120
    with pytest.raises(Exception, match="as a time"):
        spark.createDataFrame([("04/08/2012",)], "s STRING").select(times.parse_time(F.col("s"), strict=True)).collect()
    with pytest.raises(ValueError):
        times.to_seconds("04/08/2012")


def test_start_rounds_half_to_even(spark):
    df = spark.createDataFrame([(300,), (900,), (299,)], "s BIGINT")
    assert [r.t for r in df.select(times.nearest_grid(F.col("s")).alias("t")).collect()] == [0, 1200, 0]


def test_event_list_file(spark, tmp_path):
    path = tmp_path / "events.txt"
    path.write_text("2012 08 04 16 52 00\n2013 08 19 22 23 00")
    got = sorted(r.te_us for r in tables.read_event_list(spark, str(path), 3).collect())
    assert got == [1344099120_000000, 1376950980_000000]


def test_series_round_trip_replaces_only_its_months(spark, tmp_path):
    df = make_series(spark, {1: [[i, 1, 1, 1] for i in range(20)]})
    tables.write_series(df, str(tmp_path / "s"))
    later = df.withColumn("idx", F.col("idx") + 10_000)
    tables.write_series(later, str(tmp_path / "s"))
    tables.write_series(df.withColumn("rsam", F.lit(7.0)), str(tmp_path / "s"))
    back = tables.read_series(spark, str(tmp_path / "s"))
    assert back.count() == 40 and back.filter("rsam = 7").count() >= 20
    tables.write_series_csv(df, str(tmp_path / "c"))


def test_geometry():
    g = Geometry(2, 1.0, 2)
    assert (g.iw, g.io, g.hop, g.alert_span) == (288, 287, 1, 288.0)
    assert (Geometry().hop, Geometry().alert_reach) == (72, 4)
