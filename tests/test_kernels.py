"""Arrow kernels and filters against direct computations."""

import math

import numpy as np
import pytest

from foreshock.functions import kernels
from foreshock.operators.features_arrow import window_arrow_features
from foreshock.sources import waveforms

RNG = np.random.default_rng(0)
X = RNG.normal(size=(3, 120)).cumsum(axis=1)


def test_fft_matches_sum():
    out = kernels.fft_coefficient(X)
    t = np.arange(120)
    want = (X[1] * np.exp(-2j * np.pi * 7 * t / 120)).sum()
    assert out["attr_real__coeff_7"][1] == pytest.approx(want.real)
    assert out["attr_abs__coeff_7"][1] == pytest.approx(abs(want))
    assert np.isnan(out["attr_abs__coeff_99"]).all()


def test_partial_autocorrelation_solves_yule_walker():
    out = kernels.partial_autocorrelation(X)
    z = X[0] - X[0].mean()
    r = np.array([(z[: 120 - k] * z[k:]).sum() / (120 - k) for k in range(10)])
    for k in (1, 4, 9):
        a = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert out[f"lag_{k}"][0] == pytest.approx(np.linalg.solve(a, r[1 : k + 1])[-1])


def test_approximate_entropy_by_loops():
    x = X[0][:40]
    r = 0.5 * x.std()

    def phi(m):
        t = [x[i : i + m] for i in range(len(x) - m + 1)]
        return np.mean([math.log(sum(np.abs(a - b).max() <= r for b in t) / len(t)) for a in t])

    assert kernels.approximate_entropy(x[None])["m_2__r_0.5"][0] == pytest.approx(abs(phi(2) - phi(3)))


def test_sample_entropy_by_loops():
    x = X[0][:50]
    r, n = 0.2 * x.std(), 48

    def pairs(m):
        return sum(np.abs(x[i : i + m] - x[j : j + m]).max() <= r for i in range(n) for j in range(n) if i != j)

    assert kernels.sample_entropy(x[None])[""][0] == pytest.approx(-math.log(pairs(3) / pairs(2)))


def test_autoregression_recovers_coefficients():
    rng = np.random.default_rng(1)
    x = np.zeros(5000)
    for i in range(1, 5000):
        x[i] = 2 + 0.6 * x[i - 1] + rng.normal()
    out = kernels.ar_coefficient(x[None])
    assert out["k_10__coeff_1"][0] == pytest.approx(0.6, abs=0.05)


def test_unit_root_statistic_is_lower_for_stationary_series():
    noise, walk = RNG.normal(size=(1, 300)), RNG.normal(size=(1, 300)).cumsum(axis=1)
    assert kernels.augmented_dickey_fuller(noise)["attr_teststat"][0] < -5
    assert kernels.augmented_dickey_fuller(walk)["attr_teststat"][0] > -4


def odd_windows():
    """Noise, walks and filled gaps, then constants, lines, periods, steps, single peaks, levels far from zero and a missing value."""
    rng = np.random.default_rng(8)
    t = np.arange(288.0)
    fine = [*rng.normal(size=(20, 288)), *rng.normal(size=(20, 288)).cumsum(axis=1)]
    fine += [np.interp(t, np.sort(rng.choice(288, 40, replace=False)), rng.normal(50, 9, 40)) for _ in range(20)]
    odd = [t * 0, t * 0 + 7.3, t, 3 * t - 50, t % 3, (t > 99) * 1.0, (t == 150) * 1.0, (t == 287) * 1.0, (t == 0) * 1.0]
    odd += [*(1e5 + rng.normal(size=(5, 288))), np.where(t == 5, np.nan, t % 7)]
    return np.array(fine), np.array(odd)


def test_fits_of_many_windows_equal_those_of_each_alone():
    fine, odd = odd_windows()
    every = np.concatenate([fine, odd[:-1]])[np.random.default_rng(1).permutation(len(fine) + len(odd) - 1)]
    got = kernels.augmented_dickey_fuller(every)
    want = np.array([kernels._adf(w) for w in every])
    assert np.allclose(got["attr_usedlag"], want[:, 1], equal_nan=True) and np.isnan(want).any()
    assert np.allclose(got["attr_teststat"], want[:, 0], rtol=1e-8, atol=1e-8, equal_nan=True)
    design = kernels._lagged(every, kernels.AR_ORDER)
    beta = np.stack([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(design, every[:, kernels.AR_ORDER :])])
    got = kernels.ar_coefficient(every)
    assert np.allclose(np.stack([got[f"k_10__coeff_{c}"] for c in range(5)], axis=1), beta[:, :5], rtol=1e-8, atol=1e-8)
    for n in (8, 12, 25):
        short = fine[:30, :n]
        assert np.allclose(kernels.augmented_dickey_fuller(short)["attr_teststat"], [kernels._adf(w)[0] for w in short], rtol=1e-8, equal_nan=True)


def test_ordinary_windows_need_no_singular_values(monkeypatch):
    """A window took a least-squares solution by singular values for each number of lags."""
    fine, odd = odd_windows()
    solve, calls = np.linalg.lstsq, []
    monkeypatch.setattr(np.linalg, "lstsq", lambda *a, **k: calls.append(1) or solve(*a, **k))
    kernels.ar_coefficient(fine)
    kernels.augmented_dickey_fuller(fine)
    assert not calls
    kernels.augmented_dickey_fuller(odd[:3])
    assert calls


def test_trend_p_value_by_integration():
    x = X[0][:20]
    r = np.corrcoef(np.arange(20), x)[0, 1]
    t = abs(r) * math.sqrt(18 / (1 - r * r))
    grid = np.linspace(t, 400, 2_000_001)
    pdf = math.gamma(9.5) / (math.sqrt(18 * math.pi) * math.gamma(9)) * (1 + grid**2 / 18) ** -9.5
    want = 2 * np.trapezoid(pdf, grid)
    assert kernels.linear_trend_pvalue(x[None])["attr_pvalue"][0] == pytest.approx(want, rel=1e-4)


def test_drift_fit_has_root():
    x = np.zeros(2000)
    rng = np.random.default_rng(2)
    for i in range(1, 2000):
        x[i] = x[i - 1] - 0.3 * (x[i - 1] - 1.5) + 0.1 * rng.normal()
    fit = kernels.friedrich_coefficients(x[None])
    top = kernels.max_langevin_fixed_point(x[None])["m_3__r_30"][0]
    poly = [fit[f"m_3__r_30__coeff_{c}"][0] for c in range(4)]
    assert top == pytest.approx(max(np.roots(poly).real))


def test_arrow_features_name_every_value(spark):
    df = spark.createDataFrame([(1, 0, 10, 600, "a", [float(v) for v in X[0]])], "station BIGINT, k BIGINT, e BIGINT, win_end BIGINT, stream STRING, x ARRAY<DOUBLE>")
    out = {r.feature: r.value for r in window_arrow_features(df, ["spkt_welch_density", "linear_trend_pvalue", "sample_entropy"]).collect()}
    assert {"a__spkt_welch_density__coeff_2", "a__linear_trend__attr_pvalue", "a__linear_trend_timewise__attr_pvalue", "a__sample_entropy"} <= set(out)
    assert out["a__sample_entropy"] == pytest.approx(kernels.sample_entropy(X[:1])[""][0])


def recursion(data, low, high, rate):
    """The same filter sample by sample, as one polynomial recursion."""
    edges = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    centre, width = math.sqrt(edges[0] * edges[1]), edges[1] - edges[0]
    p = [np.exp(1j * math.pi * (2 * k + 3) / 8) * width / 2 for k in range(1, 5)]
    an = np.array([q + s * np.sqrt(q * q - centre**2 + 0j) for q in p for s in (1, -1)])
    poles = (2 * rate + an) / (2 * rate - an)
    den, num = np.poly(poles).real, np.poly([1] * 4 + [-1] * 4)
    at = np.exp(1j * 2 * math.atan(centre / (2 * rate)))
    num = num * abs(np.polyval(den, at) / np.polyval(num, at))
    y = np.zeros(len(data))
    for i in range(len(data)):
        y[i] = sum(num[j] * data[i - j] for j in range(9) if i >= j) - sum(den[j] * y[i - j] for j in range(1, 9) if i >= j)
    return y


def test_band_pass_equals_recursion():
    x = RNG.normal(size=3000)
    assert np.allclose(waveforms.band_pass(x, 2, 5, 100.0), recursion(x, 2, 5, 100.0), atol=1e-8)
    assert np.allclose(waveforms.band_pass(x, 8, 16, 100.0), recursion(x, 8, 16, 100.0), atol=1e-10)


def whole_island(x, rate, block):
    """Signals of one island in one piece, by recursion."""
    def sizes(data, low, high):
        whole = block * (len(data) // block)
        return np.abs(recursion(data, low, high, rate)[:whole]).reshape(-1, block).mean(axis=1)

    area = np.concatenate([[0.0], np.cumsum((x[1:] + x[:-1]) / (2 * rate))])
    area -= area.mean()
    out = {n: sizes(x, *band) * 1e9 for n, band in waveforms.BANDS.items()}
    return out | {"dsar": sizes(area, 4.5, 8.0) / sizes(area, 8.0, 16.0)}


def test_reduce_days_by_stretches_with_gaps(spark):
    """Pieces of uneven length, a gap, an overlap, a repeated piece, the end of a day and a piece longer than a stretch."""
    rate, block, day = 50.0, 500, 86400
    islands = {day * 3: 9100, day * 3 + 300: 2600, day * 4 - 20: 1000, day * 4: 1300, day * 4 + 1000: 5000, day * 4 + 1013: 600}
    data, rows = {}, []
    for begin, n in islands.items():
        x = data[begin] = RNG.normal(size=n).astype(np.float32).astype(float)
        at, steps = 0, [700, 150, n] if begin == day * 3 else [n] if begin == day * 4 + 1000 else [400, 350, 250]
        while at < n:
            step = steps.pop(0)
            rows.append((1, begin + at / rate, [float(v) for v in x[at : at + step]]))
            at, steps = at + step, steps + [step]
    rows.append(rows[2])
    df = spark.createDataFrame(rows, "station BIGINT, start_s DOUBLE, samples ARRAY<FLOAT>").repartition(3)
    got = {r.idx: r for r in waveforms.reduce_days(df, rate, 10, blocks=3).collect()}
    want = {}
    for begin, x in sorted(data.items(), reverse=True):
        signals = whole_island(x, rate, block)
        first = begin // day * day // 10 + round((begin % day) / 10)
        want |= {first + k: {n: v[k] for n, v in signals.items()} for k in range(len(x) // block)}
    assert set(got) == set(want) and len(got) > 30
    for idx, signals in want.items():
        for n, v in signals.items():
            assert got[idx][n] == pytest.approx(v, rel=1e-7), (idx, n)


def test_sensitivity(spark):
    df = spark.createDataFrame([(1, [2.0, 4.0])], "station BIGINT, samples ARRAY<FLOAT>")
    st = spark.createDataFrame([(1, 2.0)], "station BIGINT, sensitivity DOUBLE")
    assert waveforms.correct_sensitivity(df, st).first().samples == [1.0, 2.0]
