"""Numeric kernels over batches of equal-length windows: arrays of shape (windows, samples) to columns.

Only calculators whose definition is a linear solve, a transform or a pairwise count live here.
"""

from __future__ import annotations

import math

import numpy as np

# Parameters of the calculators.
FFT_COEFFS = 100
WELCH_COEFFS = (2, 5, 8)
PACF_LAGS = 10
AR_ORDER, AR_COEFFS = 10, 5
ENTROPY_M = 2
ENTROPY_R = (0.1, 0.3, 0.5, 0.7, 0.9)
SAMPLE_R = 0.2
DRIFT_ORDER, DRIFT_BINS = 3, 30
# Largest condition of a least-squares problem that is solved by a triangular factor.
WELL_POSED = 1e7

Columns = dict[str, np.ndarray]


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return a / b


def fft_coefficient(x: np.ndarray) -> Columns:
    spectrum = np.fft.rfft(x, axis=1)
    out: Columns = {}
    for c in range(FFT_COEFFS):
        v = spectrum[:, c] if c < spectrum.shape[1] else np.full(len(x), np.nan + 0j)
        parts = {"real": v.real, "imag": v.imag, "abs": np.abs(v), "angle": np.degrees(np.angle(v))}
        out |= {f"attr_{a}__coeff_{c}": p for a, p in parts.items()}
    return out


def fft_aggregated(x: np.ndarray) -> Columns:
    """Centroid, variance, skewness and kurtosis of the magnitude spectrum over its bin numbers."""
    y = np.abs(np.fft.rfft(x, axis=1))
    k = np.arange(y.shape[1])
    m1, m2, m3, m4 = (_divide((y * k**p).sum(axis=1), y.sum(axis=1)) for p in (1, 2, 3, 4))
    var = m2 - m1**2
    wide = var >= 0.5
    skew = np.where(wide, _divide(m3 - 3 * m1 * var - m1**3, np.where(wide, var, 1) ** 1.5), np.nan)
    kurt = np.where(wide, _divide(m4 - 4 * m1 * m3 + 6 * m2 * m1**2 - 3 * m1**4, np.where(wide, var, 1) ** 2), np.nan)
    named = {"centroid": m1, "variance": var, "skew": skew, "kurtosis": kurt}
    return {f"aggtype_{n}": v for n, v in named.items()}


def spkt_welch_density(x: np.ndarray) -> Columns:
    """Power density with half-overlapping Hann segments of 256 samples (or the window), mean removed."""
    n = min(256, x.shape[1])
    step = n - n // 2
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, x.shape[1] - n + 1, step)
    power = np.zeros((len(x), n // 2 + 1))
    for s in starts:
        part = x[:, s : s + n]
        part = (part - part.mean(axis=1, keepdims=True)) * hann
        power += np.abs(np.fft.rfft(part, axis=1)) ** 2
    power /= len(starts) * (hann**2).sum()
    power[:, 1 : (-1 if n % 2 == 0 else None)] *= 2
    return {f"coeff_{c}": power[:, c] if c < power.shape[1] else np.full(len(x), np.nan) for c in WELCH_COEFFS}


def partial_autocorrelation(x: np.ndarray) -> Columns:
    """Levinson-Durbin recursion on the unbiased autocovariances."""
    n = x.shape[1]
    z = x - x.mean(axis=1, keepdims=True)
    r = np.stack([(z[:, : n - k] * z[:, k:]).sum(axis=1) / (n - k) for k in range(PACF_LAGS)])
    out = {"lag_0": np.ones(len(x))}
    phi = np.zeros((0, len(x)))
    error = r[0].copy()
    for k in range(1, PACF_LAGS):
        gap = r[k] - (phi * r[k - 1 : 0 : -1]).sum(axis=0) if k > 1 else r[1].copy()
        last = _divide(gap, error)
        phi = np.concatenate([phi - last * phi[::-1], last[None]])
        error = error * (1 - last**2)
        out[f"lag_{k}"] = last
    return out


def _lagged(x: np.ndarray, lags: int) -> np.ndarray:
    """Design rows (1, x[t-1], .., x[t-lags]) for t = lags .. n-1: (windows, n-lags, lags+1)."""
    n = x.shape[1]
    columns = [np.ones((len(x), n - lags))] + [x[:, lags - j : n - j] for j in range(1, lags + 1)]
    return np.stack(columns, axis=2)


def _triangles(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Triangular factors of designs whose last column is the target, from which all of a least-squares fit follows, and which of them
    are sound: designs of full rank by a wide margin and a target that they do not explain wholly. The rest needs singular values."""
    whole = np.stack(columns, axis=2)
    sound = np.isfinite(whole).all(axis=(1, 2))
    whole[~sound] = 0
    r = np.linalg.qr(whole, mode="r")
    k = whole.shape[2] - 1
    if r.shape[1] <= k:
        return r, np.zeros(len(r), bool)
    sound &= (np.abs(np.diagonal(r, axis1=1, axis2=2)) > 0).all(axis=1)
    design = np.where(sound[:, None, None], r[:, :k, :k], np.eye(k))
    with np.errstate(over="ignore", invalid="ignore"):
        spread = np.sqrt((design**2).sum(axis=(1, 2)) * (np.linalg.inv(design) ** 2).sum(axis=(1, 2)))
        sound &= (spread < WELL_POSED) & (np.abs(r[:, k, k]) * WELL_POSED > np.sqrt((r[:, :, k] ** 2).sum(axis=1)))
    return r, sound


def ar_coefficient(x: np.ndarray) -> Columns:
    """Least-squares autoregression with a constant: coefficient 0 is the constant."""
    n = x.shape[1]
    lagged = [x[:, AR_ORDER - j : n - j] for j in range(1, AR_ORDER + 1)]
    r, sound = _triangles([np.ones((len(x), n - AR_ORDER)), *lagged, x[:, AR_ORDER:]])
    beta = np.empty((len(x), AR_ORDER + 1))
    k = AR_ORDER + 1
    beta[sound] = np.linalg.solve(r[sound, :k, :k], r[sound, :k, k:])[:, :, 0]
    for i in np.flatnonzero(~sound):
        beta[i] = np.linalg.lstsq(_lagged(x[i : i + 1], AR_ORDER)[0], x[i, AR_ORDER:], rcond=None)[0]
    return {f"k_{AR_ORDER}__coeff_{c}": beta[:, c] for c in range(AR_COEFFS)}


def _close_shares(window: np.ndarray, m: int, radii: np.ndarray) -> np.ndarray:
    """For each radius, the share of templates of length m within it of each template: (radii, templates)."""
    templates = np.lib.stride_tricks.sliding_window_view(window, m)
    gap = np.zeros((len(templates), len(templates)))
    for j in range(m):
        gap = np.maximum(gap, np.abs(templates[:, j][:, None] - templates[:, j][None, :]))
    return np.stack([(gap <= r).mean(axis=1) for r in radii])


def approximate_entropy(x: np.ndarray) -> Columns:
    out = np.zeros((len(x), len(ENTROPY_R)))
    for i, window in enumerate(x):
        radii = np.array(ENTROPY_R) * window.std()
        phi = [np.log(_close_shares(window, m, radii)).mean(axis=1) for m in (ENTROPY_M, ENTROPY_M + 1)]
        out[i] = np.abs(phi[0] - phi[1])
    return {f"m_{ENTROPY_M}__r_{r}": out[:, j] for j, r in enumerate(ENTROPY_R)}


def sample_entropy(x: np.ndarray) -> Columns:
    """-log of the ratio of close pairs at length 3 to length 2, radius 0.2 deviations, no self-matches."""
    out = np.zeros(len(x))
    for i, window in enumerate(x):
        n = len(window) - ENTROPY_M
        gaps = np.abs(window[:, None] - window[None, :])
        pair = np.maximum(gaps[:n, :n], gaps[1 : n + 1, 1 : n + 1])
        radius = SAMPLE_R * window.std()
        b = (pair <= radius).sum() - n
        a = (np.maximum(pair, gaps[2 : n + 2, 2 : n + 2]) <= radius).sum() - n
        out[i] = -math.log(a / b) if a > 0 and b > 0 else np.inf if b > 0 else np.nan
    return {"": out}


def _drift(window: np.ndarray) -> np.ndarray:
    """Cubic fit of the mean step against the mean level over 30 quantile bins; NaN when it has no solution."""
    level, step = window[:-1], np.diff(window)
    edges = np.unique(np.quantile(level, np.linspace(0, 1, DRIFT_BINS + 1)))
    if len(edges) < DRIFT_ORDER + 2:
        return np.full(DRIFT_ORDER + 1, np.nan)
    place = np.clip(np.searchsorted(edges, level, side="left") - 1, 0, len(edges) - 2)
    count = np.bincount(place, minlength=len(edges) - 1)
    used = count > 0
    x = np.bincount(place, level, len(edges) - 1)[used] / count[used]
    y = np.bincount(place, step, len(edges) - 1)[used] / count[used]
    if used.sum() <= DRIFT_ORDER:
        return np.full(DRIFT_ORDER + 1, np.nan)
    return np.polyfit(x, y, DRIFT_ORDER)


def friedrich_coefficients(x: np.ndarray) -> Columns:
    fits = np.stack([_drift(w) for w in x])
    return {f"m_{DRIFT_ORDER}__r_{DRIFT_BINS}__coeff_{c}": fits[:, c] for c in range(DRIFT_ORDER + 1)}


def max_langevin_fixed_point(x: np.ndarray) -> Columns:
    def root(window: np.ndarray) -> float:
        fit = _drift(window)
        return float(np.max(np.real(np.roots(fit)))) if np.isfinite(fit).all() and np.any(fit[:-1]) else np.nan

    return {f"m_{DRIFT_ORDER}__r_{DRIFT_BINS}": np.array([root(w) for w in x])}


def _most_lags(n: int) -> int:
    return min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)


def _adf(window: np.ndarray) -> tuple[float, float]:
    """Unit-root t statistic with constant; lag count by the Akaike criterion on a common sample."""
    most = _most_lags(len(window))
    d = np.diff(window)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(skip, len(d))
        columns = [window[rows], *[d[rows - j] for j in range(1, lags + 1)], np.ones(len(rows))]
        return np.stack(columns, axis=1), d[rows]

    def fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        return beta, float(((b - a @ beta) ** 2).sum())

    best = None
    for lags in range(most + 1):
        a, b = design(lags, most)
        _, rss = fit(a, b)
        if rss <= 0:
            return math.nan, math.nan
        aic = len(b) * (math.log(2 * math.pi * rss / len(b)) + 1) + 2 * a.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lags)
    a, b = design(best[1], best[1])
    beta, rss = fit(a, b)
    cov = np.linalg.pinv(a.T @ a) * rss / (len(b) - a.shape[1])
    return float(beta[0] / math.sqrt(cov[0, 0])), float(best[1])


def augmented_dickey_fuller(x: np.ndarray) -> Columns:
    """The same for all windows at once. The designs of a window's lag counts on the common sample are the first columns of one, so one
    factor gives all their sums of squares; a second, with the level as its last column, gives the statistic."""
    n, most, d = x.shape[1], _most_lags(x.shape[1]), np.diff(x, axis=1)
    pairs = np.full((len(x), 2), np.nan)

    def columns(at: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        part = d[at]
        before = [part[:, skip - j : n - 1 - j] for j in range(1, lags + 1)]
        return np.ones((len(at), n - 1 - skip)), before, x[at, skip : n - 1], part[:, skip:]

    left = np.arange(len(x))
    if most >= 0 and len(x):
        ones, before, level, target = columns(left, most, most)
        r, sound = _triangles([ones, level, *before, target])
        rows = n - 1 - most
        rss = np.cumsum(r[sound, ::-1, -1] ** 2, axis=1)[:, ::-1][:, 2 : most + 3]
        sizes = np.arange(most + 1) + 2
        best = (rows * (np.log(2 * math.pi * rss / rows) + 1) + 2 * sizes).argmin(axis=1)
        at = np.flatnonzero(sound)
        for lags in np.unique(best):
            mine = at[best == lags]
            ones, before, level, target = columns(mine, lags, lags)
            r, fit = _triangles([*before, ones, level, target])
            k = lags + 2
            with np.errstate(divide="ignore", invalid="ignore"):
                stat = np.sign(r[:, k - 1, k - 1]) * r[:, k - 1, k] / np.sqrt(r[:, k, k] ** 2 / (n - 1 - lags - k))
            pairs[mine[fit]] = np.stack([stat[fit], np.full(fit.sum(), float(lags))], axis=1)
            sound[mine[~fit]] = False
        left = np.flatnonzero(~sound)
    for i in left:
        pairs[i] = _adf(x[i])
    return {"attr_teststat": pairs[:, 0], "attr_usedlag": pairs[:, 1]}


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 300):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1 + term * d)
            c = 1 + term / c
            value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * value


def linear_trend_pvalue(x: np.ndarray) -> Columns:
    """Two-sided p-value of the slope of a straight line through the window."""
    n = x.shape[1]
    t = np.arange(n) - (n - 1) / 2
    z = x - x.mean(axis=1, keepdims=True)
    r = np.clip(_divide((z * t).sum(axis=1), np.sqrt((z**2).sum(axis=1) * (t**2).sum())), -1, 1)
    p = [_beta_tail((n - 2) / 2, 0.5, 1 - v * v) if np.isfinite(v) else np.nan for v in r]
    return {"attr_pvalue": np.array(p)}


KERNELS = {
    f.__name__: f
    for f in (
        fft_coefficient, fft_aggregated, spkt_welch_density, partial_autocorrelation, ar_coefficient,
        approximate_entropy, sample_entropy, friedrich_coefficients, max_langevin_fixed_point,
        augmented_dickey_fuller, linear_trend_pvalue,
    )
}
# The trend's p-value belongs to the calculators whose other attributes are plain sums.
FEATURE_OF = {"linear_trend_pvalue": ("linear_trend", "linear_trend_timewise")}
