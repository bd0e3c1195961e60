"""Window features that are sums: mergeable aggregates over (station, window, stream).

Samples are melted to one row per stream, earlier samples are attached once on the series (so a sample's
lags are shared by all windows that hold it), and one aggregate computes every wanted calculator. All buffers
are fixed-width, so partial results of a window form on the map side and only those are shuffled.

Calculators are SQL expressions over ``x`` (sample), ``x_1 ..`` (earlier samples) and ``pos`` (place in the
window). A sample's lags may lie outside the window; ``_in`` leaves those rows out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.config import CHUNK, SAMPLES_PER_DAY, STEP_SECONDS, Geometry
from foreshock.functions.numbers import floor_div
from foreshock.operators.chunks import chunk_order, drop_halo, place, with_halo
from foreshock.operators.windows import complete_only, window_rows

# Parameters of the calculators.
R_LARGE_SD = [round(0.05 * i, 2) for i in range(1, 20)]
VALUES = (0, 1, -1)
RANGES = ((-1.0, 1.0), (1e12, 0.0), (0.0, 1e12))
CROSSINGS = (0, -1, 1)
LAGS_SHORT = (1, 2, 3)
LAGS_AUTO = tuple(range(10))
MAX_LAG = 40
SEGMENTS = 10
WAVELET_WIDTHS = (2, 5, 10, 20)
WAVELET_COEFFS = 15
TREND_CHUNKS = (5, 10, 50)
TREND_STATS = ("max", "min", "mean", "var")
TREND_ATTRS = ("slope", "intercept", "rvalue", "stderr")

KEYS = ("station", "k", "e", "win_end", "stream")
# What samples are grouped by: the window date implies its grid index, and streams are numbered.
GROUP = ("station", "code", "k", "win_end")
Named = dict[str, str]


@dataclass(frozen=True)
class Calculator:
    """``aggs``: named aggregates of a window of n samples; ``outs``: params -> expression over those names;
    ``mid``: named expressions between the two; ``lag``: look-back needed."""

    aggs: Callable[[int], Named]
    outs: Callable[[int], Named]
    lag: int = 0
    mid: Callable[[int], Named] = field(default=lambda n: {})


def _x(lag: int) -> str:
    return "x" if lag == 0 else f"x_{lag}"


def _in(lag: int, value: str) -> str:
    return value if lag == 0 else f"CASE WHEN pos >= {lag} THEN {value} END"


def _flag(condition: str) -> str:
    return f"CAST({condition} AS DOUBLE)"


_BASE = {
    "n": "count(x)",
    "s": "sum(x)",
    "q": "sum(x * x)",
    "sd": "stddev_pop(x)",
    "vp": "var_pop(x)",
    "mx": "max(x)",
    "mn": "min(x)",
    "mu": "avg(x)",
    "skew": "skewness(x)",
    "kurt": "kurtosis(x)",
    "d2": f"sum({_in(1, '(x - x_1) * (x - x_1)')})",
    "da": f"sum({_in(1, 'abs(x - x_1)')})",
    "x_first": "max(CASE WHEN pos = 0 THEN x END)",
}


def _simple(names: Sequence[str], outs: Callable[[int], Named], lag: int = 0) -> Calculator:
    return Calculator(lambda n: {a: _BASE[a] for a in names}, outs, lag)


def _one(names: Sequence[str], out: str, lag: int = 0) -> Calculator:
    return _simple(names, lambda n: {"": out}, lag)


def _lag_sums(lags: Sequence[int]) -> Named:
    return {f"ac{i}": f"sum({_in(i, f'x * {_x(i)}')})" for i in lags} | {
        f"ah{i}": f"sum({_in(i, f'x + {_x(i)}')})" for i in lags
    }


def _lag_cov(n: int, i: int) -> str:
    """Mean product of deviations of samples ``i`` apart."""
    return f"(ac{i} - mu * ah{i} + {n - i} * mu * mu) / {n - i}"


def _autocorrelation() -> Calculator:
    return Calculator(
        lambda n: {a: _BASE[a] for a in ("mu", "vp")} | _lag_sums(LAGS_AUTO),
        lambda n: {f"lag_{i}": f"try_divide({_lag_cov(n, i)}, vp)" for i in LAGS_AUTO},
        max(LAGS_AUTO),
    )


def _agg_autocorrelation() -> Calculator:
    def mid(n: int) -> Named:
        return {"acf": "array_sort(array(" + ", ".join(_lag_cov(n, i) for i in range(1, MAX_LAG + 1)) + "))"}

    def outs(n: int) -> Named:
        mean = f"(aggregate(acf, 0D, (a, v) -> a + v) / {MAX_LAG})"
        square = f"(aggregate(acf, 0D, (a, v) -> a + v * v) / {MAX_LAG})"
        middle = f"((acf[{MAX_LAG // 2 - 1}] + acf[{MAX_LAG // 2}]) / 2)"
        return {
            f"f_agg_mean__maxlag_{MAX_LAG}": f"try_divide({mean}, vp)",
            f"f_agg_median__maxlag_{MAX_LAG}": f"try_divide({middle}, vp)",
            f"f_agg_var__maxlag_{MAX_LAG}": f"try_divide({square} - {mean} * {mean}, vp * vp)",
        }

    return Calculator(
        lambda n: {a: _BASE[a] for a in ("mu", "vp")} | _lag_sums(range(1, MAX_LAG + 1)), outs, MAX_LAG, mid
    )


def _lag_products(product: Callable[[int], str], prefix: str) -> Calculator:
    return Calculator(
        lambda n: {f"{prefix}{i}": f"avg({_in(2 * i, product(i))})" for i in LAGS_SHORT},
        lambda n: {f"lag_{i}": f"{prefix}{i}" for i in LAGS_SHORT},
        2 * max(LAGS_SHORT),
    )


def segment_of(n: int, segments: int = SEGMENTS) -> str:
    """Number of the segment of a position when the first ``n mod segments`` hold one extra sample."""
    short, extra = divmod(n, segments)
    edge = extra * (short + 1)
    return f"CASE WHEN pos < {edge} THEN pos div {short + 1} ELSE {extra} + (pos - {edge}) div {max(short, 1)} END"


def _energy_ratio() -> Calculator:
    return Calculator(
        lambda n: {"q": _BASE["q"]}
        | {f"en{i}": f"sum(CASE WHEN ({segment_of(n)}) = {i} THEN x * x ELSE 0D END)" for i in range(SEGMENTS)},
        lambda n: {f"num_segments_{SEGMENTS}__segment_focus_{i}": f"try_divide(en{i}, q)" for i in range(SEGMENTS)},
    )


def _trend(scale: float) -> Calculator:
    """Least squares on the position times ``scale``; a constant window has correlation 0."""

    def outs(n: int) -> Named:
        spread = (n * n - 1) / 12.0
        r = f"coalesce(try_divide(cv, sqrt(vp * {spread!r}D)), 0D)"
        return {
            "attr_slope": f"cv / {scale * spread!r}D",
            "attr_intercept": f"mu - cv * {(n - 1) / 2 / spread!r}D",
            "attr_rvalue": r,
            "attr_stderr": f"sqrt(greatest((1 - {r} * {r}) * vp / {scale * scale * spread * (n - 2)!r}D, 0D))",
        }

    return Calculator(
        lambda n: {"cv": "covar_pop(x, CAST(pos AS DOUBLE))", "mu": _BASE["mu"], "vp": _BASE["vp"]}, outs
    )


def ricker(points: int, width: float) -> list[float]:
    scale = 2 / (math.sqrt(3 * width) * math.pi**0.25)
    squares = [(i - (points - 1) / 2) ** 2 for i in range(points)]
    return [scale * (1 - t / width**2) * math.exp(-t / (2 * width**2)) for t in squares]


def wavelet_weights(n: int, width: int, coeff: int) -> list[float]:
    """Weights on the first samples of a window that give one wavelet coefficient ('same' convolution)."""
    points = min(10 * width, n)
    psi = ricker(points, width)
    centre = coeff + (points - 1) // 2
    return [psi[centre - p] if 0 <= centre - p < points else 0.0 for p in range(min(n, centre + 1))]


def literal_array(values: Iterable[float]) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def _wavelets() -> Calculator:
    """Wavelet coefficients are fixed weights on the samples: plain weighted sums."""

    def names(n: int) -> list[tuple[int, int]]:
        return [(w, c) for w in WAVELET_WIDTHS for c in range(min(WAVELET_COEFFS, n))]

    widths = ", ".join(map(str, WAVELET_WIDTHS))
    return Calculator(
        lambda n: {
            f"cw{w}_{c}": f"sum(x * get({literal_array(wavelet_weights(n, w, c))}, CAST(pos AS INT)))"
            for w, c in names(n)
        },
        lambda n: {f"coeff_{c}__w_{w}__widths_({widths})": f"cw{w}_{c}" for w, c in names(n)},
    )


CALCULATORS: dict[str, Calculator] = {
    "sum_values": _one(["s"], "s"),
    "abs_energy": _one(["q"], "q"),
    "mean": _one(["mu"], "mu"),
    "length": _one(["n"], "CAST(n AS DOUBLE)"),
    "standard_deviation": _one(["sd"], "sd"),
    "variance": _one(["vp"], "vp"),
    "skewness": _simple(["skew"], lambda n: {"": f"skew * {(n * (n - 1)) ** 0.5 / (n - 2)!r}D"}),
    "kurtosis": _simple(
        ["kurt"], lambda n: {"": f"({n + 1} * kurt + 6) * {(n - 1) / ((n - 2) * (n - 3))!r}D"}
    ),
    "maximum": _one(["mx"], "mx"),
    "minimum": _one(["mn"], "mn"),
    "variance_larger_than_standard_deviation": _one(["vp", "sd"], _flag("vp > sd")),
    "large_standard_deviation": _simple(
        ["sd", "mx", "mn"], lambda n: {f"r_{r}": _flag(f"sd > {r}D * (mx - mn)") for r in R_LARGE_SD}
    ),
    "mean_abs_change": _simple(["da"], lambda n: {"": f"da / {n - 1}"}, 1),
    "mean_change": Calculator(
        lambda n: {"x_first": _BASE["x_first"], "x_last": f"max(CASE WHEN pos = {n - 1} THEN x END)"},
        lambda n: {"": f"(x_last - x_first) / {n - 1}"},
    ),
    "absolute_sum_of_changes": _one(["da"], "da", 1),
    "mean_second_derivative_central": Calculator(
        lambda n: {"d2c": f"avg({_in(2, '(x - 2 * x_1 + x_2) / 2')})"}, lambda n: {"": "d2c"}, 2
    ),
    "cid_ce": _simple(
        ["d2", "sd"],
        lambda n: {"normalize_True": "coalesce(try_divide(sqrt(d2), sd), 0D)", "normalize_False": "sqrt(d2)"},
        1,
    ),
    "value_count": Calculator(
        lambda n: {f"vc{i}": f"count_if(x = {v})" for i, v in enumerate(VALUES)},
        lambda n: {f"value_{v}": f"CAST(vc{i} AS DOUBLE)" for i, v in enumerate(VALUES)},
    ),
    "range_count": Calculator(
        lambda n: {f"rc{i}": f"count_if(x >= {a!r}D AND x < {b!r}D)" for i, (a, b) in enumerate(RANGES)},
        lambda n: {f"max_{b:g}__min_{a:g}": f"CAST(rc{i} AS DOUBLE)" for i, (a, b) in enumerate(RANGES)},
    ),
    "number_crossing_m": Calculator(
        lambda n: {f"cr{i}": f"count_if(pos >= 1 AND (x > {m}) <> (x_1 > {m}))" for i, m in enumerate(CROSSINGS)},
        lambda n: {f"m_{m}": f"CAST(cr{i} AS DOUBLE)" for i, m in enumerate(CROSSINGS)},
        1,
    ),
    "time_reversal_asymmetry_statistic": _lag_products(
        lambda i: f"x * x * x_{i} - x_{i} * x_{2 * i} * x_{2 * i}", "tr"
    ),
    "c3": _lag_products(lambda i: f"x * x_{i} * x_{2 * i}", "cc"),
    "autocorrelation": _autocorrelation(),
    "agg_autocorrelation": _agg_autocorrelation(),
    "energy_ratio_by_chunks": _energy_ratio(),
    "linear_trend": _trend(1.0),
    "linear_trend_timewise": _trend(24.0 / SAMPLES_PER_DAY),
    "cwt_coefficients": _wavelets(),
}

# Computed by its own two-level aggregate below.
CHUNK_TREND = "agg_linear_trend"
NAMES = (*CALCULATORS, CHUNK_TREND)


def attach_lags(df: DataFrame, streams: Sequence[str], lag: int = 0, size: int = CHUNK, keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample and stream, ``station, t0, t1, idx, code, x``, with the ``lag`` samples before it
    as ``x_1 ..``, found once per series, in chunks. ``code`` is the place of the stream in ``streams``.
    The columns ``keep`` ride along."""
    rows = df.select("station", "t0", "t1", "idx", *keep, *streams)
    if lag:
        order, whole = chunk_order(), F.struct(*streams)
        halo = with_halo(rows, before=lag, size=size)
        rows = drop_halo(halo.withColumns({f"p_{j}": F.lag(whole, j).over(order) for j in range(1, lag + 1)}))
    pairs = ", ".join(
        f"named_struct('code', {i}, 'x', `{s}`"
        + "".join(f", 'x_{j}', p_{j}.`{s}`" for j in range(1, lag + 1))
        + ")"
        for i, s in enumerate(streams)
    )
    return rows.selectExpr("station", "t0", "t1", "idx", *keep, f"inline(array({pairs}))")


def group_keys(streams: Sequence[str]) -> list[str]:
    """The key columns of grouped rows (``GROUP``), in full: stream names and the window end on the grid."""
    names = ", ".join(f"'{s}'" for s in streams)
    return ["station", "k", f"ceil(win_end / {STEP_SECONDS}) AS e", "win_end", f"array({names})[code] AS stream"]


def column_name(calculator: str, params: str) -> str:
    return f"{calculator}__{params}" if params else calculator


def window_sums(
    df: DataFrame,
    geom: Geometry,
    streams: Sequence[str],
    calculators: Iterable[str],
    ti: float | None = None,
    tf: float | None = None,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Wide features per (window, stream): one column per calculator and parameter set."""
    chosen = {c: CALCULATORS[c] for c in calculators}
    n = geom.iw
    lag = max((c.lag for c in chosen.values()), default=0)
    rows = window_rows(attach_lags(df, streams, lag), geom, ti, tf, runs)
    aggs, mid, outs = {"n": _BASE["n"]}, {}, []
    for name, calc in chosen.items():
        aggs |= calc.aggs(n)
        mid |= calc.mid(n)
        outs += [f"{expr} AS `{column_name(name, p)}`" for p, expr in calc.outs(n).items()]
    summed = complete_only(rows.groupBy(*GROUP).agg(*[F.expr(f"{a} AS {name}") for name, a in aggs.items()]), geom)
    if mid:
        summed = summed.selectExpr("*", *[f"{m} AS {name}" for name, m in mid.items()])
    return summed.selectExpr(*group_keys(streams), *outs)


def chunk_trends(
    df: DataFrame,
    geom: Geometry,
    streams: Sequence[str],
    ti: float | None = None,
    tf: float | None = None,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Trend over the max, min, mean and variance of runs of 5, 10 and 50 samples in each window.

    Runs of 10 and 50 are unions of runs of 5, so the first aggregate shrinks the samples to a fifth and the
    later ones combine its counts, sums and squared deviations. Samples move once, to the chunks in which their
    windows end; all aggregates of a window find its rows there.
    """
    size, idx = max(CHUNK, 4 * geom.iw), F.col("idx")
    homes = F.sequence(floor_div(idx + 1, size), floor_div(idx + geom.iw, size))
    copies = place(df.select("station", "t0", "t1", "idx", *streams, F.explode(homes).alias("home")), "station", "home")
    rows = window_rows(attach_lags(copies, streams, keep=["home"]), geom, ti, tf, runs).filter(floor_div(F.col("e"), size) == F.col("home"))
    group = ("home", *GROUP)
    parts = rows.groupBy(*group, F.expr("pos div 5 AS part")).agg(
        *map(F.expr, ["count(x) AS c", "sum(x) AS s", "avg(x) AS a", "var_pop(x) AS v", "max(x) AS mx", "min(x) AS mn"])
    )
    levels = ", ".join(map(str, TREND_CHUNKS))
    runs = (
        parts.selectExpr("*", f"explode(array({levels})) AS length")
        .groupBy(*group, "length", F.expr("part * 5 div length AS run"))
        .agg(
            *map(
                F.expr,
                ["sum(c) AS c", "sum(s) AS s", "sum(c * (v + a * a)) AS q", "max(mx) AS max", "min(mn) AS min"],
            )
        )
        .selectExpr("*", "s / c AS mean", "greatest(q / c - (s / c) * (s / c), 0D) AS var")
    )
    fits = runs.groupBy(*group, "length").agg(
        F.expr("count(run) AS m"),
        F.expr("sum(c) AS n"),
        F.expr("avg(run) AS x_mean"),
        F.expr("var_pop(run) AS x_var"),
        *[
            F.expr(f"{agg} AS {part}_{s}")
            for s in TREND_STATS
            for part, agg in (("cv", f"covar_pop({s}, CAST(run AS DOUBLE))"), ("mu", f"avg({s})"), ("vp", f"var_pop({s})"))
        ],
    )
    slopes = [f"try_divide(cv_{s}, x_var) AS slope_{s}" for s in TREND_STATS]
    rest = [
        expr.format(s=s)
        for s in TREND_STATS
        for expr in (
            "mu_{s} - slope_{s} * x_mean AS intercept_{s}",
            "coalesce(try_divide(cv_{s}, sqrt(vp_{s} * x_var)), 0D) AS rvalue_{s}",
        )
    ]
    error = "sqrt(greatest(try_divide((1 - rvalue_{s} * rvalue_{s}) * vp_{s}, x_var * (m - 2)), 0D)) AS stderr_{s}"
    fits = fits.selectExpr("*", *slopes).selectExpr("*", *rest)
    kept = [f"{a}_{s}" for s in TREND_STATS for a in TREND_ATTRS[:3]]
    return complete_only(fits, geom).selectExpr(
        *group_keys(streams), "length", *kept, *[error.format(s=s) for s in TREND_STATS]
    )
