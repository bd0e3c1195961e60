"""Queries: windows, labels and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreshock.config import SIGNALS, Geometry
from foreshock.operators import features_agg, features_array, windows
from foreshock.plans.catalog import query, sql, sql_out
from foreshock.sources import landing

GEOM = Geometry(window=2.0, overlap=0.75, look_forward=2.0)
N = GEOM.iw
OUT = "station, win_end, stream"


def agg_query(name: str, calculators: list[str], body: str | None, steps: str | None = None):
    """Register the columns of some sum-like calculators and the SQL giving the same columns."""
    columns = [
        features_agg.column_name(c, p)
        for c in calculators
        for p in _params(c)
    ]

    def run(spark, sf_dir):
        feats = features_agg.window_sums(landing.series(spark, sf_dir), GEOM, SIGNALS, calculators)
        return feats.drop("k", "e")

    out = sql_out(body, OUT, columns)
    return query(name, sql(steps, out) if steps else sql(out))(run)


# Parameter names of each calculator, stated for the checking SQL.
def _params(name: str) -> list[str]:
    return {
        "large_standard_deviation": [f"r_{r}" for r in features_agg.R_LARGE_SD],
        "cid_ce": ["normalize_True", "normalize_False"],
        "value_count": [f"value_{v}" for v in (0, 1, -1)],
        "range_count": ["max_1__min_-1", "max_0__min_1e+12", "max_1e+12__min_0"],
        "number_crossing_m": [f"m_{m}" for m in (0, -1, 1)],
        "time_reversal_asymmetry_statistic": [f"lag_{i}" for i in (1, 2, 3)],
        "c3": [f"lag_{i}" for i in (1, 2, 3)],
        "autocorrelation": [f"lag_{i}" for i in range(10)],
        "energy_ratio_by_chunks": [f"num_segments_10__segment_focus_{i}" for i in range(10)],
        "linear_trend": [f"attr_{a}" for a in ("slope", "intercept", "rvalue", "stderr")],
        "linear_trend_timewise": [f"attr_{a}" for a in ("slope", "intercept", "rvalue", "stderr")],
        "quantile": [f"q_{q}" for q in features_array.QUANTILES],
        "symmetry_looking": [f"r_{r}" for r in features_array.R_SYMMETRY],
        "ratio_beyond_r_sigma": [f"r_{r}" for r in features_array.R_SIGMA],
        "agg_autocorrelation": [f"f_agg_{f}__maxlag_40" for f in ("mean", "median", "var")],
        "index_mass_quantile": [f"q_{q}" for q in features_array.QUANTILES],
        "binned_entropy": ["max_bins_10"],
        "number_peaks": [f"n_{s}" for s in features_array.PEAK_SUPPORTS],
        "change_quantiles": [
            f"f_agg_{f}__isabs_{a}__qh_{h}__ql_{low}"
            for low, h in features_array.CORRIDORS
            for f, a in (("mean", False), ("mean", True), ("var", False), ("var", True))
        ],
        "cwt_coefficients": [
            f"coeff_{c}__w_{w}__widths_(2, 5, 10, 20)" for w in features_agg.WAVELET_WIDTHS for c in range(15)
        ],
    }.get(name, [""])


def array_query(name: str, calculators: list[str], body: str, steps: str | None = None):
    columns = [features_agg.column_name(c, p) for c in calculators for p in _params(c)]

    def run(spark, sf_dir):
        arrays = windows.window_arrays(landing.series(spark, sf_dir), GEOM, SIGNALS)
        if calculators == [features_array.CHANGE_QUANTILES]:
            return features_array.change_quantiles(arrays, GEOM).drop("k", "e")
        return features_array.window_array_features(arrays, GEOM, calculators).drop("k", "e")

    out = sql_out(body, OUT, columns)
    return query(name, sql(steps, out) if steps else sql(out))(run)


# ---- windows ---------------------------------------------------------------------------------------------

@query(
    "window_slide",
    sql("SELECT station, win_end, count(*) AS samples, min(pos) AS first_pos, max(pos) AS last_pos "
        "FROM wx WHERE stream = 'rsam' GROUP BY station, win_end"),
)
def window_slide(spark, sf_dir):
    rows = windows.window_rows(landing.series(spark, sf_dir), GEOM)
    counted = rows.groupBy("station", "win_end").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )
    return windows.complete_only(counted, GEOM).withColumnRenamed("n", "samples")


@query("window_slice", sql("SELECT station, k, win_end FROM win WHERE k >= 5 AND k < 40"))
def window_slice(spark, sf_dir):
    dates = windows.window_dates(landing.series(spark, sf_dir), GEOM)
    return windows.skip_windows(dates, 5, 40).drop("e")


# ---- sum-like features -----------------------------------------------------------------------------------

GROUP = "GROUP BY station, win_end, stream"

agg_query(
    "feat_moments",
    ["sum_values", "abs_energy", "mean", "length", "standard_deviation", "variance", "skewness", "kurtosis",
     "maximum", "minimum", "variance_larger_than_standard_deviation", "large_standard_deviation"],
    f"""SELECT station, win_end, stream, sum(x) AS sum_values, sum(x*x) AS abs_energy, avg(x) AS mean,
      count(*) * 1.0::DOUBLE AS length, stddev_pop(x) AS standard_deviation, var_pop(x) AS variance,
      skewness(x) AS skewness, kurtosis(x) AS kurtosis, max(x) AS maximum, min(x) AS minimum,
      (CASE WHEN var_pop(x) > stddev_pop(x) THEN 1 ELSE 0 END)::DOUBLE AS variance_larger_than_standard_deviation,
      {", ".join(f'(CASE WHEN stddev_pop(x) > {r} * (max(x) - min(x)) THEN 1 ELSE 0 END)::DOUBLE AS "large_standard_deviation__r_{r}"' for r in features_agg.R_LARGE_SD)}
      FROM wx {GROUP}""",
)

_LAGGED = "lagged AS (SELECT *, " + ", ".join(
    f"lag(x, {i}) OVER (PARTITION BY station, win_end, stream ORDER BY pos) AS l{i}" for i in range(1, 10)
) + " FROM wx)"

agg_query(
    "feat_changes",
    ["mean_abs_change", "mean_change", "absolute_sum_of_changes", "mean_second_derivative_central", "cid_ce",
     "time_reversal_asymmetry_statistic", "c3"],
    f"""SELECT station, win_end, stream, avg(abs(x - l1)) AS mean_abs_change, avg(x - l1) AS mean_change,
      sum(abs(x - l1)) AS absolute_sum_of_changes, avg((x - 2*l1 + l2) / 2) AS mean_second_derivative_central,
      sqrt(sum((x - l1)*(x - l1))) / stddev_pop(x) AS "cid_ce__normalize_True",
      sqrt(sum((x - l1)*(x - l1))) AS "cid_ce__normalize_False",
      {", ".join(f'avg(x*x*l{i} - l{i}*l{2*i}*l{2*i}) AS "time_reversal_asymmetry_statistic__lag_{i}", avg(x*l{i}*l{2*i}) AS "c3__lag_{i}"' for i in (1, 2, 3))}
      FROM lagged {GROUP}""",
    _LAGGED,
)

agg_query(
    "feat_counts",
    ["value_count", "range_count", "number_crossing_m"],
    f"""SELECT station, win_end, stream,
      {", ".join(f'count(*) FILTER (x = {v})::DOUBLE AS "value_count__value_{v}"' for v in (0, 1, -1))},
      count(*) FILTER (x >= -1 AND x < 1)::DOUBLE AS "range_count__max_1__min_-1",
      count(*) FILTER (x >= 1e12 AND x < 0)::DOUBLE AS "range_count__max_0__min_1e+12",
      count(*) FILTER (x >= 0 AND x < 1e12)::DOUBLE AS "range_count__max_1e+12__min_0",
      {", ".join(f'count(*) FILTER ((x > {m}) <> (l1 > {m}))::DOUBLE AS "number_crossing_m__m_{m}"' for m in (0, -1, 1))}
      FROM lagged {GROUP}""",
    _LAGGED,
)

agg_query(
    "feat_autocorr",
    ["autocorrelation"],
    f"""SELECT l.station, l.win_end, l.stream, {", ".join(
        f'sum((x - mu) * ({"l" + str(i) if i else "x"} - mu)) / (({N} - {i}) * any_value(va)) AS "autocorrelation__lag_{i}"'
        for i in range(10))}
      FROM lagged l JOIN centre c ON c.station = l.station AND c.win_end = l.win_end AND c.stream = l.stream
      GROUP BY l.station, l.win_end, l.stream""",
    _LAGGED + f", centre AS (SELECT station, win_end, stream, avg(x) AS mu, var_pop(x) AS va FROM wx {GROUP})",
)


def _trend_sql(name: str, at: str) -> str:
    err = f"sqrt(greatest(0, (1 - corr(x, {at}) * corr(x, {at})) * var_pop(x) / var_pop({at}) / ({N} - 2)))"
    return (
        f'regr_slope(x, {at}) AS "{name}__attr_slope", regr_intercept(x, {at}) AS "{name}__attr_intercept", '
        f'corr(x, {at}) AS "{name}__attr_rvalue", {err} AS "{name}__attr_stderr"'
    )


agg_query(
    "feat_trend",
    ["linear_trend", "linear_trend_timewise"],
    f"SELECT station, win_end, stream, {_trend_sql('linear_trend', 'pos')}, "
    f"{_trend_sql('linear_trend_timewise', '(pos / 6)')} FROM wx {GROUP}",
)

agg_query(
    "feat_chunks",
    ["energy_ratio_by_chunks"],
    "SELECT station, win_end, stream, "
    + ", ".join(
        f'coalesce(sum(x*x) FILTER (seg = {i}), 0) / sum(x*x) AS "energy_ratio_by_chunks__num_segments_10__segment_focus_{i}"'
        for i in range(10)
    )
    + f" FROM (SELECT *, CASE WHEN pos < 232 THEN pos // 29 ELSE 8 + (pos - 232) // 28 END AS seg FROM wx) {GROUP}",
)

_FITS = ", ".join(
    f"regr_slope({s}, run) AS slope_{s}, regr_intercept({s}, run) AS intercept_{s}, corr({s}, run) AS rvalue_{s}, "
    f"sqrt(greatest(0, (1 - corr({s}, run) * corr({s}, run)) * var_pop({s}) / var_pop(run) / (count(*) - 2))) AS stderr_{s}"
    for s in ("max", "min", "mean", "var")
)


@query(
    "feat_chunk_trend",
    sql(
        'runs AS (SELECT station, win_end, stream, length, pos // length AS run, max(x) AS "max", min(x) AS "min", '
        "avg(x) AS mean, var_pop(x) AS var FROM wx, (SELECT unnest([5, 10, 50]) AS length) GROUP BY ALL)",
        sql_out(
            f"SELECT station, win_end, stream, length::BIGINT AS length, {_FITS} FROM runs GROUP BY ALL",
            OUT + ", length",
            [f"{a}_{s}" for s in ("max", "min", "mean", "var") for a in ("slope", "intercept", "rvalue", "stderr")],
        ),
    ),
)
def feat_chunk_trend(spark, sf_dir):
    return features_agg.chunk_trends(landing.series(spark, sf_dir), GEOM, SIGNALS).drop("k", "e")


# ---- features of the ordered window ----------------------------------------------------------------------

_CENTRE = f"centre AS (SELECT station, win_end, stream, avg(x) AS mu, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi, sum(abs(x)) AS mass FROM wx {GROUP})"
_ABOUT = f"about AS (SELECT wx.*, mu, sd, lo, hi, mass FROM wx JOIN centre USING (station, win_end, stream))"

array_query(
    "feat_quantiles",
    ["median", "quantile", "symmetry_looking"],
    f"""SELECT station, win_end, stream, median(x) AS median,
      {", ".join(f'quantile_cont(x, {q}) AS "quantile__q_{q}"' for q in features_array.QUANTILES)},
      {", ".join(f'(CASE WHEN abs(avg(x) - median(x)) < {r} * (max(x) - min(x)) THEN 1 ELSE 0 END)::DOUBLE AS "symmetry_looking__r_{r}"' for r in features_array.R_SYMMETRY)}
      FROM wx {GROUP}""",
)

array_query(
    "feat_sigma",
    ["count_above_mean", "count_below_mean", "ratio_beyond_r_sigma"],
    f"""SELECT station, win_end, stream, count(*) FILTER (x > mu)::DOUBLE AS count_above_mean,
      count(*) FILTER (x < mu)::DOUBLE AS count_below_mean,
      {", ".join(f'count(*) FILTER (abs(x - mu) > {r} * sd) / {N} AS "ratio_beyond_r_sigma__r_{r}"' for r in features_array.R_SIGMA)}
      FROM about {GROUP}""",
    f"{_CENTRE}, {_ABOUT}",
)

array_query(
    "feat_locations",
    ["first_location_of_maximum", "last_location_of_maximum", "first_location_of_minimum",
     "last_location_of_minimum", "index_mass_quantile"],
    f"""SELECT station, win_end, stream, min(pos) FILTER (x = hi) / {N} AS first_location_of_maximum,
      (max(pos) FILTER (x = hi) + 1) / {N} AS last_location_of_maximum,
      min(pos) FILTER (x = lo) / {N} AS first_location_of_minimum,
      (max(pos) FILTER (x = lo) + 1) / {N} AS last_location_of_minimum,
      {", ".join(f'(min(pos) FILTER (run >= {q} * mass) + 1) / {N} AS "index_mass_quantile__q_{q}"' for q in features_array.QUANTILES)}
      FROM (SELECT *, sum(abs(x)) OVER (PARTITION BY station, win_end, stream ORDER BY pos) AS run FROM about) {GROUP}""",
    f"{_CENTRE}, {_ABOUT}",
)

array_query(
    "feat_duplicates",
    ["has_duplicate", "has_duplicate_max", "has_duplicate_min",
     "percentage_of_reoccurring_datapoints_to_all_datapoints", "percentage_of_reoccurring_values_to_all_values",
     "sum_of_reoccurring_values", "sum_of_reoccurring_data_points", "ratio_value_number_to_time_series_length"],
    f"""SELECT station, win_end, stream, (CASE WHEN max(c) > 1 THEN 1 ELSE 0 END)::DOUBLE AS has_duplicate,
      (CASE WHEN arg_max(c, x) > 1 THEN 1 ELSE 0 END)::DOUBLE AS has_duplicate_max,
      (CASE WHEN arg_min(c, x) > 1 THEN 1 ELSE 0 END)::DOUBLE AS has_duplicate_min,
      count(*) FILTER (c > 1) / count(*) AS percentage_of_reoccurring_datapoints_to_all_datapoints,
      coalesce(sum(c) FILTER (c > 1), 0) / {N} AS percentage_of_reoccurring_values_to_all_values,
      coalesce(sum(x) FILTER (c > 1), 0) AS sum_of_reoccurring_values,
      coalesce(sum(x * c) FILTER (c > 1), 0) AS sum_of_reoccurring_data_points,
      count(*) / {N} AS ratio_value_number_to_time_series_length FROM seen {GROUP}""",
    "seen AS (SELECT station, win_end, stream, x, count(*) AS c FROM wx GROUP BY ALL)",
)

_STRIKE = """SELECT station, win_end, stream, max(c) FILTER (side = {side}) AS c FROM (
   SELECT station, win_end, stream, side, g, count(*) AS c FROM (
     SELECT *, pos - row_number() OVER (PARTITION BY station, win_end, stream, side ORDER BY pos) AS g
     FROM (SELECT *, sign(x - mu) AS side FROM about)) GROUP BY ALL) GROUP BY station, win_end, stream"""

array_query(
    "feat_strikes",
    ["longest_strike_above_mean", "longest_strike_below_mean"],
    f"""SELECT station, win_end, stream, a.c::DOUBLE AS longest_strike_above_mean, b.c::DOUBLE AS longest_strike_below_mean
      FROM ({_STRIKE.format(side=1)}) a JOIN ({_STRIKE.format(side=-1)}) b USING (station, win_end, stream)""",
    f"{_CENTRE}, {_ABOUT}",
)


def _peak_sql(s: int) -> str:
    return (
        f"count(*) FILTER (pos >= {s} AND pos < {N - s} AND x > b{s} AND x > a{s})::DOUBLE AS \"number_peaks__n_{s}\""
    )


array_query(
    "feat_peaks",
    ["number_peaks"],
    f"SELECT station, win_end, stream, {', '.join(map(_peak_sql, features_array.PEAK_SUPPORTS))} FROM sided {GROUP}",
    "sided AS (SELECT *, "
    + ", ".join(
        f"max(x) OVER (PARTITION BY station, win_end, stream ORDER BY pos ROWS BETWEEN {s} PRECEDING AND 1 PRECEDING) AS b{s}, "
        f"max(x) OVER (PARTITION BY station, win_end, stream ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {s} FOLLOWING) AS a{s}"
        for s in features_array.PEAK_SUPPORTS
    )
    + " FROM wx)",
)


def _corridor_sql(low: float, high: float) -> str:
    inside = f"x >= q[{round(low * 5) + 1}] AND x <= q[{round(high * 5) + 1}] AND l1 >= q[{round(low * 5) + 1}] AND l1 <= q[{round(high * 5) + 1}]"
    parts = []
    for absolute, d in ((False, "(x - l1)"), (True, "abs(x - l1)")):
        parts.append(f'coalesce(avg({d}) FILTER ({inside}), 0) AS "change_quantiles__f_agg_mean__isabs_{absolute}__qh_{high}__ql_{low}"')
        parts.append(f'coalesce(var_pop({d}) FILTER ({inside}), 0) AS "change_quantiles__f_agg_var__isabs_{absolute}__qh_{high}__ql_{low}"')
    return ", ".join(parts)


array_query(
    "feat_change_quantiles",
    ["change_quantiles"],
    f"SELECT station, win_end, stream, {', '.join(_corridor_sql(a, b) for a, b in features_array.CORRIDORS)} "
    f"FROM lagged JOIN levels USING (station, win_end, stream) {GROUP}",
    _LAGGED
    + f", levels AS (SELECT station, win_end, stream, quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM wx {GROUP})",
)


def _psi(width: int, coeff: int) -> str:
    points = min(10 * width, N)
    u = f"({coeff} + {(points - 1) // 2} - pos - {(points - 1) / 2})"
    inside = f"{coeff} + {(points - 1) // 2} - pos BETWEEN 0 AND {points - 1}"
    return (
        f"sum(x * (1 - {u}*{u}/{width**2}.0) * exp(-({u}*{u})/{2 * width**2}.0)) FILTER ({inside}) "
        f"* (2 / (sqrt(3 * {width}.0) * pow(pi(), 0.25)))"
    )


agg_query(
    "feat_cwt",
    ["cwt_coefficients"],
    "SELECT station, win_end, stream, "
    + ", ".join(
        f'{_psi(w, c)} AS "cwt_coefficients__coeff_{c}__w_{w}__widths_(2, 5, 10, 20)"'
        for w in features_agg.WAVELET_WIDTHS
        for c in range(15)
    )
    + f" FROM wx {GROUP}",
)

array_query(
    "feat_entropy_bins",
    ["binned_entropy"],
    f"SELECT station, win_end, stream, -sum(c / {N} * ln(c / {N})) AS binned_entropy__max_bins_10 FROM ("
    "SELECT station, win_end, stream, least(floor((x - lo) * 10 / (hi - lo)), 9) AS b, count(*) AS c FROM about GROUP BY ALL) "
    + GROUP,
    f"{_CENTRE}, {_ABOUT}",
)

_SHIFTED = "shifted AS (SELECT station, win_end, stream, x - mu AS z, sd, " + ", ".join(
    f"lag(x - mu, {i}) OVER (PARTITION BY station, win_end, stream ORDER BY pos) AS z{i}" for i in range(1, 41)
) + " FROM about)"

agg_query(
    "feat_autocorr_agg",
    ["agg_autocorrelation"],
    """SELECT station, win_end, stream, list_avg(r) AS "agg_autocorrelation__f_agg_mean__maxlag_40",
      list_median(r) AS "agg_autocorrelation__f_agg_median__maxlag_40",
      list_var_pop(r) AS "agg_autocorrelation__f_agg_var__maxlag_40" FROM rhos""",
    f"{_CENTRE}, {_ABOUT}, {_SHIFTED}, rhos AS (SELECT station, win_end, stream, ["
    + ", ".join(f"sum(z * z{i}) / ({N - i} * any_value(sd * sd))" for i in range(1, 41))
    + f"] AS r FROM shifted {GROUP})",
)
