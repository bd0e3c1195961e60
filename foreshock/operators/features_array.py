"""Window features over the ordered samples of a window.

Input rows come from ``window_arrays``: one row per (window, stream) with its samples ``x``. Most calculators
are array expressions in one projection and shuffle nothing; they are SQL over the prepared columns

    xs  samples sorted        mu, sd, vp  mean, deviation, variance      z  samples minus mean
    lo, hi  extremes          med  median                                mass  sum of sizes

prepared in stages so that none is computed twice. ``change_quantiles`` has many conditional sums per window
and is an explode with a compiled aggregate instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.config import Geometry
from foreshock.operators.features_agg import KEYS, column_name

# Parameters of the calculators.
QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)
R_SYMMETRY = [round(0.05 * i, 2) for i in range(20)]
R_SIGMA = (0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10)
PEAK_SUPPORTS = (1, 3, 5, 10, 50)
ENTROPY_BINS = 10
CORRIDOR_LEVELS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
CORRIDORS = [(a, b) for a in CORRIDOR_LEVELS for b in CORRIDOR_LEVELS if a < b]


def total(array: str) -> str:
    return f"aggregate({array}, 0D, (a, v) -> a + v)"


def sorted_quantile(n: int, q: float, array: str = "xs") -> str:
    """Linear interpolation between order statistics at literal places."""
    at = (n - 1) * q
    low = min(math.floor(at + 1e-9), n - 1)
    share = at - low
    if share < 1e-9 or low + 1 >= n:
        return f"{array}[{low}]"
    return f"({array}[{low}] + ({array}[{low + 1}] - {array}[{low}]) * {share!r}D)"


def _prepared(n: int) -> list[dict[str, str]]:
    return [
        {"xs": "sort_array(x)", "mu": f"{total('x')} / {n}", "mass": total("transform(x, v -> abs(v))")},
        {
            # The mean is bound as a lambda argument: were it inlined here, each sample would compute it anew.
            "z": "transform(array(mu), m -> transform(x, v -> v - m))[0]",
            "lo": "xs[0]",
            "hi": f"xs[{n - 1}]",
            "med": sorted_quantile(n, 0.5),
        },
        {"vp": f"aggregate(z, 0D, (a, v) -> a + v * v) / {n}"},
        {"sd": "sqrt(vp)"},
    ]


def _run(test: str) -> str:
    """Longest run of centred samples that pass a test."""
    step = f"CASE WHEN {test} THEN a.run + 1 ELSE 0 END"
    return (
        "CAST(aggregate(z, named_struct('run', 0, 'best', 0), (a, v) -> named_struct("
        f"'run', {step}, 'best', greatest(a.best, {step})), a -> a.best) AS DOUBLE)"
    )


# Sorted samples that open a run of equal ones, and all samples of such runs.
_OPENERS = "filter(xs, (v, i) -> v = get(xs, i + 1) AND (i = 0 OR v <> get(xs, i - 1)))"
_REPEATED = "filter(xs, (v, i) -> (i > 0 AND v = get(xs, i - 1)) OR coalesce(v = get(xs, i + 1), false))"


def _peaks(n: int) -> dict[str, str]:
    """Places larger than all neighbours up to the support. Supports rise, and each one is tried only on the
    places that passed the one before."""
    found, out = f"sequence(1, {n - 2})", {}
    for s in PEAK_SUPPORTS:
        found = (
            f"filter({found}, i -> i >= {s} AND i < {n - s} AND x[i] > array_max(slice(x, i - {s - 1}, {s})) "
            f"AND x[i] > array_max(slice(x, i + 2, {s})))"
        )
        out[f"n_{s}"] = found
    return out


def _mass_index(n: int) -> dict[str, str]:
    """Share of the window passed when the running mass first reaches each share of the total."""
    fields = ", ".join(
        f"'q{i}', a.q{i} + CASE WHEN a.run + abs(v) < {q}D * mass THEN 1 ELSE 0 END" for i, q in enumerate(QUANTILES)
    )
    zero = ", ".join(f"'q{i}', 0" for i in range(len(QUANTILES)))
    walk = (
        f"aggregate(x, named_struct('run', 0D, {zero}), (a, v) -> named_struct('run', a.run + abs(v), {fields}))"
    )
    return {"mass_at": walk}


_LEVEL = f"CAST(least(floor(coalesce(try_divide((v - lo) * {ENTROPY_BINS}, hi - lo), 0)), {ENTROPY_BINS - 1}) AS INT)"

# name -> (extra prepared columns, outputs by params), both of a window of n samples.
Entry = tuple[Callable[[int], dict[str, str]], Callable[[int], dict[str, str]]]


def _plain(expr: str) -> Entry:
    return (lambda n: {}), (lambda n: {"": expr.format(n=n, n2=n - 2)})


CALCULATORS: dict[str, Entry] = {
    "median": _plain("med"),
    "quantile": ((lambda n: {}), lambda n: {f"q_{q}": sorted_quantile(n, q) for q in QUANTILES}),
    "symmetry_looking": (
        (lambda n: {}),
        lambda n: {f"r_{r}": f"CAST(abs(mu - med) < {r}D * (hi - lo) AS DOUBLE)" for r in R_SYMMETRY},
    ),
    "has_duplicate": _plain("CAST(size(array_distinct(xs)) < {n} AS DOUBLE)"),
    "has_duplicate_max": _plain("CAST(xs[{n2}] = hi AS DOUBLE)"),
    "has_duplicate_min": _plain("CAST(xs[1] = lo AS DOUBLE)"),
    "count_above_mean": _plain("CAST(size(filter(z, v -> v > 0)) AS DOUBLE)"),
    "count_below_mean": _plain("CAST(size(filter(z, v -> v < 0)) AS DOUBLE)"),
    "first_location_of_maximum": _plain("(array_position(x, hi) - 1) / {n}"),
    "last_location_of_maximum": _plain("({n} + 1 - array_position(reverse(x), hi)) / {n}"),
    "first_location_of_minimum": _plain("(array_position(x, lo) - 1) / {n}"),
    "last_location_of_minimum": _plain("({n} + 1 - array_position(reverse(x), lo)) / {n}"),
    "longest_strike_above_mean": _plain(_run("v > 0")),
    "longest_strike_below_mean": _plain(_run("v < 0")),
    "percentage_of_reoccurring_datapoints_to_all_datapoints": _plain(
        f"size({_OPENERS}) / size(array_distinct(xs))"
    ),
    "percentage_of_reoccurring_values_to_all_values": _plain(f"size({_REPEATED}) / {{n}}"),
    "sum_of_reoccurring_values": _plain(total(_OPENERS)),
    "sum_of_reoccurring_data_points": _plain(total(_REPEATED)),
    "ratio_value_number_to_time_series_length": _plain("size(array_distinct(xs)) / {n}"),
    "ratio_beyond_r_sigma": (
        (lambda n: {}),
        lambda n: {f"r_{r}": f"size(filter(z, v -> abs(v) > {r}D * sd)) / {n}" for r in R_SIGMA},
    ),
    "binned_entropy": (
        lambda n: {"level": f"transform(x, v -> {_LEVEL})"},
        lambda n: {
            f"max_bins_{ENTROPY_BINS}": "-aggregate(array("
            + ", ".join(f"size(filter(level, v -> v = {b})) / {n}" for b in range(ENTROPY_BINS))
            + "), 0D, (a, p) -> a + CASE WHEN p > 0 THEN p * ln(p) ELSE 0D END)"
        },
    ),
    "index_mass_quantile": (
        _mass_index,
        lambda n: {f"q_{q}": f"(mass_at.q{i} + 1) / {n}" for i, q in enumerate(QUANTILES)},
    ),
    "number_peaks": (
        (lambda n: {}),
        lambda n: {p: f"CAST(size({found}) AS DOUBLE)" for p, found in _peaks(n).items()},
    ),
}

CHANGE_QUANTILES = "change_quantiles"
NAMES = (*CALCULATORS, CHANGE_QUANTILES)


def window_array_features(arrays: DataFrame, geom: Geometry, calculators: Iterable[str]) -> DataFrame:
    """Wide features per (window, stream) from ``window_arrays`` rows."""
    n, extra, outs = geom.iw, {}, []
    for name in calculators:
        if name not in CALCULATORS:
            raise ValueError(f"unknown calculator {name!r}")
        prepare, columns = CALCULATORS[name]
        extra |= prepare(n)
        outs += [f"{expr} AS `{column_name(name, p)}`" for p, expr in columns(n).items()]
    staged = arrays
    for stage in [*_prepared(n), extra]:
        if stage:
            staged = staged.selectExpr("*", *[f"{expr} AS {c}" for c, expr in stage.items()])
    return staged.selectExpr(*KEYS, *outs)


def change_quantiles(arrays: DataFrame, geom: Geometry) -> DataFrame:
    """Mean and variance of the changes, and of their sizes, whose both ends lie in a quantile corridor.

    Changes are exploded beside the six levels of their window and summed by a compiled aggregate. Its partial
    step sees whole windows, so one row per window goes to the shuffle.
    """
    n = geom.iw
    levels = [f"{sorted_quantile(n, q)} AS l{i}" for i, q in enumerate(CORRIDOR_LEVELS)]
    names = [f"l{i}" for i in range(len(levels))]
    changes = (
        arrays.selectExpr(*KEYS, "x", "sort_array(x) AS xs")
        .selectExpr(*KEYS, *levels, f"inline(arrays_zip(slice(x, 1, {n - 1}), slice(x, 2, {n - 1}))) AS (u, v)")
        .selectExpr(*KEYS, *names, "least(u, v) AS low", "greatest(u, v) AS high", "v - u AS d")
    )
    at = {q: f"l{i}" for i, q in enumerate(CORRIDOR_LEVELS)}
    aggs, outs = [], []
    for i, (a, b) in enumerate(CORRIDORS):
        inside = f"low >= {at[a]} AND high <= {at[b]}"
        for part, value in (("c", "1D"), ("s", "d"), ("q", "d * d"), ("a", "abs(d)")):
            aggs.append(f"sum(CASE WHEN {inside} THEN {value} ELSE 0D END) AS {part}{i}")
        for size, top in ((False, "s"), (True, "a")):
            mean = f"try_divide({top}{i}, c{i})"
            spread = f"greatest(try_divide(q{i}, c{i}) - {mean} * {mean}, 0D)"
            for f, value in (("mean", mean), ("var", spread)):
                params = f"f_agg_{f}__isabs_{size}__qh_{b}__ql_{a}"
                outs.append(f"coalesce({value}, 0D) AS `{column_name(CHANGE_QUANTILES, params)}`")
    return changes.groupBy(*KEYS).agg(*map(F.expr, aggs)).selectExpr(*KEYS, *outs)
