"""All window features of a request: which calculators, by which of the three ways, as one long table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from foreshock.config import Geometry
from foreshock.functions.kernels import FEATURE_OF
from foreshock.operators import features_agg, features_array, features_arrow
from foreshock.operators.selection import pick_calculators
from foreshock.operators.store import melt
from foreshock.operators.windows import window_arrays

FIELDS = ("station", "win_end", "stream", "calculator", "params", "feature", "value")
ALL_CALCULATORS = (
    *features_agg.NAMES,
    *features_array.NAMES,
    *[c for c in features_arrow.NAMES if c not in FEATURE_OF],
)


def chunk_trend_rows(wide: DataFrame) -> DataFrame:
    parts = ", ".join(
        f"named_struct('params', concat('attr_{a}__chunk_len_', length, '__f_agg_{s}'), 'value', {a}_{s})"
        for s in features_agg.TREND_STATS
        for a in features_agg.TREND_ATTRS
    )
    rows = wide.selectExpr("station", "win_end", "stream", f"'{features_agg.CHUNK_TREND}' AS calculator", f"inline(array({parts}))")
    return rows.selectExpr(
        "station", "win_end", "stream", "calculator", "params",
        "concat_ws('__', stream, calculator, params) AS feature", "value",
    )


def extract_features(
    series: DataFrame,
    geom: Geometry,
    streams: Sequence[str],
    only: Iterable[str] = (),
    drop: Iterable[str] = (),
    ti: float | None = None,
    tf: float | None = None,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Long features of every window, or of the windows in ``runs``. Only the wanted calculators are computed: the sum-like ones in one
    aggregate, the ordered ones in projections over one table of window arrays, the rest in one Arrow pass."""
    wanted = pick_calculators(ALL_CALCULATORS, only, drop)
    parts = []
    sums = [c for c in wanted if c in features_agg.CALCULATORS]
    if sums:
        parts.append(melt(features_agg.window_sums(series, geom, streams, sums, ti, tf, runs)))
    if features_agg.CHUNK_TREND in wanted:
        parts.append(chunk_trend_rows(features_agg.chunk_trends(series, geom, streams, ti, tf, runs)))
    ordered = [c for c in wanted if c in features_array.CALCULATORS]
    kernels = [c for c in wanted if c in features_arrow.NAMES]
    kernels += [k for k, names in FEATURE_OF.items() if any(n in wanted for n in names)]
    corridors = features_array.CHANGE_QUANTILES in wanted
    if ordered or kernels or corridors:
        arrays = window_arrays(series, geom, streams, ti, tf, runs=runs)
        if ordered:
            parts.append(melt(features_array.window_array_features(arrays, geom, ordered)))
        if corridors:
            parts.append(melt(features_array.change_quantiles(arrays, geom)))
        if kernels:
            found = features_arrow.window_arrow_features(arrays, kernels)
            parts.append(found.filter(found["calculator"].isin(wanted)))
    if not parts:
        raise ValueError("no known calculator is asked for")
    out = parts[0].select(*FIELDS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*FIELDS))
    return out
