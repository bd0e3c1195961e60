"""Tables behind the exploration figures: yearly panels, feature distributions, feature pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.functions.numbers import floor_div, log10_finite
from foreshock.functions.times import index_time
from foreshock.operators.labels import event_neighbourhood
from foreshock.operators.ranking import exact_quantiles


def year_panel(df: DataFrame, events: DataFrame, streams: Sequence[str]) -> DataFrame:
    """Series rows with their calendar year and the number of events within the step."""
    marks = events.groupBy("station", floor_div(F.col("te_us"), 600_000_000).alias("idx")).agg(
        F.count("te_us").alias("marks")
    )
    dated = df.select("station", "idx", F.year(index_time(F.col("idx"))).alias("year"), *streams)
    return dated.join(marks, ["station", "idx"], "left").withColumn("marks", F.coalesce("marks", F.lit(0)))


def trim_low(values: DataFrame, sds: float = 3.0) -> DataFrame:
    """Finite logarithms of feature values above mean - 3 sd of their feature: ``feature, x``."""
    logs = values.select("feature", log10_finite(F.col("value")).alias("x")).filter("x IS NOT NULL")
    limits = logs.groupBy("feature").agg((F.avg("x") - sds * F.stddev_pop("x")).alias("limit"))
    return logs.join(limits, "feature").filter("x > limit").select("feature", "x")


def feature_hist(features: DataFrame, labelled: DataFrame) -> DataFrame:
    """Histogram of the logarithm of each feature over windows without event: ``feature, bin, left, width, n``.

    ``int(sqrt(windows / 2))`` equal bins; the largest value counts in the last one. Features are named ones, so
    every table but the first is a few rows a feature.
    """
    calm = labelled.filter("label < 1").select("station", "win_end")
    quiet = features.join(calm, ["station", "win_end"])
    logs = trim_low(quiet)
    bins = quiet.groupBy("feature").agg(F.expr("CAST(sqrt(count(*) / 2) AS INT) AS bins"))
    ranges = logs.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    sized = ranges.join(bins, "feature").filter("bins > 0")
    place = "CASE WHEN hi > lo THEN least(CAST(floor((x - lo) / (hi - lo) * bins) AS INT), bins - 1) ELSE 0 END AS bin"
    counted = logs.join(sized, "feature").groupBy("feature", "lo", "hi", "bins", F.expr(place)).agg(F.count("*").alias("n"))
    return counted.selectExpr("feature", "bin", "lo + bin * (hi - lo) / bins AS left", "(hi - lo) / bins AS width", "n")


def event_values(features: DataFrame, labelled: DataFrame, events: DataFrame, days: float = 5.0) -> DataFrame:
    """Logarithms of feature values of the positive windows near each event: ``station, te_us, win_end, feature, x``."""
    near = event_neighbourhood(labelled.select("station", "win_end", "label"), events, days)
    logs = features.select("station", "win_end", "feature", log10_finite(F.col("value")).alias("x"))
    return near.select("station", "te_us", "win_end").join(logs.filter("x IS NOT NULL"), ["station", "win_end"])


def quantile_trim(features: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Finite logarithms strictly inside their feature's quantiles: ``station, win_end, feature, x``."""
    logs = features.select("station", "win_end", "feature", log10_finite(F.col("value")).alias("x")).filter("x IS NOT NULL")
    limits = exact_quantiles(logs, ["feature"], "x", {"q_low": low, "q_high": high})
    return logs.join(limits, "feature").filter("x > q_low AND x < q_high").drop("q_low", "q_high")


def wide_logs(trimmed: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per window with all named features present."""
    wide = trimmed.groupBy("station", "win_end").agg(
        *[F.max(F.when(F.col("feature") == n, F.col("x"))).alias(n) for n in names]
    )
    return wide.dropna(subset=list(names))


def feature_corr(trimmed: DataFrame, names: Sequence[str]) -> DataFrame:
    """Correlation of each pair of features over windows that have them all: ``feature_a, feature_b, corr``.

    Pairs are columns of one aggregate over the wide rows: no self-join.
    """
    wide = wide_logs(trimmed, names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    corr = "try_divide(covar_pop(`{a}`, `{b}`), stddev_pop(`{a}`) * stddev_pop(`{b}`)) AS c{n}"
    sums = wide.agg(*[F.expr(corr.format(a=a, b=b, n=n)) for n, (a, b) in enumerate(pairs)])
    rows = ", ".join(f"named_struct('feature_a', '{a}', 'feature_b', '{b}', 'corr', c{n})" for n, (a, b) in enumerate(pairs))
    return sums.selectExpr(f"inline(array({rows}))")


def pair_counts(trimmed: DataFrame, names: Sequence[str], bins: int = 20) -> DataFrame:
    """Two-way histogram of each pair of features: ``feature_a, feature_b, bin_a, bin_b, n``."""
    wide = wide_logs(trimmed, names)
    edges = wide.agg(*[f(n).alias(f"{p}{i}") for i, n in enumerate(names) for p, f in (("lo", F.min), ("hi", F.max))])
    listed = ", ".join(f"named_struct('feature', '{n}', 'lo', lo{i}, 'hi', hi{i})" for i, n in enumerate(names))
    limits = edges.selectExpr(f"inline(array({listed}))")
    pairs = ", ".join(
        f"named_struct('feature_a', '{a}', 'feature_b', '{b}', 'a', `{a}`, 'b', `{b}`)"
        for i, a in enumerate(names)
        for b in names[:i]
    )
    place = "CASE WHEN hi_{s} > lo_{s} THEN least(CAST(floor(({s} - lo_{s}) / (hi_{s} - lo_{s}) * {n}) AS INT), {m}) ELSE 0 END AS bin_{s}"
    out = wide.selectExpr(f"inline(array({pairs}))")
    for side in ("a", "b"):
        out = out.join(limits.selectExpr(f"feature AS feature_{side}", f"lo AS lo_{side}", f"hi AS hi_{side}"), f"feature_{side}")
    bins_of = [place.format(s=side, n=bins, m=bins - 1) for side in ("a", "b")]
    return out.selectExpr("feature_a", "feature_b", *bins_of).groupBy("feature_a", "feature_b", "bin_a", "bin_b").agg(
        F.count("*").alias("n")
    )
