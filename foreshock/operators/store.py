"""Feature store: long rows ``station, win_end, stream, calculator, params, feature, value``.

New windows and new calculators are appended rows, never new columns. Files are partitioned by month and
calculator, so a request reads only what it names.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.functions.numbers import is_finite
from foreshock.functions.times import to_seconds
from foreshock.operators.ranking import exact_quantiles

FIELDS = "station BIGINT, win_end BIGINT, stream STRING, params STRING, feature STRING, value DOUBLE"
KEY = ["station", "win_end", "feature"]
NOT_FEATURES = {"station", "k", "e", "win_end", "stream"}


def melt(wide: DataFrame) -> DataFrame:
    """Long rows from one column per feature."""
    parts = []
    for name in wide.columns:
        if name in NOT_FEATURES:
            continue
        calculator, _, params = name.partition("__")
        parts.append(f"named_struct('calculator', '{calculator}', 'params', '{params}', 'value', `{name}`)")
    rows = wide.selectExpr("station", "win_end", "stream", f"inline(array({', '.join(parts)}))")
    return rows.selectExpr(
        "station", "win_end", "stream", "calculator", "params",
        "concat_ws('__', stream, calculator, nullif(params, '')) AS feature", "value",
    )


def write_features(features: DataFrame, path: str) -> None:
    month = F.date_format(F.timestamp_seconds("win_end"), "yyyy-MM")
    paged = features.withColumn("month", month)
    paged = paged.repartition("month", "calculator", F.pmod(F.hash("station"), F.lit(16)))  # few files a folder, hot stations apart
    paged.write.mode("append").partitionBy("month", "calculator").parquet(path)


def read_features(
    spark: SparkSession, path: str, ti=None, tf=None, calculators: Iterable[str] | None = None
) -> DataFrame:
    """Stored features of a time range and some calculators; both prune partitions."""
    stored = spark.read.schema(FIELDS + ", month STRING, calculator STRING").parquet(path)
    return trim_store(stored, ti, tf, calculators).drop("month")


def trim_store(stored: DataFrame, ti=None, tf=None, calculators: Iterable[str] | None = None) -> DataFrame:
    out, paged = stored, "month" in stored.columns
    if ti is not None:
        out = out.filter(F.col("win_end") >= to_seconds(ti))
        out = out.filter(F.col("month") >= _month(ti)) if paged else out
    if tf is not None:
        out = out.filter(F.col("win_end") < to_seconds(tf))
        out = out.filter(F.col("month") <= _month(tf)) if paged else out
    return out if calculators is None else out.filter(F.col("calculator").isin(list(calculators)))


def _month(moment) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp(to_seconds(moment), timezone.utc).strftime("%Y-%m")


def missing_windows(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted windows the store does not hold yet, earlier or later."""
    return wanted.join(stored.select("station", "win_end").distinct(), ["station", "win_end"], "left_anti")


def missing_calculators(wanted: Sequence[str], stored: DataFrame) -> DataFrame:
    """Pairs of stored window and wanted calculator that are still to be computed."""
    held = stored.select("station", "win_end", "calculator").distinct()
    names = F.explode(F.array(*[F.lit(c) for c in wanted])).alias("calculator")
    pairs = stored.select("station", "win_end").distinct().select("station", "win_end", names)
    return pairs.join(held, ["station", "win_end", "calculator"], "left_anti")


def union_features(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows and the new ones the store lacks."""
    fresh = new.join(stored.select(*KEY), KEY, "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


STATISTICS = "feature STRING, _lo DOUBLE, _hi DOUBLE, _med DOUBLE"


def impute_statistics(reference: DataFrame) -> DataFrame:
    """Extremes and median of each feature's finite values, one row per feature; none for a feature without any."""
    base = reference.filter(is_finite(F.col("value")))
    extremes = base.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return extremes.join(exact_quantiles(base, ["feature"], "value", {"_med": 0.5}), "feature")


def impute(features: DataFrame, reference: DataFrame | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """Finite values everywhere: NaN and null become the feature's median, infinities its extremes, all over
    the finite values of the reference rows (or as in stored ``statistics``); 0 where a feature has none."""
    stats = statistics if statistics is not None else impute_statistics(features if reference is None else reference)
    v = F.col("value")
    filled = (
        F.when(v.isNull() | F.isnan(v), F.col("_med"))
        .when(v == float("inf"), F.col("_hi"))
        .when(v == float("-inf"), F.col("_lo"))
        .otherwise(v)
    )
    return (
        features.join(stats, "feature", "left")
        .withColumn("value", F.coalesce(filled, F.lit(0.0)))
        .select(*features.columns)
    )


def widen(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per window with the named features as columns, for model input."""
    picked = features.filter(F.col("feature").isin(list(names)))
    return picked.groupBy("station", "win_end").agg(
        *[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names]
    )
