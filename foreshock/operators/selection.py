"""Feature relevance and choice. Features are long: ``station, win_end, feature, value``."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreshock.functions.names import calculator_of, glob_match
from foreshock.operators.packed import Packed, rank_parts, rank_sums
from foreshock.operators.ranking import packed_ranks, value_splits

FDR_LEVEL = 0.05
NAMED_HOOKS = ("fft_coefficient_hann",)


# ---- which columns ---------------------------------------------------------------------------------------


def drop_features(features: DataFrame, names: Iterable[str], calculators: Iterable[str]) -> DataFrame:
    """Drop features given by exact name, by calculator, or by shell pattern."""
    known = {*calculators, *NAMED_HOOKS}
    out, feature = features, F.col("feature")
    for name in names:
        same = feature == name
        hit = calculator_of(feature) == name if name in known else glob_match(feature, name)
        out = out.filter(~(same | hit))
    return out


def keep_features(features: DataFrame, names: Iterable[str]) -> DataFrame:
    """Keep the named features; names that do not occur are ignored."""
    return features.filter(F.col("feature").isin(list(names)))


def pick_calculators(available: Iterable[str], only: Iterable[str] = (), drop: Iterable[str] = ()) -> list[str]:
    """Calculators to compute: the named ones, or all without the dropped ones."""
    only, drop = set(only), set(drop)
    return [c for c in available if (c in only if only else c not in drop)]


# ---- significance ----------------------------------------------------------------------------------------


def sample_values(samples: DataFrame, features: DataFrame) -> DataFrame:
    """Feature values of the sampled windows, each once for all models: ``station, win_end, label, models, feature, value``.

    Files of samples hold a few bits a row, so their size says nothing of the memory that a broadcast takes.
    """
    drawn = samples.groupBy("station", "win_end", "label").agg(F.collect_list("model_id").alias("models"))
    return features.select("station", "win_end", "feature", "value").join(drawn.hint("merge"), ["station", "win_end"])


def ranked_values(samples: DataFrame | Packed, features: DataFrame) -> DataFrame:
    """Ranks of each model's values. Those of packed samples are summed up where they are found."""
    if isinstance(samples, Packed):
        return rank_sums(samples, rank_parts(samples))
    rows = sample_values(samples, features).filter(F.col("value").isNotNull())
    return packed_ranks(rows.select("feature", "value", "label", "models"), value_splits(features))


def mann_whitney(ranked: DataFrame) -> DataFrame:
    """Rank-sum statistic per (model, feature) with correction for ties and continuity.

    Output adds ``n_values`` and the class counts at the smaller of two values, for two-valued features. Ranks that are summed up
    already (``rank_sum``) are taken as they are.
    """
    t = "(n0 + n1)"
    sums = ranked if "rank_sum" in ranked.columns else ranked.groupBy("model_id", "feature").agg(
        F.expr("sum(n0) AS c0"),
        F.expr("sum(n1) AS c1"),
        F.expr("count(*) AS n_values"),
        F.expr(f"sum(n1 * (below0 + below1 + ({t} + 1) / 2)) AS rank_sum"),
        F.expr(f"sum(CAST({t} AS DOUBLE) * {t} * {t} - {t}) AS ties"),
        F.expr("min_by(n0, value) AS a0"),
        F.expr("min_by(n1, value) AS a1"),
    )
    u = sums.selectExpr("*", "rank_sum - c1 * (c1 + 1) / 2 AS u", "CAST(c0 + c1 AS DOUBLE) AS n")
    spread = "sqrt(c0 * c1 / 12D * (n + 1 - ties / (n * (n - 1))))"
    return u.selectExpr(
        "model_id", "feature", "c0", "c1", "n_values", "a0", "a1", "u",
        f"CASE WHEN n_values > 1 AND c0 > 0 AND c1 > 0 THEN (greatest(u, c0 * c1 - u) - c0 * c1 / 2D - 0.5D) / {spread} END AS z",
    )


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Exact two-sided p-value of a 2 x 2 table: all tables no likelier than this one."""
    low, high = max(0, a - d), min(a + b, a + c)
    k = np.arange(low, high + 1)
    lg = np.vectorize(math.lgamma)
    logs = -(lg(k + 1) + lg(a + b - k + 1) + lg(a + c - k + 1) + lg(d - a + k + 1))
    weights = np.exp(logs - logs.max())
    own = weights[a - low]
    return float(min(1.0, weights[weights <= own * (1 + 1e-7)].sum() / weights.sum()))


def _p_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        p = [
            fisher_two_sided(a1, a0, c1 - a1, c0 - a0) if values == 2 else math.erfc(abs(z) / math.sqrt(2))
            for a0, a1, c0, c1, values, z in zip(pdf.a0, pdf.a1, pdf.c0, pdf.c1, pdf.n_values, pdf.z)
        ]
        yield pdf[["model_id", "feature"]].assign(p_value=np.asarray(p, dtype=float))


def p_values(stats: DataFrame) -> DataFrame:
    """P-value per (model, feature): rank-sum for real features, Fisher's exact test for two-valued ones.

    Constant features have none and are left out. One row per feature and model reaches Python.
    """
    tested = stats.filter(F.col("z").isNotNull())
    return tested.mapInPandas(_p_values, "model_id BIGINT, feature STRING, p_value DOUBLE")


def fdr_flag(p: DataFrame, level: float = FDR_LEVEL) -> DataFrame:
    """False-discovery flag for dependent tests. A model's group is its feature list, a few thousand rows."""
    model = Window.partitionBy("model_id")
    ranked = p.withColumns(
        {"rank": F.row_number().over(model.orderBy("p_value", "feature")), "m": F.count("*").over(model)}
    )
    harmonic = F.expr("aggregate(sequence(1, CAST(m AS INT)), 0D, (a, i) -> a + 1D / i)")
    passing = F.when(F.col("p_value") <= level * F.col("rank") / (F.col("m") * harmonic), F.col("rank"))
    last = F.max(passing).over(model)
    return ranked.withColumn("relevant", F.coalesce(F.col("rank") <= last, F.lit(False))).drop("m")


def select_topk(p: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` features of smallest p-value per model, whether or not they pass the discovery test."""
    order = Window.partitionBy("model_id").orderBy("p_value", "feature")
    return p.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def feature_frequency(selected: DataFrame) -> DataFrame:
    """How many models use each feature, most used first, later names first among equals."""
    counts = selected.filter(F.col("feature") != "").groupBy("feature").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.desc("feature"))


def distinct_calculators(selected: DataFrame) -> DataFrame:
    return selected.select(calculator_of(F.col("feature")).alias("calculator")).distinct()
