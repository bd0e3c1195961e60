"""Votes to consensus, resumed predictions, checks of a stored model set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consensus(votes: DataFrame, n_models: int) -> DataFrame:
    """Share of models voting 1 per window; null where any model's vote is missing."""
    means = votes.groupBy("station", "win_end").agg(F.avg("pred").alias("mean"), F.count("pred").alias("n"))
    return means.select("station", "win_end", F.when(F.col("n") >= n_models, F.col("mean")).alias("consensus"))


def predict_missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs of model and window without a stored vote."""
    keys = ["model_id", "station", "win_end"]
    return wanted.select(*keys).join(stored.select(*keys), keys, "left_anti")


def model_set_check(selected: DataFrame, members: DataFrame) -> DataFrame:
    """State of a stored set: highest number, how many feature lists and models, whether it is gapless from 0
    and whether each list has its model."""
    lists = selected.select("model_id").distinct()
    have = members.select("model_id", F.lit(True).alias("fitted")).distinct()
    return lists.join(have, "model_id", "left").agg(
        F.max("model_id").alias("last"),
        F.count("*").alias("n"),
        F.count_if(F.col("fitted").isNull()).alias("unfitted"),
    ).select(
        "last", "n", "unfitted", (F.col("last") == F.col("n") - 1).alias("gapless"), (F.col("unfitted") == 0).alias("complete")
    )


def require_model_set(state: DataFrame) -> int:
    """Number of models of a sound set; an error otherwise. Reads one row."""
    row = state.first()
    if not row["n"]:
        raise ValueError("no feature lists in the model set")
    if not row["gapless"]:
        raise ValueError("the numbers of the models have gaps")
    if not row["complete"]:
        raise ValueError("some models of the set are missing")
    return row["n"]


