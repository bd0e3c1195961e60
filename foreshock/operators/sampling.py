"""Balanced samples, one per model, and random splits; seeded by digests, so the same on any cluster."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.operators.chunks import place
from foreshock.operators.ranking import mark_smallest
from foreshock.sources.tables import cut_lineage

RATIO = 0.75
FOLDS = 5
TEST_SHARE = 0.25


def class_sizes(labels: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Rows to keep of each class: all of the smaller one, ``int(smaller / ratio)`` of the larger."""
    counts = labels.agg(
        F.count_if(F.col("label") <= 0).alias("c0"), F.count_if(F.col("label") > 0).alias("c1")
    )
    target = f"CAST(least(c0, c1) / {ratio!r}D AS BIGINT)"
    return counts.selectExpr(
        f"inline(array(named_struct('label', 0D, 'size', c0, 'keep', least(c0, {target})),"
        f" named_struct('label', 1D, 'size', c1, 'keep', least(c1, {target}))))"
    )


def undersample(labels: DataFrame, n_models: int, seed: int = 0, ratio: float = RATIO) -> DataFrame:
    """One sample without replacement per model: ``model_id`` and the label rows (``station, win_end, label``)."""
    labels = cut_lineage(labels.select("station", "win_end", "label"))  # a small file, whose rows become one per model
    sizes = class_sizes(labels, ratio)
    models = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_models - 1).cast("bigint")))
    digest = F.md5(F.concat_ws(":", F.col("model_id") + seed, "station", "win_end"))
    placed = place(labels, "station", "win_end")
    spread = placed.select("station", "win_end", "label", models.alias("model_id")).withColumn("digest", digest)
    keep = sizes.select("label", "keep", models.alias("model_id"))
    marked = mark_smallest(spread, ["model_id", "label"], "digest", keep)
    return marked.filter("chosen").select("model_id", "station", "win_end", "label")


def class_weights(samples: DataFrame) -> DataFrame:
    """Balanced weights per model and class: rows / (2 * rows of the class)."""
    counts = samples.groupBy("model_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") <= 0).alias("c0"),
        F.count_if(F.col("label") > 0).alias("c1"),
    )
    return counts.selectExpr(
        "model_id",
        "inline(array(named_struct('label', 0D, 'n_class', c0, 'weight', try_divide(n, 2 * c0)),"
        " named_struct('label', 1D, 'n_class', c1, 'weight', try_divide(n, 2 * c1))))",
    )


def shuffle_split(samples: DataFrame, folds: int = FOLDS, share: float = TEST_SHARE, seed: int = 0) -> DataFrame:
    """Random splits of each model's sample: adds ``fold`` and ``test``."""
    samples = place(cut_lineage(samples), "station", "win_end")  # all models in one or two files, whose rows become one per fold
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    digest = F.md5(F.concat_ws(":", F.col("model_id") + seed, "fold", "station", "win_end"))
    spread = samples.select("*", fold).withColumn("digest", digest)
    keep = spread.groupBy("model_id", "fold").agg(F.ceil(F.count("*") * share).alias("keep"))
    marked = mark_smallest(spread, ["model_id", "fold"], "digest", keep)
    return marked.withColumnRenamed("chosen", "test").drop("digest")
