"""Classifiers of the model set: relational ones for all models at once, Spark ML for the rest.

Training rows are long: ``model_id, station, win_end, label, feature, value``, limited to each model's features.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
from pyspark.errors import ArithmeticException, IllegalArgumentException
from pyspark.ml import Transformer
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreshock.operators import neighbours
from foreshock.operators.chunks import place
from foreshock.operators.packed import Packed, Vectors, choose, model_vectors
from foreshock.sources.tables import cut_lineage

SMOOTHING = 1e-9
BLOCK = 2048
KEYS = ["model_id", "station", "win_end"]

# Search grids by classifier code.
GRIDS = {
    "SVM": {"C": [0.001, 0.01, 0.1, 1, 10]},
    "KNN": {"n_neighbors": [3, 6, 12, 24], "weights": ["uniform", "distance"], "p": [1, 2, 3]},
    "DT": {"max_depth": [3, 5, 7], "criterion": ["gini", "entropy"], "max_features": ["auto", "sqrt", "log2", None]},
    "RF": {
        "n_estimators": [10, 30, 100],
        "max_depth": [3, 5, 7],
        "criterion": ["gini", "entropy"],
        "max_features": ["auto", "sqrt", "log2", None],
    },
    "NN": {"hidden_layer_sizes": [10, 100]},
    "NB": {"var_smoothing": [SMOOTHING]},
    "LR": {"C": [0.001, 0.01, 0.1, 1, 10]},
}
MOST = max(GRIDS["KNN"]["n_neighbors"])
# Tried in this order when a stored model set does not say what it is.


def grid_points(code: str) -> list[dict]:
    if code not in GRIDS:
        raise ValueError(f"unknown classifier code {code!r}")
    grid = GRIDS[code]
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def training_rows(samples: DataFrame | Packed, features: DataFrame, selected: DataFrame) -> DataFrame | Packed:
    """Long rows of each model's sample and features. The feature lists are small, models times features; samples are not, though
    their files are. Packed samples hold the values already and are told which of them a model has."""
    if isinstance(samples, Packed):
        return choose(samples, selected)
    chosen = F.broadcast(selected.select("model_id", "feature"))
    values = features.select("station", "win_end", "feature", "value").hint("merge")
    return samples.join(values, ["station", "win_end"]).join(chosen, ["model_id", "feature"], "left_semi")


def input_rows(features: DataFrame | Vectors, selected: DataFrame | Packed) -> DataFrame:
    """Features each model needs: ``model_id, station, win_end, vec``, values in the order of their names. Values of a window meet once,
    for all models; the lists of features, models times features, are broadcast. Vectors hold the windows' values, packed samples
    the lists."""
    if isinstance(features, Vectors):
        return model_vectors(features.windows, selected, sampled=False)
    names = selected.select("feature").distinct().agg(F.array_sort(F.collect_list("feature")).alias("every"))
    wanted = selected.groupBy("model_id").agg(F.array_sort(F.collect_set("feature")).alias("names"))
    wanted = wanted.crossJoin(names).selectExpr("model_id", "names", "transform(names, x -> array_position(every, x) - 1) AS places")
    held = F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("held")
    windows = place(features.select("station", "win_end", "feature", "value"), "station", "win_end").groupBy("station", "win_end").agg(held)
    windows = windows.crossJoin(F.broadcast(names)).selectExpr("station", "win_end", "filter(held, x -> array_contains(every, x.feature)) AS held", "every")
    windows = windows.selectExpr("station", "win_end", "held", "held.value AS vals", "held.feature = every AS whole")
    # a window with each feature once is read by places, any other by names
    vec = "IF(whole, transform(places, i -> vals[i]), transform(filter(held, x -> array_contains(names, x.feature)), x -> x.value)) AS vec"
    return windows.crossJoin(F.broadcast(wanted)).selectExpr(*KEYS, vec).filter("size(vec) > 0")


# ---- scores ----------------------------------------------------------------------------------------------


def balanced_accuracy(votes: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Mean of the two class recalls per key; rows carry ``label`` and ``pred``."""
    right = F.when(F.col("label") == F.col("pred"), 1.0).otherwise(0.0)
    return votes.groupBy(*keys).agg(
        (
            (
                F.coalesce(F.avg(F.when(F.col("label") > 0, right)), F.avg(F.when(F.col("label") <= 0, right)))
                + F.coalesce(F.avg(F.when(F.col("label") <= 0, right)), F.avg(F.when(F.col("label") > 0, right)))
            )
            / 2
        ).alias("score")
    )


# ---- Gaussian naive Bayes --------------------------------------------------------------------------------


def fit_bayes(rows: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """Per (model, feature): mean and smoothed variance of both classes and the log of their prior odds."""
    one, none = "CASE WHEN label > 0 THEN value END", "CASE WHEN label <= 0 THEN value END"
    moments = rows.groupBy("model_id", "feature").agg(
        *map(
            F.expr,
            [
                f"avg({one}) AS m1", f"var_pop({one}) AS v1", f"avg({none}) AS m0", f"var_pop({none}) AS v0",
                "var_pop(value) AS v", f"count({one}) AS n1", f"count({none}) AS n0",
            ],
        )
    )
    floor = moments.groupBy("model_id").agg((F.max("v") * smoothing).alias("eps"))
    return moments.join(floor, "model_id").selectExpr(
        "model_id", "feature", "m0", "m1", "v0 + eps AS v0", "v1 + eps AS v1", "ln(n1 / n0) AS prior"
    )


def bayes_votes(features: DataFrame, fitted: DataFrame) -> DataFrame:
    """Votes ``model_id, station, win_end, pred``: sign of the summed log odds."""
    odds = "0.5 * ln(v0 / v1) + (value - m0) * (value - m0) / (2 * v0) - (value - m1) * (value - m1) / (2 * v1)"
    return (
        features.select("station", "win_end", "feature", "value")
        .join(fitted, "feature")
        .groupBy(*KEYS)
        .agg(F.expr(f"sum({odds}) + max(prior) AS odds"))
        .selectExpr(*KEYS, "CAST(odds > 0 AS DOUBLE) AS pred")
    )


# ---- k nearest neighbours --------------------------------------------------------------------------------


def _vectors(rows: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    if "vec" in rows.columns:
        return rows.select(*KEYS, *extra, "vec")
    ordered = F.array_sort(F.collect_list(F.struct("feature", "value")))
    return rows.groupBy(*KEYS, *extra).agg(ordered.getField("value").alias("vec"))


def _sides(length: int) -> list:
    """Aggregates: rows, least and largest value at each place of their vectors."""
    at = [F.get("vec", F.lit(i)) for i in range(length)]
    return [F.count("*").alias("n"), F.max(F.size("vec")).alias("size"), F.array(*map(F.min, at)).alias("low"), F.array(*map(F.max, at)).alias("high")]


def _length(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.size("vec"))).first()[0] or 0


def neighbour_blocks(rows: DataFrame | Packed, block: int = BLOCK, k: int = MOST) -> DataFrame:
    """Training vectors of each model with the number of their block: ``model_id, station, win_end, label, vec, block``.

    A block of more than ``block`` rows is cut at the median of its widest feature, one of more than twice as many at its quartiles, all
    blocks of all models in one round. Of equal
    vectors the first ``k`` by station and time are kept, since no vote of up to ``k`` neighbours counts another. Block 0 has the rows
    that no box can hold: values missing or not finite, or another number of them than most of the model.
    """
    if isinstance(rows, Packed):
        rows = model_vectors(rows.windows, rows, sampled=True)
    # the digest spares the sort most comparisons of vectors; equal ones have equal digests, but 0 and -0 are made one
    digest = F.expr("xxhash64(transform(vec, x -> x + 0D))")
    first = F.row_number().over(Window.partitionBy("model_id", "digest", "vec").orderBy("station", "win_end"))
    held = _vectors(rows, ["label"]).withColumn("digest", digest).withColumn("place", first)
    vectors = cut_lineage(held.filter(F.col("place") <= k).drop("place", "digest"))
    length = _length(vectors)
    full = vectors.groupBy("model_id").agg(F.max(F.size("vec")).alias("full"))
    sound = "CAST(size(vec) = full AND forall(vec, x -> coalesce(abs(x) < double('infinity'), false)) AS BIGINT) AS block"
    held = cut_lineage(vectors.join(F.broadcast(full), "model_id").selectExpr(*vectors.columns, sound))
    while True:
        widest = "array_max(transform(sequence(0, size - 1), i -> named_struct('width', high[i] / 2 - low[i] / 2, 'i', i, 'low', low[i], 'high', high[i])))"
        large = held.filter("block > 0").groupBy("model_id", "block").agg(*_sides(length)).filter(F.col("n") > block)
        large = cut_lineage(large.selectExpr("model_id", "block", f"n > {2 * block} AS far", f"{widest} AS side").filter("side.low < side.high"))
        if large.isEmpty():
            return held
        inside = held.join(F.broadcast(large), ["model_id", "block"]).withColumn("x", F.expr("vec[side.i]"))
        middle = "side.low / 2 + side.high / 2"
        marks = "filter(IF(far, marks, array(marks[1])), x -> x < side.high)"
        quartiles = F.percentile_approx("x", [0.25, 0.5, 0.75], 1000).alias("marks")
        cuts = inside.groupBy("model_id", "block", "far", "side").agg(quartiles).selectExpr(
            "model_id", "block", "side.i AS i",
            f"CASE WHEN size({marks}) > 0 THEN array_distinct({marks}) WHEN {middle} < side.high THEN array({middle}) ELSE array(side.low) END AS cuts",
        )
        child = "CASE WHEN cuts IS NULL THEN block ELSE block * 4 + size(filter(cuts, x -> vec[i] > x)) END AS block"
        held = cut_lineage(held.join(F.broadcast(cuts), ["model_id", "block"], "left").selectExpr(*vectors.columns, child))


def _boxes(blocks: DataFrame) -> neighbours.Boxes:
    """Numbers and boxes of each model's blocks; one box for each some thousand training rows."""
    found: dict[int, list] = {}
    for r in blocks.filter("block > 0").groupBy("model_id", "block").agg(*_sides(_length(blocks))).collect():
        found.setdefault(r.model_id, []).append((r.block, r.low[: r.size], r.high[: r.size]))
    return {m: tuple(np.array(x) for x in zip(*sorted(boxes))) for m, boxes in found.items()}


def _first_of_kind(blocks: DataFrame, k: int) -> DataFrame:
    """Per model, the rows that decide where distances do not order: ``model_id, sound, members``.

    Distances to a window of missing or infinite values are the same for all rows with missing or infinite values at the same places,
    and so are those of any window to such rows. The first ``k`` of each kind are enough. Rows with another number of values all stay.
    """
    full = blocks.groupBy("model_id").agg(F.max(F.size("vec")).alias("full"))
    letter = "CASE WHEN x IS NULL THEN 'n' WHEN isnan(x) THEN 'x' WHEN x = double('infinity') THEN '+' WHEN x = -double('infinity') THEN '-' ELSE '0' END"
    kind = f"CASE WHEN size(vec) = full THEN array_join(transform(vec, x -> {letter}), '') ELSE concat_ws(':', station, win_end) END AS kind"
    order = F.row_number().over(Window.partitionBy("model_id", "kind").orderBy("station", "win_end"))
    first = blocks.join(F.broadcast(full), "model_id").selectExpr(*blocks.columns, kind).withColumn("place", order).filter(F.col("place") <= k)
    return first.groupBy("model_id", F.expr("block > 0").alias("sound")).agg(
        F.collect_list(F.struct("vec", "label", "station", "win_end")).alias("members")
    )


def _nearest_of_blocks(asked: DataFrame, blocks: DataFrame, k: int, p: int, boxes: neighbours.Boxes | None, odd: set[int]) -> DataFrame:
    """The k best of its block for each window; blocks come before their windows."""
    rows = blocks.filter("block > 0").selectExpr(*KEYS, "label", "vec", "block", "false AS asks")
    both = rows.unionByName(asked.selectExpr(*KEYS, "CAST(NULL AS DOUBLE) AS label", "vec", "block", "true AS asks"))
    ordered = place(both, "model_id", "block").sortWithinPartitions("model_id", "block", "asks", "station", "win_end")
    schema = "model_id BIGINT, station BIGINT, win_end BIGINT, near ARRAY<STRUCT<d DOUBLE, s BIGINT, w BIGINT, label DOUBLE>>"
    if boxes is not None:
        schema += ", others ARRAY<BIGINT>, vec ARRAY<DOUBLE>"
    return ordered.mapInArrow(neighbours.searcher(k, p, boxes, odd), schema)


def neighbour_votes(inputs: DataFrame, blocks: DataFrame, k: int = 3, p: int = 2, weights: str = "uniform") -> DataFrame:
    """Exact k-nearest-neighbour votes; ``k`` is at most that of the blocks. A window takes its k best from the block next to it, then
    from the other blocks of its model whose boxes are no farther than the worst of these, and the k best of all decide. A task holds
    one block and a batch of windows; no pair of rows is ever emitted. Windows and rows that no box can hold meet directly, by kinds."""
    boxes = _boxes(blocks)
    few = cut_lineage(_first_of_kind(blocks, k))
    odd = {r.model_id for r in few.filter("NOT sound").select("model_id").distinct().collect()}
    vectors = _vectors(inputs)
    routed = vectors.mapInArrow(neighbours.router(boxes, p), "model_id BIGINT, station BIGINT, win_end BIGINT, vec ARRAY<DOUBLE>, block BIGINT")
    started = cut_lineage(_nearest_of_blocks(routed, blocks, k, p, boxes, odd).withColumn("block", F.expr("size(near) > 0")))
    open_ = started.filter("vec IS NOT NULL")
    visits = open_.select(*KEYS, "vec", F.explode("others").alias("block"))
    gap = "abs(u - v)" if p == 1 else f"pow(abs(u - v), {p})"
    distance = f"aggregate(zip_with(vec, m.vec, (u, v) -> {gap}), 0D, (a, d) -> a + d)"
    near = f"slice(array_sort(transform(members, m -> struct({distance} AS d, m.station AS s, m.win_end AS w, m.label AS label))), 1, {k})"
    direct = open_.join(few, "model_id").filter("NOT (sound AND block)").selectExpr(*KEYS, f"{near} AS near")
    met = open_.select(*KEYS, "near").unionByName(_nearest_of_blocks(visits, blocks, k, p, None, odd)).unionByName(direct)
    best = met.groupBy(*KEYS).agg(F.expr(f"slice(array_sort(flatten(collect_list(near))), 1, {k}) AS near")).filter("size(near) > 0")
    best = best.unionByName(started.filter("vec IS NULL").select(*KEYS, "near"))
    if weights == "uniform":
        weight = "1D"
    else:
        # A training row at distance zero outweighs all others.
        weight = f"CASE WHEN near[0].d = 0 THEN CAST(m.d = 0 AS DOUBLE) ELSE 1 / pow(m.d, {1 / p!r}) END"
    pull = f"aggregate(transform(near, m -> (2 * m.label - 1) * {weight}), 0D, (a, v) -> a + v)"
    return best.selectExpr(*KEYS, f"CAST({pull} > 0 AS DOUBLE) AS pred")


def search_neighbours(rows: DataFrame, folded: DataFrame, points: list[dict]) -> DataFrame:
    """Grid point of best balanced accuracy per model: ``model_id, k, p, weights``."""
    folds = folded.select(*KEYS, "fold", "test")
    spread = cut_lineage(
        rows.join(folds, KEYS).withColumn("parent", F.col("model_id")).withColumn("model_id", F.col("model_id") * 1000 + F.col("fold"))
    )
    blocks, tests = neighbour_blocks(spread.filter("NOT test")), spread.filter("test")
    labels = tests.select("model_id", "parent", "station", "win_end", "label").distinct()
    scores = None
    for number, point in enumerate(points):
        votes = neighbour_votes(tests.select(*KEYS, "feature", "value"), blocks, point["n_neighbors"], point["p"], point["weights"])
        score = cut_lineage(
            balanced_accuracy(votes.join(labels, KEYS), ["model_id", "parent"])
            .groupBy(F.col("parent").alias("model_id"))
            .agg(F.avg("score").alias("score"))
            .selectExpr("*", f"-{number} AS place", f"{point['n_neighbors']} AS k", f"{point['p']} AS p", f"'{point['weights']}' AS weights")
        )
        scores = score if scores is None else scores.unionByName(score)
    return scores.groupBy("model_id").agg(F.max(F.struct("score", "place", "k", "p", "weights")).alias("s")).select(
        "model_id", "s.k", "s.p", "s.weights"
    )


def searched_neighbour_votes(inputs: DataFrame, fitted: DataFrame) -> DataFrame:
    """Votes of models that each have their own grid point (one branch per point in use)."""
    used = [r.asDict() for r in fitted.select("k", "p", "weights").distinct().collect()]
    out = None
    for u in used:
        mine = fitted.filter((F.col("k") == u["k"]) & (F.col("p") == u["p"]) & (F.col("weights") == u["weights"]))
        part = neighbour_votes(inputs, mine.select(*KEYS, "label", "vec", "block"), u["k"], u["p"], u["weights"])
        out = part if out is None else out.unionByName(part)
    return out


# ---- trees -----------------------------------------------------------------------------------------------


def feature_count(rule: str | None, n: int) -> int | None:
    if rule is None:
        return None
    return max(1, int(math.sqrt(n)) if rule in ("auto", "sqrt") else int(math.log2(n)))


# ---- Spark ML --------------------------------------------------------------------------------------------


def make_estimator(code: str, point: dict, n_features: int, n_rows: int):
    """Spark ML estimator of a classifier code at one grid point.

    Differences that Spark ML leaves: networks are sigmoid without weight decay.
    """
    columns = {"featuresCol": "vector", "labelCol": "label"}
    if code == "NN":
        return MultilayerPerceptronClassifier(layers=[n_features, point["hidden_layer_sizes"], 2], maxIter=200, seed=0, **columns)
    raise ValueError(f"unknown classifier code {code!r}")


def model_frame(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """One vector row per window of each model's sample, with its class weight."""
    vectors = _vectors(rows, ["label"]).withColumn("vector", array_to_vector("vec")).drop("vec")
    return vectors.join(weights.select("model_id", "label", "weight"), ["model_id", "label"])


def search_estimator(frame: DataFrame, folds: DataFrame, code: str, n_features: int, points: list[dict]) -> Transformer:
    """Grid search of one model by balanced accuracy; points that cannot be fitted are passed over."""
    frame = frame.cache()
    try:
        n_rows = frame.count()
        split = frame.join(folds, KEYS).cache()
        numbers = [r["fold"] for r in folds.select("fold").distinct().collect()]
        best, best_score = None, -1.0
        for point in points if len(points) > 1 else []:
            try:
                scores = []
                for fold in numbers:
                    part = split.filter(F.col("fold") == fold)
                    model = make_estimator(code, point, n_features, n_rows).fit(part.filter("NOT test"))
                    votes = model.transform(part.filter("test")).withColumn("pred", F.col("prediction"))
                    scores.append(balanced_accuracy(votes, []).first()["score"])
                score = sum(scores) / len(scores)
            except (IllegalArgumentException, ArithmeticException, ZeroDivisionError):  # a point that cannot be fitted scores nothing
                continue
            if score > best_score:
                best, best_score = point, score
        split.unpersist()
        return make_estimator(code, best or points[0], n_features, n_rows).fit(frame)
    finally:
        frame.unpersist()


def fit_estimators(
    rows: DataFrame, weights: DataFrame, folded: DataFrame, code: str, n_models: int, n_features: int,
    points: list[dict] | None = None, threads: int = 4,
) -> dict[int, Transformer]:
    """Spark ML models of a set. The driver only starts fits, a few at a time; each fit is distributed."""
    frame = cut_lineage(model_frame(rows, weights))
    folds = cut_lineage(folded.select(*KEYS, "fold", "test"))
    points = points or grid_points(code)

    def fit(number: int) -> Transformer:
        mine = F.col("model_id") == number
        return search_estimator(frame.filter(mine), folds.filter(mine), code, n_features, points)

    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(range(n_models), pool.map(fit, range(n_models))))


def estimator_votes(inputs: DataFrame, models: dict[int, Transformer]) -> DataFrame:
    """Votes of fitted Spark ML models."""
    vectors = _vectors(inputs).withColumn("vector", array_to_vector("vec")).drop("vec")
    parts: list[DataFrame] = [
        m.transform(vectors.filter(F.col("model_id") == number)).select(*KEYS, F.col("prediction").alias("pred"))
        for number, m in models.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


