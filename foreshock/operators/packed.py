"""Windows of all models as one row each: features and samples that models share are stored and moved once.

``station, win_end, x`` holds a window's values in the order of feature names; sampled windows add ``label``, the models that drew
them as bits of 64-bit words (``models``) and, where folds are dealt, the models that test on them (``folds``, the words of each fold after
one another). Tasks read batches of windows and pick each model's rows and columns themselves, so no row per model is ever written, and
what leaves a task is sums by model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.operators.chunks import place
from foreshock.operators.ranking import value_splits
from foreshock.sources.tables import cut_lineage

WINDOW = ["station", "win_end"]
#: Entries of windows by models that a task holds as numbers at a time.
HELD = 4_000_000


class Vectors(NamedTuple):
    """Windows ``station, win_end, x`` and the feature names of ``x``; a value that a window lacks is null."""

    windows: DataFrame
    names: list[str]


class Packed(NamedTuple):
    """Sampled windows ``station, win_end, label, models, x``, the model of the first bit, values that cut each feature into ranges, and
    by model the places of its features."""

    windows: DataFrame
    names: list[str]
    base: int
    splits: list[np.ndarray]
    chosen: dict[int, np.ndarray]
    folds: int = 0


# ---- packing ---------------------------------------------------------------------------------------------


def window_vectors(features: DataFrame) -> Vectors:
    """Long features gathered by window. A feature that a window has twice is an error."""
    spark = features.sparkSession
    names = sorted(r["feature"] for r in features.select("feature").distinct().collect() if r["feature"] is not None)
    places = F.broadcast(spark.createDataFrame([(n, j) for j, n in enumerate(names)], "feature STRING, place INT"))
    held = F.array_sort(F.collect_list(F.struct("place", "value"))).alias("held")
    rows = place(features.select(*WINDOW, "feature", "value").join(places, "feature"), *WINDOW).groupBy(*WINDOW).agg(held)
    every = f"sequence(0, {max(0, len(names) - 1)})"
    x = f"IF(held.place = {every}, held.value, transform({every}, i -> element_at(map_from_entries(held), i))) AS x"
    return Vectors(cut_lineage(rows.selectExpr(*WINDOW, x)), names)


def _bits(base: int, words: int, where: str = "true") -> list[str]:
    at = f"(model_id - {base}L)"
    return [f"coalesce(bit_or(CASE WHEN {at} DIV 64 = {w} AND {where} THEN shiftleft(1L, CAST({at} % 64 AS INT)) END), 0L)" for w in range(words)]


def sampled_windows(samples: DataFrame, features: DataFrame, vectors: Vectors) -> Packed:
    """Sampled windows that have features. A window is in a sample once, as samples are drawn without replacement; else it is an error."""
    base, last = samples.agg(F.min("model_id"), F.max("model_id")).first()
    base, words = (0, 1) if base is None else (base, (last - base) // 64 + 1)
    members = place(samples, *WINDOW).groupBy(*WINDOW, "label").agg(F.expr(f"array({', '.join(_bits(base, words))})").alias("models"), F.count("*").alias("n"))
    twice = F.raise_error(F.lit("a window is twice in a sample")).cast("array<bigint>")
    once = F.when(F.expr("aggregate(models, 0L, (a, w) -> a + bit_count(w)) = n"), F.col("models")).otherwise(twice).alias("models")
    windows = vectors.windows.hint("merge").join(members.select(*WINDOW, "label", once), WINDOW)
    splits = {r["feature"]: r["splits"] for r in value_splits(features).collect()}  # at most 63 numbers a feature
    fences = [np.unique([s for s in splits.get(n) or [] if s is not None and s == s]) for n in vectors.names]
    return Packed(cut_lineage(windows), vectors.names, base, fences, {})


def with_folds(rows: Packed, folded: DataFrame) -> Packed:
    """``folded`` is ``model_id, station, win_end, fold, test``."""
    last = folded.agg(F.max("fold")).first()[0]
    folds = 0 if last is None else int(last) + 1
    words = _words(rows.windows)
    bits = [b for f in range(folds) for b in _bits(rows.base, words, f"test AND fold = {f}")]
    tests = place(folded, *WINDOW).groupBy(*WINDOW).agg(F.expr(f"array({', '.join(bits)})").alias("folds"))
    none = f"array_repeat(0L, {folds * words})"
    windows = rows.windows.hint("merge").join(tests, WINDOW, "left").withColumn("folds", F.expr(f"coalesce(folds, {none})"))
    return rows._replace(windows=cut_lineage(windows), folds=folds)


def _words(windows: DataFrame) -> int:
    first = windows.select(F.size("models").alias("n")).first()
    return 1 if first is None else first["n"]


def choose(rows: Packed, selected: DataFrame) -> Packed:
    """The features of each model, models times features."""
    at, chosen = {n: j for j, n in enumerate(rows.names)}, {}
    for r in selected.select("model_id", "feature").collect():
        chosen.setdefault(r["model_id"], []).append(at[r["feature"]])
    return rows._replace(chosen={m: np.array(sorted(c)) for m, c in sorted(chosen.items())})


def model_vectors(windows: DataFrame, rows: Packed, sampled: bool) -> DataFrame:
    """Windows once for each model, with the values of its features: ``model_id, station, win_end, [label,] vec``; of sampled
    windows, those in the model's sample."""
    spark = windows.sparkSession
    wanted = spark.createDataFrame([(m, c.tolist()) for m, c in rows.chosen.items()], "model_id BIGINT, places ARRAY<INT>")
    pairs, at = windows.crossJoin(F.broadcast(wanted)), f"(model_id - {rows.base}L)"
    if sampled:
        pairs = pairs.filter(f"getbit(models[CAST({at} DIV 64 AS INT)], CAST({at} % 64 AS INT)) = 1")
    return pairs.selectExpr("model_id", *WINDOW, *(["label"] if sampled else []), "transform(places, i -> x[i]) AS vec")


# ---- reading ---------------------------------------------------------------------------------------------


def bits_of(words: pa.Array, n: int) -> np.ndarray:
    """Words of ``n`` rows as flags, a column for each model."""
    flat = pc.list_flatten(words).to_numpy(zero_copy_only=False).astype("<i8", copy=False)
    return np.unpackbits(np.ascontiguousarray(flat).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").view(bool)


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Values of a batch of windows; nulls are not numbers."""
    return pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(batch.num_rows, width)


class Batch(NamedTuple):
    y: np.ndarray
    on: np.ndarray  # [window, model]
    tests: np.ndarray  # [window, fold, model]
    x: np.ndarray


def batches(rows: Packed) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, Batch]]]:
    width, folds = len(rows.names), rows.folds

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Batch]]:
        for batch in found:
            if n := batch.num_rows:
                on = bits_of(batch.column("models"), n)
                tests = bits_of(batch.column("folds"), n).reshape(n, folds, -1) if folds else np.zeros((n, 0, on.shape[1]), bool)
                yield batch, Batch(batch.column("label").to_numpy(zero_copy_only=False) > 0, on, tests, matrix(batch, width))

    return read


_SUMS = "model_id BIGINT, sums ARRAY<DOUBLE>"


def _sum(arrays: np.ndarray) -> np.ndarray:
    return arrays.sum(axis=0)


def collected(rows: Packed, per_model: Callable, finish: Callable | None = None, merge: Callable = _sum) -> dict[int, np.ndarray]:
    """By model, the merged arrays of ``per_model(model, y, tests, x)`` over batches, ``x`` in the order of the model's features, through
    ``finish(model, array)``. One short array a task and model is shuffled, one a model comes to the driver."""
    read, chosen, base = batches(rows._replace(windows=None)), rows.chosen, rows.base

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for _, b in read(found):
            for model, columns in chosen.items():
                r = np.flatnonzero(b.on[:, model - base])
                if len(r):
                    part = per_model(model, b.y[r], b.tests[r, :, model - base], b.x[r[:, None], columns])
                    if part is not None:
                        total[model] = merge(np.stack([total[model], part])) if model in total else part
        for model, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.int64()), pa.array([sums], pa.list_(pa.float64()))], ["model_id", "sums"])

    def add(key: tuple, part: pa.Table) -> pa.Table:
        model, sums = key[0].as_py(), merge(np.stack(part.column("sums").to_numpy()))
        return pa.table({"model_id": pa.array([model], pa.int64()), "sums": pa.array([finish(model, sums) if finish else sums], pa.list_(pa.float64()))})

    found = rows.windows.mapInArrow(run, _SUMS).groupBy("model_id").applyInArrow(add, _SUMS).toArrow()
    return {m: np.array(s.values) for m, s in zip(found.column("model_id").to_pylist(), found.column("sums").combine_chunks())} if len(found) else {}


def class_counts(rows: Packed) -> dict[int, np.ndarray]:
    """Rows of both classes that each fold learns from, the last entry for all rows: arrays ``[fold, class]``."""

    def count(model: int, y: np.ndarray, tests: np.ndarray, x: np.ndarray) -> np.ndarray:
        learns = np.column_stack([~tests, np.ones(len(y), bool)])
        return np.column_stack([learns[~y].sum(axis=0), learns[y].sum(axis=0)]).ravel().astype(float)

    return {m: s.reshape(-1, 2) for m, s in collected(rows, count).items()}


# ---- ranges of values ------------------------------------------------------------------------------------


def parts_of(x: np.ndarray, splits: Sequence[np.ndarray]) -> np.ndarray:
    """Number of the range of each value; what is no number is in the last."""
    return np.stack([np.searchsorted(s, x[:, j]) for j, s in enumerate(splits)], axis=1)


def starts_of(value: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where a run of equal values (and keys) begins in ordered ones; what is no number is equal."""
    other = ~((value[1:] == value[:-1]) | (np.isnan(value[1:]) & np.isnan(value[:-1])))
    for k in keys:
        other |= k[1:] != k[:-1]
    return np.flatnonzero(np.append(True, other)) if len(value) else np.zeros(0, int)


def dealt_values(rows: Packed) -> DataFrame:
    """Each value of the sampled windows in the task of its feature and range: ``place, part, value, label, models``."""
    spark = rows.windows.sparkSession
    fences = F.broadcast(spark.createDataFrame([(j, s.tolist()) for j, s in enumerate(rows.splits)], "place INT, splits ARRAY<DOUBLE>"))
    values = rows.windows.select("label", "models", F.posexplode("x").alias("place", "value")).filter(F.col("value").isNotNull())
    return values.join(fences, "place").selectExpr("place", "size(filter(splits, s -> s < value)) AS part", "value", "label", "models")


def _ordered(part: pa.Table):
    """Values of a range in order, their classes, the flags of models, and where runs of equal values begin."""
    value = part.column("value").to_numpy()
    order = np.argsort(value, kind="stable")
    on = bits_of(part.column("models").combine_chunks(), len(value))[order]
    return value[order], part.column("label").to_numpy()[order] > 0, on, starts_of(value[order])


def _class_runs(y: np.ndarray, on: np.ndarray, starts: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of both classes at each value, for some models at a time: arrays ``[value, model]``."""
    step = max(1, HELD // max(1, len(y)))
    for a in range(0, on.shape[1], step):
        some = on[:, a : a + step]
        n0, n1 = (np.add.reduceat((some & side[:, None]).astype(np.int64), starts, axis=0) for side in (~y, y))
        yield slice(a, a + step), n0, n1


_PARTS = "place INT, part INT, sums ARRAY<DOUBLE>"


def rank_parts(rows: Packed) -> DataFrame:
    """By feature and range, seven numbers for each model: rows of both classes, values, rank sum of the upper class within the range,
    sum over ties, and rows of both classes at the smallest value."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        _, y, on, starts = _ordered(part)
        out = np.zeros((7, on.shape[1]))
        for some, n0, n1 in _class_runs(y, on, starts):
            t = n0 + n1
            first = (t > 0).argmax(axis=0)[None]
            out[:, some] = (
                n0.sum(axis=0), n1.sum(axis=0), (t > 0).sum(axis=0), (n1 * (t.cumsum(axis=0) - t + (t + 1) / 2)).sum(axis=0),
                (t.astype(float) ** 3 - t).sum(axis=0), np.take_along_axis(n0, first, 0)[0], np.take_along_axis(n1, first, 0)[0],
            )
        return pa.table({"place": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([out.ravel()], pa.list_(pa.float64()))})

    return place(dealt_values(rows), "place", "part").groupBy("place", "part").applyInArrow(run, _PARTS)


_RANKS = "model_id BIGINT, feature STRING, c0 BIGINT, c1 BIGINT, n_values BIGINT, rank_sum DOUBLE, ties DOUBLE, a0 BIGINT, a1 BIGINT"


def rank_sums(rows: Packed, parts: DataFrame) -> DataFrame:
    """What the rank-sum test needs of each model and feature; ranges of a feature (at most 64) meet here."""
    names, base = rows.names, rows.base

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("part")
        sums = np.stack(part.column("sums").to_numpy()).reshape(len(part), 7, -1)
        n0, n1, values, rank, ties, a0, a1 = np.moveaxis(sums, 1, 0)
        below = np.cumsum(n0 + n1, axis=0) - n0 - n1
        first = (values > 0).argmax(axis=0)[None]
        has = np.flatnonzero(values.sum(axis=0) > 0)
        whole = lambda a: pa.array(a[has].astype(np.int64))
        return pa.table({
            "model_id": pa.array(has + base, pa.int64()), "feature": pa.array([names[key[0].as_py()]] * len(has), pa.string()),
            "c0": whole(n0.sum(axis=0)), "c1": whole(n1.sum(axis=0)), "n_values": whole(values.sum(axis=0)),
            "rank_sum": pa.array((rank + below * n1).sum(axis=0)[has]), "ties": pa.array(ties.sum(axis=0)[has]),
            "a0": whole(np.take_along_axis(a0, first, 0)[0]), "a1": whole(np.take_along_axis(a1, first, 0)[0]),
        })

    return parts.groupBy("place").applyInArrow(run, _RANKS)
