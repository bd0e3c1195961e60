"""Logistic regression and linear support vectors for a whole set of models in one job.

A fit is a (model, fold, grid point); all fits of all models go through the same rounds. A round is one pass over the models'
vectors: each task adds up loss, gradient and Hessian of the fits whose rows it holds, one row a task and model is shuffled, and
a grouped call adds these up, solves the small systems and moves each fit on by a damped Newton step. Fits that have converged leave.
What is sent to tasks and comes back is ``models * fits * features`` numbers, whatever the number of windows.

The objective is ``w.w / 2 + C * sum(weight * loss)`` with an intercept that is not penalised and weights that balance the classes of the
rows a fit learns from. Features are centred and scaled inside (the penalty is scaled along, so the objective stays the same).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.operators import packed
from foreshock.operators.models import KEYS
from foreshock.operators.packed import Packed, Vectors
from foreshock.sources.tables import cut_lineage

#: Fold number of the fits that learn from all rows.
ALL = -1
ROUNDS = 100
#: A fit has converged when a Newton step would lower its objective by less than this share.
CLOSE = 1e-12
#: Rows of a model that a task takes at a time.
STEP = 4096
#: Part of the Hessian's diagonal added before it is inverted; it bends the steps, not the solution.
RIDGE = 1e-10

VECTORS = "model_id BIGINT, label DOUBLE, folds BIGINT, x ARRAY<DOUBLE>"


def _logistic(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each signed margin, its slope and curvature."""
    loss = np.logaddexp(0.0, -margin)
    p = np.exp(-loss)
    return loss, p - 1, p * (1 - p)


def _squared_hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    short = np.maximum(1 - margin, 0.0)
    return short**2, -2 * short, 2.0 * (short > 0)


LOSSES = {"LR": _logistic, "SVM": _squared_hinge}


class Fits(NamedTuple):
    """State of a model's fits, one entry (or row) each."""

    fold: np.ndarray
    c: np.ndarray
    penalty: np.ndarray  # by coefficient; none on the last, the intercept
    base: np.ndarray
    step: np.ndarray
    reach: np.ndarray  # share of the step that is tried
    value: np.ndarray  # objective at the base
    slope: np.ndarray
    done: np.ndarray

    @property
    def tried(self) -> np.ndarray:
        return self.base + self.reach[:, None] * self.step


# ---- vectors ---------------------------------------------------------------------------------------------


def scales(rows: DataFrame) -> DataFrame:
    """Mean and spread of each model's features, by name: ``model_id, feature, centre, scale``. Constant features keep scale 1."""
    spread = F.stddev_pop("value")
    return rows.groupBy("model_id", "feature").agg(
        F.avg("value").alias("centre"), F.when(spread > 0, spread).otherwise(1.0).alias("scale")
    )


def vectors(rows: DataFrame, folded: DataFrame, scaled: DataFrame) -> DataFrame:
    """One row per window of each model's sample: ``model_id, label, folds, x``; ``folds`` has a bit for each fold that
    tests on the row, ``x`` is in the order of feature names. Rows of a model lie together in files, whatever their number."""
    tests = folded.groupBy(*KEYS).agg(F.sum(F.expr("CASE WHEN test THEN shiftleft(1L, fold) ELSE 0L END")).alias("folds"))
    value = ((F.col("value") - F.col("centre")) / F.col("scale")).alias("value")
    named = F.array_sort(F.collect_list(F.struct("feature", "value")))
    x = (
        rows.join(scaled, ["model_id", "feature"]).select(*KEYS, "label", "feature", value)
        .groupBy(*KEYS, "label").agg(named.getField("value").alias("x"))
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = x.join(tests.hint("merge"), KEYS, "left").selectExpr("model_id", "label", "coalesce(folds, 0L) AS folds", "x", "xxhash64(station, win_end) AS spot")
    return out.repartitionByRange(parts, "model_id", "spot").sortWithinPartitions("model_id").drop("spot")


def _by_model(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Model, signed labels, fold bits and vectors (with a 1 for the intercept) of each run of a model in a batch."""
    model = batch.column("model_id").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(model)) + 1).tolist(), len(model)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            x = pc.list_flatten(batch.column("x").slice(a, b - a)).to_numpy().reshape(b - a, -1)
            y = np.where(batch.column("label").slice(a, b - a).to_numpy() > 0, 1.0, -1.0)
            yield int(model[a]), y, batch.column("folds").slice(a, b - a).to_numpy(), np.hstack([x, np.ones((b - a, 1))])


def _in_fold(folds: np.ndarray, fold: int) -> np.ndarray:
    """Rows that a fold tests on."""
    return (folds >> fold & 1) > 0 if fold != ALL else np.zeros(len(folds), bool)


# ---- sums ------------------------------------------------------------------------------------------------

_SUMS = "model_id BIGINT, sums ARRAY<DOUBLE>"


def _summed(per_block):
    """One row a task and model: the sum of ``per_block(model, y, folds, x)``, an array of fixed length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for model, *block in _by_model(batch):
                part = per_block(model, *block)
                if part is not None:
                    total[model] = total[model] + part if model in total else part
        for model, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.int64()), pa.array([sums], pa.list_(pa.float64()))], ["model_id", "sums"])

    return run


def _added(finish):
    """The summed rows of a model, through ``finish(model, sums)``."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        out = finish(key[0].as_py(), np.sum(np.stack(rows.column("sums").to_numpy()), axis=0))
        return pa.table({"model_id": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([out], pa.list_(pa.float64()))})

    return run


def _collected(data: DataFrame, per_block, finish) -> dict[int, np.ndarray]:
    """Sums by model: one short array of each model comes to the driver."""
    parts = data.mapInArrow(_summed(per_block), _SUMS).groupBy("model_id").applyInArrow(_added(finish), _SUMS)
    return {r["model_id"]: np.array(r["sums"]) for r in parts.collect()}


def class_counts(data: DataFrame, folds: int) -> dict[int, np.ndarray]:
    """Rows of both classes that each fold learns from, the last entry for all rows: arrays ``[fold, class]``."""

    def count(model: int, y: np.ndarray, bits: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((folds + 1, 2))
        for k, fold in enumerate([*range(folds), ALL]):
            learns = ~_in_fold(bits, fold)
            out[k] = (learns & (y < 0)).sum(), (learns & (y > 0)).sum()
        return out.ravel()

    return {m: s.reshape(folds + 1, 2) for m, s in _collected(data, count, lambda m, s: s).items()}


# ---- rounds ----------------------------------------------------------------------------------------------


def _derivatives(kind: str, sent):
    loss_of = LOSSES[kind]

    def run(model: int, y: np.ndarray, bits: np.ndarray, x: np.ndarray) -> np.ndarray | None:
        """Weighted loss, gradient and upper Hessian of a model's open fits, fit by fit."""
        fits, counts = sent.value[model]
        p, open_ = x.shape[1], np.flatnonzero(~fits.done)
        if not len(open_):
            return None
        upper = np.triu_indices(p)
        out = np.zeros((len(open_), 1 + p + len(upper[0])))
        tried = fits.tried
        for row, k in enumerate(open_):
            fold = int(fits.fold[k])
            learns = ~_in_fold(bits, fold)
            n = counts[fold]  # ALL is the last
            weight = np.where(y > 0, n.sum() / (2 * n[1]), n.sum() / (2 * n[0])) * learns * fits.c[k]
            loss, slope, curve = loss_of(y * (x @ tried[k]))
            out[row, 0] = weight @ loss
            out[row, 1 : 1 + p] = (weight * slope * y) @ x
            out[row, 1 + p :] = (x.T @ (x * (weight * curve)[:, None]))[upper]
        return out.ravel()

    return run


def advance(fits: Fits, sums: np.ndarray) -> Fits:
    """Fits after a round: a tried point that lowers the objective enough becomes the base of a new step, else half the
    step is tried next."""
    open_ = np.flatnonzero(~fits.done)
    p = fits.base.shape[1]
    upper = np.triu_indices(p)
    new = Fits(*(a.copy() for a in fits))
    for row, k in zip(sums.reshape(len(open_), -1), open_):
        w = fits.tried[k]
        value = row[0] + fits.penalty[k] @ w**2 / 2
        if not value <= fits.value[k] + 1e-4 * fits.reach[k] * fits.slope[k] + 1e-15 * abs(fits.value[k]):
            new.reach[k] /= 2
            new.done[k] = new.reach[k] < 1e-10
            continue
        gradient = row[1 : 1 + p] + fits.penalty[k] * w
        hessian = np.zeros((p, p))
        hessian[upper] = row[1 + p :]
        hessian += np.triu(hessian, 1).T + np.diag(fits.penalty[k])
        hessian += np.diag(RIDGE * np.diag(hessian) + np.finfo(float).tiny)
        step = -np.linalg.lstsq(hessian, gradient, rcond=1e-15)[0]
        slope = gradient @ step
        new.base[k], new.value[k], new.step[k], new.slope[k], new.reach[k] = w, value, step, slope, 1.0
        new.done[k] = -slope <= CLOSE * abs(value) or slope >= 0
    return new


def _flat(fits: Fits) -> np.ndarray:
    return np.concatenate([np.asarray(a, float).ravel() for a in fits])


def _restore(flat: np.ndarray, n: int) -> Fits:
    p = (len(flat) // n - 6) // 3
    sizes = [n, n, n * p, n * p, n * p, n, n, n, n]
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    shaped = [a.reshape(n, p) if len(a) == n * p and i in (2, 3, 4) else a for i, a in enumerate(parts)]
    return Fits(shaped[0].astype(int), *shaped[1:8], shaped[8] > 0)


def fit_all(data: DataFrame, kind: str, fits: dict[int, Fits], counts: dict[int, np.ndarray], rounds: int = ROUNDS) -> dict[int, Fits]:
    """All fits after as many rounds as the slowest needs, or ``rounds``."""
    context = data.sparkSession.sparkContext
    for _ in range(rounds):
        if all(f.done.all() for f in fits.values()):
            break
        sent = context.broadcast({m: (f, counts[m]) for m, f in fits.items()})
        finish = lambda m, sums: _flat(advance(sent.value[m][0], sums))  # noqa: E731, B023
        moved = _collected(data, _derivatives(kind, sent), finish)
        fits = fits | {m: _restore(flat, len(fits[m].fold)) for m, flat in moved.items()}
        sent.unpersist()
    return fits


def test_counts(data: DataFrame, fits: dict[int, Fits]) -> dict[int, np.ndarray]:
    """Rows of the test parts, by fit: of the lower class, right ones among them, of the upper class, right ones."""
    sent = data.sparkSession.sparkContext.broadcast(fits)

    def count(model: int, y: np.ndarray, bits: np.ndarray, x: np.ndarray) -> np.ndarray:
        f = sent.value[model]
        right = (x @ f.base.T > 0) == (y > 0)[:, None]
        out = np.zeros((len(f.fold), 4))
        for k, fold in enumerate(f.fold):
            tests = _in_fold(bits, int(fold))
            low, high = tests & (y < 0), tests & (y > 0)
            out[k] = low.sum(), right[low, k].sum(), high.sum(), right[high, k].sum()
        return out.ravel()

    return {m: s.reshape(-1, 4) for m, s in _collected(data, count, lambda m, s: s).items()}


# ---- packed samples --------------------------------------------------------------------------------------


def packed_scales(rows: Packed) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and spread of each model's features. Constant features keep scale 1."""

    def ends(model: int, y: np.ndarray, tests: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x.min(axis=0), -x.max(axis=0)])

    found = packed.collected(rows, ends, merge=lambda arrays: arrays.min(axis=0))
    low = {m: e[: len(e) // 2] for m, e in found.items()}
    flat = {m: e[: len(e) // 2] == -e[len(e) // 2 :] for m, e in found.items()}

    def moments(model: int, y: np.ndarray, tests: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.append((x - near[model]).sum(axis=0), len(x))

    def squares(model: int, y: np.ndarray, tests: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.append(((x - near[model]) ** 2).sum(axis=0), len(x))

    near = low
    near = {m: low[m] + s[:-1] / s[-1] for m, s in packed.collected(rows, moments).items()}
    spread = {m: np.sqrt(s[:-1] / s[-1]) for m, s in packed.collected(rows, squares).items()}
    return {m: (near[m], np.where(flat[m] | ~(spread[m] > 0), 1.0, spread[m])) for m in near}


def _packed_derivatives(kind: str, sent):
    loss_of = LOSSES[kind]

    def run(model: int, y: np.ndarray, tests: np.ndarray, x: np.ndarray) -> np.ndarray | None:
        """What ``_derivatives`` gives, all open fits of a model at a time."""
        fits, counts, centre, scale = sent.value[model]
        open_ = np.flatnonzero(~fits.done)
        if not len(open_):
            return None
        p = x.shape[1] + 1
        i, j = np.triu_indices(p)
        n = counts[fits.fold[open_]]  # ALL is the last
        by_class = n.sum(axis=1)[:, None] / (2 * n) * fits.c[open_, None]
        tried, sums = fits.tried[open_].T, np.zeros((len(open_), 1 + p + len(i)))
        learns = np.column_stack([~tests, np.ones(len(y), bool)])[:, fits.fold[open_]]
        for a in range(0, len(y), STEP):
            some = slice(a, a + STEP)
            z = np.column_stack([(x[some] - centre) / scale, np.ones(len(x[some]))])
            sign = np.where(y[some], 1.0, -1.0)[:, None]
            loss, slope, curve = loss_of(sign * (z @ tried))
            weight = np.where(y[some, None], by_class[:, 1], by_class[:, 0]) * learns[some]
            sums[:, 0] += (weight * loss).sum(axis=0)
            sums[:, 1 : 1 + p] += (weight * slope * sign).T @ z
            sums[:, 1 + p :] += (weight * curve).T @ (z[:, i] * z[:, j])
        return sums.ravel()

    return run


def fit_packed(rows: Packed, kind: str, fits: dict[int, Fits], counts: dict[int, np.ndarray], scaled: dict, rounds: int = ROUNDS) -> dict[int, Fits]:
    """All fits after as many rounds as the slowest needs, or ``rounds``; models whose fits are done are passed over."""
    context = rows.windows.sparkSession.sparkContext
    for _ in range(rounds):
        left = {m: f for m, f in fits.items() if not f.done.all()}
        if not left:
            break
        sent = context.broadcast({m: (f, counts[m], *scaled[m]) for m, f in left.items()})
        finish = lambda m, sums: _flat(advance(sent.value[m][0], sums))  # noqa: E731, B023
        moved = packed.collected(rows._replace(chosen={m: rows.chosen[m] for m in left}), _packed_derivatives(kind, sent), finish)
        fits = fits | {m: _restore(flat, len(fits[m].fold)) for m, flat in moved.items()}
        sent.unpersist()
    return fits


def packed_tests(rows: Packed, fits: dict[int, Fits], scaled: dict) -> dict[int, np.ndarray]:
    """What ``test_counts`` gives."""
    sent = rows.windows.sparkSession.sparkContext.broadcast({m: (f, *scaled[m]) for m, f in fits.items()})

    def count(model: int, y: np.ndarray, tests: np.ndarray, x: np.ndarray) -> np.ndarray:
        f, centre, scale = sent.value[model]
        right = (np.column_stack([(x - centre) / scale, np.ones(len(x))]) @ f.base.T > 0) == y[:, None]
        mine = np.column_stack([tests, np.zeros(len(y), bool)])[:, f.fold]
        return np.column_stack([(mine & side[:, None] & hit).sum(axis=0) for side in (~y, y) for hit in (True, right)]).ravel().astype(float)

    return {m: s.reshape(-1, 4) for m, s in packed.collected(rows, count).items()}


# ---- grid search -----------------------------------------------------------------------------------------

FITTED = "model_id BIGINT, c DOUBLE, feature STRING, coefficient DOUBLE, intercept DOUBLE, converged BOOLEAN"
SEARCHED = "model_id BIGINT, c DOUBLE, fold INT, score DOUBLE, converged BOOLEAN"


def search_linear(rows: DataFrame | Packed, folded: DataFrame, kind: str, points: list[dict]) -> tuple[DataFrame, DataFrame]:
    """The fits of best mean balanced accuracy over folds, refitted on whole samples (``FITTED``, one row per model and feature), and the
    score of every model, point and fold (``SEARCHED``). A fold whose learning part has one class only cannot be fitted: its score is
    null and its points count without it. Of equal points the first in the grid holds; a model that has one class only is an error.

    ``rows`` are the long training rows or packed samples, ``folded`` is ``model_id, station, win_end, fold, test``.
    """
    if kind not in LOSSES:
        raise ValueError(f"unknown linear classifier {kind!r}")
    if any(set(p) - {"C"} for p in points):
        raise ValueError(f"{kind} is linear: its grid has C only")
    cs = [float(p["C"]) for p in points]
    shapes: dict[int, list] = {}
    if isinstance(rows, Packed):
        spark, rows = rows.windows.sparkSession, packed.with_folds(rows, folded)
        folds, counts, held = rows.folds, packed.class_counts(rows), packed_scales(rows)
        for model, (centre, scale) in sorted(held.items()):
            shapes[model] = [
                {"feature": rows.names[j], "centre": float(c), "scale": float(s)} for j, c, s in zip(rows.chosen[model], centre, scale)
            ]
    else:
        spark, scaled = rows.sparkSession, cut_lineage(scales(rows))
        folds = folded.agg(F.max("fold")).first()[0] + 1
        data = cut_lineage(vectors(rows, folded, scaled))
        counts = class_counts(data, folds)
        for r in scaled.orderBy("model_id", "feature").collect():  # models times features
            shapes.setdefault(r["model_id"], []).append(r)
    fits = {}
    for model, own in shapes.items():
        if not counts[model][ALL].all():
            raise ValueError(f"the sample of model {model} has one class only")
        fold = np.repeat([*range(folds), ALL], len(cs))
        penalty = np.append([1 / r["scale"] ** 2 for r in own], 0.0)
        n, p = len(fold), len(own) + 1
        zero = np.zeros(n)
        one_class = ~counts[model][fold].all(axis=1)
        fits[model] = Fits(fold, np.tile(cs, folds + 1), np.tile(penalty, (n, 1)), np.zeros((n, p)), np.zeros((n, p)), zero, zero + np.inf, zero, one_class)
    if isinstance(rows, Packed):
        fits = fit_packed(rows, kind, fits, counts, held)
        tested = packed_tests(rows, fits, held)
    else:
        fits = fit_all(data, kind, fits, counts)
        tested = test_counts(data, fits)

    fitted, searched = [], []
    for model, f in sorted(fits.items()):
        can = counts[model][f.fold].all(axis=1)
        n0, r0, n1, r1 = tested[model].T
        with np.errstate(divide="ignore", invalid="ignore"):
            low, high = r0 / n0, r1 / n1
        score = (np.where(n0 > 0, low, high) + np.where(n1 > 0, high, low)) / 2
        score[~can] = np.nan
        for k in np.flatnonzero(f.fold != ALL):
            searched.append((model, float(f.c[k]), int(f.fold[k]), None if np.isnan(score[k]) else float(score[k]), bool(can[k] and f.done[k])))
        table = score.reshape(folds + 1, len(cs))[:-1]
        known = ~np.isnan(table)
        mean = np.where(known, table, 0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
        k = len(f.fold) - len(cs) + int(np.argmax(np.round(mean, 12)))
        own = shapes[model]
        w = f.base[k, :-1] / np.array([r["scale"] for r in own])
        intercept = float(f.base[k, -1] - w @ np.array([r["centre"] for r in own]))
        fitted += [(model, float(f.c[k]), r["feature"], float(v), intercept, bool(f.done[k])) for r, v in zip(own, w)]
    return spark.createDataFrame(fitted, FITTED), spark.createDataFrame(searched, SEARCHED)


def linear_votes(features: DataFrame | Vectors, fitted: DataFrame) -> DataFrame:
    """Votes ``model_id, station, win_end, pred`` of long features or vectors: the side of each model's plane they lie on."""
    if isinstance(features, Vectors):
        return _vector_votes(features, fitted)
    return (
        features.select("station", "win_end", "feature", "value")
        .join(fitted.select("model_id", "feature", "coefficient", "intercept"), "feature")
        .groupBy(*KEYS)
        .agg((F.sum(F.col("value") * F.col("coefficient")) + F.max("intercept")).alias("margin"))
        .select(*KEYS, (F.col("margin") > 0).cast("double").alias("pred"))
    )


def _vector_votes(vectors: Vectors, fitted: DataFrame) -> DataFrame:
    """A window without any value of a model's features has no vote; what is no number lies above all planes, as in SQL."""
    at, width = {n: j for j, n in enumerate(vectors.names)}, len(vectors.names)
    planes: dict[int, list] = {}
    for r in fitted.select("model_id", "feature", "coefficient", "intercept").collect():  # models times features
        if r["feature"] in at:
            planes.setdefault(r["model_id"], []).append((at[r["feature"]], r["coefficient"], r["intercept"]))
    held = [(m, np.array([t[0] for t in ts]), np.array([t[1] for t in ts]), max(t[2] for t in ts)) for m, ts in sorted(planes.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = packed.matrix(batch, width)
            none = pc.is_null(pc.list_flatten(batch.column("x"))).to_numpy(zero_copy_only=False).reshape(x.shape)
            known = np.where(none, 0.0, x)
            for model, columns, coefficients, intercept in held:
                on = np.flatnonzero(~none[:, columns].all(axis=1))
                margin = known[on[:, None], columns] @ coefficients + intercept
                keys = batch.take(pa.array(on)).select(["station", "win_end"]).columns
                pred = ((margin > 0) | np.isnan(margin)).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), model)), *keys, pa.array(pred)], ["model_id", "station", "win_end", "pred"])

    return vectors.windows.mapInArrow(run, "model_id BIGINT, station BIGINT, win_end BIGINT, pred DOUBLE")
