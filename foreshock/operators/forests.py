"""Decision trees and random forests of a whole model set in one job, grid search included.

A fit is one tree of a (model, fold, criterion, number of features tried a node); a forest has one for each bootstrap. All fits grow by
the same rounds, one a level. A round is one pass over the models' vectors: each task adds up class counts by (fit, node, feature, bin),
what it found of a fit is one shuffled row, and a grouped call picks the best split of each node of a fit. Shallower trees and smaller
forests are the first levels and first trees of the largest, so the grid needs no growth of its own for them.

Bins are ranks of a model's values of a feature, ``BINS`` at most: samples of up to ``BINS`` rows have a bin for each value, so their
splits are those between all neighbouring values. Bootstraps are Poisson counts of a digest of the row, so they need no second
table and are the same on any cluster. To tasks and back go models * fits * nodes numbers, whatever the number of windows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.operators import packed
from foreshock.operators.chunks import place
from foreshock.operators.linear import ALL, _collected, _in_fold
from foreshock.operators.linear import _by_model as _runs
from foreshock.operators.models import KEYS, feature_count
from foreshock.operators.packed import Packed, Vectors
from foreshock.operators.ranking import class_ranks, value_splits
from foreshock.sources.tables import cut_lineage

BINS = 256
#: Fits that grow at once; their nodes are sent to every task.
MAX_FITS = 16_000
#: Histogram entries a task holds before it hands them on.
HELD = 2_000_000
#: Tree number of fits that learn from each row once.
PLAIN = -1
#: A prime beyond which digests do not go, and the multiplier that makes one tree's digests from the last's.
PRIME, NEXT = 2**31 - 1, 48271
#: A uniform number of at least the k-th of these stands for more than k copies of a row (Poisson counts of mean one).
COPIES = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]

FITTED = "model_id BIGINT, tree INT, node BIGINT, feature STRING, threshold DOUBLE, share DOUBLE"
SEARCHED = "model_id BIGINT, point INT, fold INT, score DOUBLE"


class Fits(NamedTuple):
    """A model's fits, one entry (or row) each; nodes are numbered like a heap."""

    fold: np.ndarray
    entropy: np.ndarray
    tried: np.ndarray  # features tried a node
    tree: np.ndarray
    feature: np.ndarray  # -1 where a node is not split
    cut: np.ndarray
    mass: np.ndarray  # weighted rows of both classes


class Grown(NamedTuple):
    """What tasks know of a model: its features, bins (lowest and highest value of each), class counts by fold and fits."""

    names: list[str]
    low: list[np.ndarray]
    high: list[np.ndarray]
    counts: np.ndarray
    fits: Fits


# ---- vectors ---------------------------------------------------------------------------------------------


def bins(rows: DataFrame) -> DataFrame:
    """Lowest and highest value of each bin: ``model_id, feature, bins``. Equal values share a bin."""
    ranked = class_ranks(rows, value_splits(rows))
    total = ranked.groupBy("model_id", "feature").agg(F.sum(F.col("n0") + F.col("n1")).alias("n"))
    placed = ranked.join(total, ["model_id", "feature"]).withColumn("bin", F.expr(f"({BINS} * (below0 + below1)) DIV n"))
    ends = placed.groupBy("model_id", "feature", "bin").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.groupBy("model_id", "feature").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("bins"))


def vectors(rows: DataFrame, folded: DataFrame) -> DataFrame:
    """One row per window of each model's sample: ``model_id, label, folds, x``. ``folds`` has a bit for each fold that tests on the
    row; ``x`` has the values in the order of feature names and, last, the row's digest for bootstraps."""
    tests = folded.groupBy(*KEYS).agg(F.sum(F.expr("CASE WHEN test THEN shiftleft(1L, fold) ELSE 0L END")).alias("folds"))
    named = F.array_sort(F.collect_list(F.struct("feature", "value")))
    x = rows.groupBy(*KEYS, "label").agg(named.getField("value").alias("x")).join(tests.hint("merge"), KEYS, "left")
    digest = f"pmod(CAST(conv(substr(md5(concat_ws(':', model_id, station, win_end)), 1, 8), 16, 10) AS BIGINT), {PRIME})"
    out = x.selectExpr(
        "model_id", "label", "coalesce(folds, 0L) AS folds", f"concat(x, array(CAST({digest} AS DOUBLE))) AS x", "xxhash64(station, win_end) AS spot"
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(parts, "model_id", "spot").sortWithinPartitions("model_id").drop("spot")


def _by_model(batch: pa.RecordBatch):
    """Model, labels, fold bits, values and digests of each run of a model in a batch."""
    for model, y, bits, x in _runs(batch):
        yield model, y > 0, bits, x[:, :-2], x[:, -2].astype(np.int64)


def copies(digest: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap."""
    if tree == PLAIN:
        return np.ones(len(digest))
    u = digest * pow(NEXT, tree + 1, PRIME) % PRIME
    return np.searchsorted(COPIES, u, side="right").astype(float)


# ---- growth ----------------------------------------------------------------------------------------------


def _step(fits: Fits, k: np.ndarray, node: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Child nodes of the rows of ``x`` in the fits ``k``; 0 where a path has ended."""
    feature = np.take_along_axis(fits.feature[k], node, 1)
    right = x[np.arange(len(x)), np.maximum(feature, 0)] > np.take_along_axis(fits.cut[k], node, 1)
    return np.where(feature >= 0, 2 * node + right, 0)


def level_sums(grown: Grown, level: int, y: np.ndarray, bits: np.ndarray, x: np.ndarray, digest: np.ndarray):
    """Keys (fit, node, feature, bin, class as one number) of the rows at a level and how often each occurs, for some fits at a time."""
    fits, p, nodes = grown.fits, x.shape[1], 1 << level
    placed = np.stack([np.searchsorted(low, x[:, j], side="right") - 1 for j, low in enumerate(grown.low)], axis=1)
    learns = {f: ~_in_fold(bits, int(f)) for f in np.unique(fits.fold)}
    drawn = {t: copies(digest, int(t)) for t in np.unique(fits.tree)}
    size = max(1, HELD // (len(x) * p))
    for a in range(0, len(fits.fold), size):
        k = np.arange(a, min(a + size, len(fits.fold)))
        node = np.ones((len(k), len(x)), np.int64)
        for _ in range(level):
            node = _step(fits, k, node, x)
        weight = np.stack([learns[fits.fold[i]] * drawn[fits.tree[i]] for i in k])
        i, r = np.nonzero((weight > 0) & (node > 0))
        cell = ((k[i] * nodes + node[i, r] - nodes) * p)[:, None] + np.arange(p)
        keys, inverse = np.unique(((cell * BINS + placed[r]) * 2 + y[r][:, None]).ravel(), return_inverse=True)
        yield keys, np.bincount(inverse, np.repeat(weight[i, r], p), len(keys))


_HISTOGRAM = pa.schema([("model_id", pa.int64()), ("fit", pa.int64()), ("keys", pa.list_(pa.int64())), ("mass", pa.list_(pa.float64()))])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([m for _, m in parts]), len(keys))


def _histograms(sent, level: int):
    """One row a task and fit: its keys without the fit, and their counts."""

    def flush(model: int, grown: Grown, parts: list) -> Iterator[pa.RecordBatch]:
        keys, mass = _added(parts)
        span = (1 << level) * len(grown.names) * BINS * 2
        fit, start = np.unique(keys // span, return_index=True)
        ends = pa.array(np.append(start, len(keys)), pa.int32())
        columns = [pa.array(np.full(len(fit), model)), pa.array(fit), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in (keys % span, mass))]
        yield pa.RecordBatch.from_arrays(columns, schema=_HISTOGRAM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, held = None, [], 0
        for batch in batches:
            for model, *block in _by_model(batch):
                if model not in sent.value:
                    continue
                if parts and last != model:
                    yield from flush(last, sent.value[last], parts)
                    parts, held = [], 0
                last = model
                for part in level_sums(sent.value[model], level, *block):
                    if len(part[0]):
                        parts.append(part)
                        held += len(part[0])
                    if held > HELD:
                        parts = [_added(parts)]
                        held = len(parts[0][0])
                        if held > HELD / 2:
                            yield from flush(model, sent.value[model], parts)
                            parts, held = [], 0
        if parts:
            yield from flush(last, sent.value[last], parts)

    return run


def _impurity(mass: np.ndarray, entropy: bool) -> np.ndarray:
    """Impurity of sides with these class masses, times their mass."""
    whole = mass.sum(axis=1)
    if not entropy:
        return 2 * mass[:, 0] * mass[:, 1] / whole
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(mass > 0, -mass * np.log2(mass / whole[:, None]), 0.0).sum(axis=1)


def _tried(model: int, tree: int, node: int, columns: np.ndarray, names: list[str], count: int) -> np.ndarray:
    """The columns a node tries: those of the smallest digests."""
    key = f"{model}:{node}:" if tree == PLAIN else f"{model}:{tree}:{node}:"
    return np.array(sorted(columns.tolist(), key=lambda j: hashlib.md5((key + names[j]).encode()).hexdigest())[:count])


def node_splits(model: int, grown: Grown, k: int, level: int, keys: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best splits of a fit's nodes, rows ``node, feature, cut, masses of both classes left, right``, and the masses of the whole."""
    fits, p = grown.fits, len(grown.names)
    cells, place = np.unique(keys >> 1, return_inverse=True)
    n = np.zeros((len(cells), 2))
    n[place, keys & 1] = mass
    group, bin_ = cells // BINS, cells % BINS
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(cells)))
    upto = np.cumsum(n, axis=0)
    left = upto - np.repeat(upto[first] - n[first], size, axis=0)
    total = np.repeat(left[first + size - 1], size, axis=0)
    counts = grown.counts[fits.fold[k]]
    weight = counts.sum() / (2 * counts)
    whole = total[group < p][0] * weight if level == 0 else np.zeros(2)
    at = np.flatnonzero(np.append(group[1:] == group[:-1], False) & (total > 0).all(axis=1))
    node, column = group[at] // p + (1 << level), group[at] % p
    if fits.tried[k] < p:
        keep = np.zeros(len(at), bool)
        for one in np.unique(node):
            mine = node == one
            keep |= mine & np.isin(column, _tried(model, int(fits.tree[k]), int(one), np.unique(column[mine]), grown.names, int(fits.tried[k])))
        at, node, column = at[keep], node[keep], column[keep]
    a, b = left[at] * weight, (total[at] - left[at]) * weight
    score = np.round(_impurity(a, fits.entropy[k]) + _impurity(b, fits.entropy[k]), 9)
    order = np.lexsort((bin_[at], column, score, node))
    best = order[np.append(True, np.diff(node[order]) > 0)] if len(order) else order
    cut = [(grown.high[j][bin_[i]] + grown.low[j][bin_[i + 1]]) / 2 for i, j in zip(at[best], column[best])]
    return np.column_stack([node[best], column[best], np.array(cut, float), a[best], b[best]]), whole


_SPLITS = "model_id BIGINT, fit BIGINT, splits ARRAY<DOUBLE>"


def _best(sent, level: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        model, k = key[0].as_py(), key[1].as_py()
        flat = [pc.list_flatten(rows.column(c)).to_numpy() for c in ("keys", "mass")]
        splits, whole = node_splits(model, sent.value[model], k, level, *_added([flat]))
        out = np.concatenate([whole, splits.ravel()])
        return pa.table({"model_id": pa.array([model], pa.int64()), "fit": pa.array([k], pa.int64()), "splits": pa.array([out], pa.list_(pa.float64()))})

    return run


def grow(data: DataFrame, models: dict[int, Grown], depth: int) -> dict[int, Grown]:
    """All fits of ``models`` grown to ``depth``, or as far as any node can be split."""
    context, data = data.sparkSession.sparkContext, data.filter(F.col("model_id").isin(list(models)))
    for level in range(depth):
        sent = context.broadcast(models)
        histograms = data.mapInArrow(_histograms(sent, level), "model_id BIGINT, fit BIGINT, keys ARRAY<BIGINT>, mass ARRAY<DOUBLE>")
        found = histograms.groupBy("model_id", "fit").applyInArrow(_best(sent, level), _SPLITS).collect()
        sent.unpersist()
        for r in found:
            fits, k, flat = models[r["model_id"]].fits, r["fit"], np.array(r["splits"])
            if level == 0:
                fits.mass[k, 1] = flat[:2]
            splits = flat[2:].reshape(-1, 7)
            node = splits[:, 0].astype(np.int64)
            fits.feature[k, node], fits.cut[k, node] = splits[:, 1], splits[:, 2]
            fits.mass[k, 2 * node], fits.mass[k, 2 * node + 1] = splits[:, 3:5], splits[:, 5:7]
        if all(len(r["splits"]) == 2 for r in found):
            break
    return models


# ---- growth over packed samples --------------------------------------------------------------------------
#
# Bins of a model's sample are a byte a value, so the sample is small whatever the number of features' digits. Pieces of it
# meet by model, and a model's fits are grown there, one after another: no counts of nodes are shuffled.

_ENDS = "place INT, part INT, model ARRAY<BIGINT>, bin ARRAY<BIGINT>, low ARRAY<DOUBLE>, high ARRAY<DOUBLE>"


def packed_bins(rows: Packed) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Lowest and highest values of the bins of each model's features, in their order."""
    splits, chosen, base = rows.splits, rows.chosen, rows.base
    parts = max(map(len, splits)) + 1

    def count(model: int, y: np.ndarray, tests: np.ndarray, x: np.ndarray) -> np.ndarray:
        p = x.shape[1]
        return np.bincount((packed.parts_of(x, [splits[j] for j in chosen[model]]) + np.arange(p) * parts).ravel(), minlength=p * parts).astype(float)

    counts = {m: n.reshape(-1, parts) for m, n in packed.collected(rows, count).items()}
    below = {m: (n.cumsum(axis=1) - n, n.sum(axis=1)) for m, n in counts.items()}
    sent = rows.windows.sparkSession.sparkContext.broadcast(below)

    def run(key: tuple, part: pa.Table) -> pa.Table:
        column, number = key[0].as_py(), key[1].as_py()
        value, y, on, starts = packed._ordered(part)
        value, out = value[starts], []
        for some, n0, n1 in packed._class_runs(y, on, starts):
            for i, t in enumerate((n0 + n1).T):
                model = base + some.start + i
                at = np.flatnonzero(t)
                if not len(at) or model not in chosen or column not in chosen[model]:
                    continue
                j = np.searchsorted(chosen[model], column)
                under, n = sent.value[model]
                bin_ = BINS * (int(under[j, number]) + np.cumsum(t[at]) - t[at]) // int(n[j])
                first = packed.starts_of(bin_.astype(float))
                last = np.append(first[1:], len(bin_)) - 1
                out.append((np.full(len(first), model), bin_[first], value[at][first], value[at][last]))
        lists = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)]
        names, kinds = ("model", "bin", "low", "high"), (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({"place": pa.array([column], pa.int32()), "part": pa.array([number], pa.int32())} | {n: pa.array([c], pa.list_(k)) for n, c, k in zip(names, lists, kinds)})

    found = place(packed.dealt_values(rows), "place", "part").groupBy("place", "part").applyInArrow(run, _ENDS).toArrow()
    sent.unpersist()
    flat = {c: pc.list_flatten(found.column(c)).to_numpy() for c in ("model", "bin", "low", "high")}
    sizes = pc.list_value_length(found.column("model")).to_numpy()
    column, part = (np.repeat(found.column(c).to_numpy(), sizes) for c in ("place", "part"))
    order = np.lexsort((part, flat["bin"], column, flat["model"]))
    column, (model, bin_, low, high) = column[order], (flat[c][order] for c in ("model", "bin", "low", "high"))
    first = packed.starts_of(bin_.astype(float), column, model)  # a bin may reach over ranges
    last = np.append(first[1:], len(bin_)) - 1
    out: dict[int, list] = {}
    group = packed.starts_of(column[first].astype(float), model[first])
    for a, b in zip(group, [*group[1:], len(first)]):
        out.setdefault(int(model[first[a]]), []).append((low[first[a:b]], high[last[a:b]]))
    return out


_PIECES = "model_id BIGINT, codes BINARY, label BINARY, tests BINARY, digest BINARY"


def packed_samples(rows: Packed, block: dict[int, Grown], digests: bool) -> DataFrame:
    """Pieces of the samples of some models: bins of the features, labels, fold bits and, if wanted, digests for bootstraps as bytes."""
    read, base, chosen = packed.batches(rows._replace(windows=None)), rows.base, rows.chosen
    sent = rows.windows.sparkSession.sparkContext.broadcast({m: g.low for m, g in block.items()})

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in read(found):
            keys = [f"{s}:{w}" for s, w in zip(*(batch.column(c).to_pylist() for c in ("station", "win_end")))] if digests else []
            for model, low in sent.value.items():
                r = np.flatnonzero(b.on[:, model - base])
                if not len(r):
                    continue
                codes = np.stack([np.searchsorted(ends, b.x[r, j], side="right") - 1 for j, ends in zip(chosen[model], low)], axis=1)
                digest = [int.from_bytes(hashlib.md5(f"{model}:{keys[i]}".encode()).digest()[:4], "big") % PRIME for i in r] if digests else []
                data = codes.astype(np.uint8), b.y[r], np.packbits(b.tests[r, :, model - base], axis=1, bitorder="little"), np.array(digest, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([model], pa.int64()), *(pa.array([d.tobytes()], pa.binary()) for d in data)], ["model_id", "codes", "label", "tests", "digest"])

    parts = int(rows.windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.windows.mapInArrow(run, _PIECES).repartition(max(parts, 2 * len(block)), "model_id")


def _grown_fit(model: int, grown: Grown, k: int, depth: int, cells: np.ndarray, codes: np.ndarray, r: np.ndarray, weight: np.ndarray | None) -> None:
    """Grows a fit from its rows ``r``. ``cells`` has the number of (feature, bin, class) of each value."""
    fits, p = grown.fits, codes.shape[1]
    node, span, step = np.ones(len(r), np.int64), p * BINS * 2, max(1, HELD // p)
    bin_of = np.zeros(fits.feature.shape[1], np.int64)
    for level in range(depth):
        nodes = 1 << level
        sums = np.zeros(nodes * span)
        for a in range(0, len(r), step):
            some = slice(a, a + step)
            cell = cells[r[some]] + ((node[some] - nodes) * span)[:, None].astype(cells.dtype)
            sums += np.bincount(cell.ravel(), None if weight is None else np.repeat(weight[some], p), len(sums))
        keys = np.flatnonzero(sums)
        if not len(keys):
            return
        splits, whole = node_splits(model, grown, k, level, keys, sums[keys])
        if level == 0:
            fits.mass[k, 1] = whole
        at = splits[:, 0].astype(np.int64)
        fits.feature[k, at], fits.cut[k, at] = splits[:, 1], splits[:, 2]
        fits.mass[k, 2 * at], fits.mass[k, 2 * at + 1] = splits[:, 3:5], splits[:, 5:7]
        if not len(at) or level == depth - 1:
            return
        for i, j, cut in zip(at, splits[:, 1].astype(int), splits[:, 2]):
            bin_of[i] = np.searchsorted(grown.high[j], cut, side="right") - 1  # rows that are learnt from lie in no bin between
        feature = fits.feature[k][node]
        on = feature >= 0
        r, node, weight = r[on], node[on], None if weight is None else weight[on]
        node = 2 * node + (codes[r, feature[on]] > bin_of[node])


_FITS = "model_id BIGINT, feature BINARY, cut BINARY, mass BINARY"


def grow_samples(pieces: DataFrame, models: dict[int, Grown], folds: int, depth: int) -> dict[int, Grown]:
    """All fits of ``models`` grown to ``depth``; a model's pieces, some thirty bytes a row, meet in one task."""
    sent = pieces.sparkSession.sparkContext.broadcast(models)
    wide = -(-folds // 8)

    def run(key: tuple, part: pa.Table) -> pa.Table:
        model = key[0].as_py()
        grown = sent.value[model]
        fits, p = grown.fits, len(grown.names)
        whole = lambda c, kind: np.frombuffer(b"".join(part.column(c).to_pylist()), kind)
        codes, y, digest = whole("codes", np.uint8).reshape(-1, p), whole("label", np.uint8), whole("digest", np.int32).astype(np.int64)
        tests = np.unpackbits(whole("tests", np.uint8).reshape(len(y), wide), axis=1, bitorder="little") if folds else None
        cells = (np.arange(p, dtype=np.int32) * BINS + codes) * 2 + y[:, None]
        if (1 << depth) * p * BINS * 2 > 2**31 - 1:
            cells = cells.astype(np.int64)
        for k, (fold, tree) in enumerate(zip(fits.fold.tolist(), fits.tree.tolist())):
            learns = np.ones(len(y), bool) if fold == ALL else tests[:, fold] == 0
            weight = None if tree == PLAIN else copies(digest, tree)
            r = np.flatnonzero(learns if weight is None else learns & (weight > 0))
            _grown_fit(model, grown, k, depth, cells, codes, r, None if weight is None else weight[r])
        data = [pa.array([a.tobytes()], pa.binary()) for a in (fits.feature, fits.cut, fits.mass)]
        return pa.table({"model_id": pa.array([model], pa.int64())} | dict(zip(("feature", "cut", "mass"), data)))

    for r in pieces.groupBy("model_id").applyInArrow(run, _FITS).collect():
        fits = models[r["model_id"]].fits
        for name in ("feature", "cut", "mass"):
            held = getattr(fits, name)
            held[...] = np.frombuffer(r[name], held.dtype).reshape(held.shape)
    sent.unpersist()
    return models


def _tested_windows(rows: Packed, block: dict[int, Grown], points: list[Point], kinds: dict[int, list]) -> dict[int, np.ndarray]:
    """What ``_tested`` counts, from packed samples."""
    sent = rows.windows.sparkSession.sparkContext.broadcast(block)
    depths = sorted({q.depth for q in points})

    def run(model: int, y: np.ndarray, tests: np.ndarray, x: np.ndarray) -> np.ndarray:
        fits, out = sent.value[model].fits, np.zeros((tests.shape[1], len(points), 4))
        for fold in range(tests.shape[1]):
            mine = tests[:, fold]
            out[fold] = _right_ones(fits, fold, points, kinds[model], depths, y[mine], x[mine])
        return out.ravel()

    found = packed.collected(rows._replace(chosen={m: rows.chosen[m] for m in block}), run)
    sent.unpersist()
    return found


# ---- grid search -----------------------------------------------------------------------------------------


def _shares(fits: Fits, k: np.ndarray, x: np.ndarray, depths: list[int]) -> dict[int, np.ndarray]:
    """Share of the upper class where each row ends up, by depth of the trees: arrays ``[fit, row]``."""
    mass = fits.mass[k]
    with np.errstate(invalid="ignore"):
        share = mass[:, :, 1] / mass.sum(axis=2)
    out, at = {}, np.ones((len(k), len(x)), np.int64)
    for level in range(max(depths) + 1):
        if level in depths:
            out[level] = np.take_along_axis(share, at, 1)
        if level < max(depths):
            child = _step(fits, k, at, x)
            at = np.where(child > 0, child, at)
    return out


def votes_of(shares: np.ndarray) -> np.ndarray:
    """Votes of a forest from its trees' shares ``[tree, row]``."""
    return np.round(shares.mean(axis=0), 9) > 0.5


class Point(NamedTuple):
    entropy: bool
    rule: str | None
    depth: int
    trees: int


def _points(points: list[dict], code: str) -> list[Point]:
    known = {"max_depth", "criterion", "max_features"} | ({"n_estimators"} if code == "RF" else set())
    for p in points:
        if set(p) - known or p["criterion"] not in ("gini", "entropy"):
            raise ValueError(f"{code} does not know the grid point {p}")
    return [Point(p["criterion"] == "entropy", p["max_features"], p["max_depth"], p.get("n_estimators", 1)) for p in points]


def _planned(points: list[Point], p: int, folds: list[int], code: str) -> tuple[Fits, list[tuple[bool, int]]]:
    """A model's fits with no split yet, and the criterion and feature number of each point."""
    kinds = [(q.entropy, min(p, feature_count(q.rule, p) or p)) for q in points]
    most = {kind: max(q.trees for q, own in zip(points, kinds) if own == kind) for kind in kinds}
    numbers = {kind: range(n) if code == "RF" else [PLAIN] for kind, n in most.items()}
    table = [(fold, *kind, tree) for fold in folds for kind in most for tree in numbers[kind]]
    fold, entropy, tried, tree = (np.array(c) for c in zip(*table))
    heap = 2 << max(q.depth for q in points)
    n = len(table)
    return Fits(fold, entropy, tried, tree, np.full((n, heap), -1, np.int16), np.zeros((n, heap)), np.zeros((n, heap, 2))), kinds


def _chosen(fits: Fits, fold: int, kind: tuple[bool, int], trees: int) -> np.ndarray:
    """Numbers of the fits of a point in a fold, its first trees."""
    mine = (fits.fold == fold) & (fits.entropy == kind[0]) & (fits.tried == kind[1])
    return np.flatnonzero(mine & (fits.tree < trees))


def _tested(sent, points: list[Point], kinds: dict[int, list], folds: int):
    """Rows of each fold's test part by point: of the lower class, right ones among them, of the upper class, right ones."""
    depths = sorted({q.depth for q in points})

    def run(model: int, y: np.ndarray, bits: np.ndarray, x: np.ndarray) -> np.ndarray | None:
        if model not in sent.value:
            return None
        fits, y, x = sent.value[model].fits, y > 0, x[:, :-2]
        out = np.zeros((folds, len(points), 4))
        for fold in range(folds):
            tests = _in_fold(bits, fold)
            out[fold] = _right_ones(fits, fold, points, kinds[model], depths, y[tests], x[tests])
        return out.ravel()

    return run


def _right_ones(fits: Fits, fold: int, points: list[Point], kinds: list, depths: list[int], y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """By point: rows of the lower class, right ones among them, of the upper class, right ones."""
    out = np.zeros((len(points), 4))
    for kind in dict.fromkeys(kinds):
        shares = _shares(fits, _chosen(fits, fold, kind, max(q.trees for q in points)), x, depths)
        for i, q in enumerate(points):
            if kinds[i] == kind:
                right = votes_of(shares[q.depth][: q.trees]) == y
                out[i] = (~y).sum(), right[~y].sum(), y.sum(), right[y].sum()
    return out


def _class_counts(data: DataFrame, folds: int) -> dict[int, np.ndarray]:
    """Rows of both classes that each fold learns from; the last entry is for all rows."""

    def count(model: int, y: np.ndarray, bits: np.ndarray, x: np.ndarray) -> np.ndarray:
        learns = [~_in_fold(bits, f) for f in [*range(folds), ALL]]
        return np.array([(on.astype(float) @ (y < 0), on.astype(float) @ (y > 0)) for on in learns]).ravel()

    return {m: s.reshape(-1, 2) for m, s in _collected(data, count, lambda m, s: s).items()}


def _balanced(tested: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Balanced accuracies ``[fold, point]``; none where a fold learns from one class only or tests on no row."""
    n0, r0, n1, r1 = np.moveaxis(tested, -1, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        low, high = r0 / n0, r1 / n1
    score = (np.where(n0 > 0, low, high) + np.where(n1 > 0, high, low)) / 2
    score[~counts[:-1].all(axis=1)] = np.nan
    return score


def _table(model: int, grown: Grown, k: np.ndarray, depth: int) -> pa.Table:
    """Trees ``k`` of a model as rows of ``FITTED``, cut off at ``depth``. Nodes without a feature are leaves."""
    fits, heap = grown.fits, 2 << depth
    tree, node = np.nonzero(fits.mass[k, :heap].sum(axis=2) > 0)
    split = (fits.feature[k[tree], node] >= 0) & (node < heap // 2)
    mass = fits.mass[k[tree], node]
    names = np.array([*grown.names, None], object)[np.where(split, fits.feature[k[tree], node], -1)]
    return pa.table({
        "model_id": pa.array(np.full(len(node), model), pa.int64()), "tree": pa.array(tree, pa.int32()), "node": pa.array(node, pa.int64()),
        "feature": pa.array(names, pa.string()), "threshold": pa.array(fits.cut[k[tree], node], mask=~split),
        "share": pa.array(mass[:, 1] / mass.sum(axis=1)),
    })


def search_forests(rows: DataFrame | Packed, folded: DataFrame, points: list[dict], code: str = "DT") -> tuple[DataFrame, DataFrame]:
    """The trees (``DT``) or forests (``RF``) of best mean balanced accuracy over folds, grown from whole samples (``FITTED``, a row per
    node), and the score of every model, point and fold (``SEARCHED``). A fold that learns from one class only cannot be fitted: its
    score is null and points count without it. Of equal points the first in the grid holds; a model of one class is an error.

    ``rows`` are the long training rows, every window with a value of each of its model's features, or packed samples; ``folded`` is
    ``model_id, station, win_end, fold, test``. With a single point there is no search and ``SEARCHED`` is empty.
    """
    grid, depth = _points(points, code), max(p["max_depth"] for p in points)
    if isinstance(rows, Packed):
        spark = rows.windows.sparkSession
        if not rows.chosen:
            return spark.createDataFrame([], FITTED), spark.createDataFrame([], SEARCHED)
        rows = packed.with_folds(rows, folded) if len(grid) > 1 else rows
        folds, counts, names = rows.folds, packed.class_counts(rows), {m: [rows.names[j] for j in c] for m, c in rows.chosen.items()}
        _two_classes(counts)
        ends = packed_bins(rows)

        def grown(block: dict[int, Grown]) -> dict[int, np.ndarray]:
            grow_samples(packed_samples(rows, block, code == "RF"), block, folds, depth)
            return _tested_windows(rows, block, grid, {m: kinds[m] for m in block}) if folds else {}

    else:
        spark, ends, names = rows.sparkSession, {}, {}
        for r in bins(rows).orderBy("model_id", "feature").collect():  # models times features times bins
            ends.setdefault(r["model_id"], []).append(tuple(np.array([b[end] for b in r["bins"]]) for end in ("low", "high")))
            names.setdefault(r["model_id"], []).append(r["feature"])
        if not ends:
            return spark.createDataFrame([], FITTED), spark.createDataFrame([], SEARCHED)
        folds = int(folded.agg(F.max("fold")).first()[0]) + 1 if len(grid) > 1 else 0
        data = cut_lineage(vectors(rows, folded))
        counts = _class_counts(data, folds)
        _two_classes(counts)

        def grown(block: dict[int, Grown]) -> dict[int, np.ndarray]:
            grow(data, block, depth)
            if not folds:
                return {}
            sent = spark.sparkContext.broadcast(block)
            mine = data.filter(F.col("model_id").isin(list(block)))
            tested = _collected(mine, _tested(sent, grid, {m: kinds[m] for m in block}, folds), lambda m, s: s)
            sent.unpersist()
            return tested

    fitted, searched, block = [], [], {}

    def finish(block: dict[int, Grown]) -> None:
        tested = grown(block)
        for model, own in block.items():
            best = 0
            if folds:
                score = _balanced(tested[model].reshape(folds, len(grid), 4), counts[model])
                known = ~np.isnan(score)
                best = int(np.argmax(np.round(np.where(known, score, 0).sum(axis=0) / np.maximum(known.sum(axis=0), 1), 12)))
                searched.extend(
                    (model, i, f, float(score[f, i]) if known[f, i] else None) for f in range(folds) for i in range(len(grid))
                )
            fitted.append(_table(model, own, _chosen(own.fits, ALL, kinds[model][best], grid[best].trees), grid[best].depth))

    kinds: dict[int, list] = {}
    held = 0
    for model, own in sorted(ends.items()):
        usable = [f for f in range(folds) if counts[model][f].all()] + [ALL]
        fits, kinds[model] = _planned(grid, len(own), usable, code)
        if block and held + len(fits.fold) > MAX_FITS:
            finish(block)
            block, held = {}, 0
        block[model] = Grown(names[model], [low for low, _ in own], [high for _, high in own], counts[model], fits)
        held += len(fits.fold)
    finish(block)
    return spark.createDataFrame(pa.concat_tables(fitted), FITTED), spark.createDataFrame(searched, SEARCHED)


def _two_classes(counts: dict[int, np.ndarray]) -> None:
    for model, n in sorted(counts.items()):
        if not n[ALL].all():
            raise ValueError(f"the sample of model {model} has one class only")


# ---- votes -----------------------------------------------------------------------------------------------


def _loaded(fitted: DataFrame) -> tuple[list[str], dict[int, tuple[np.ndarray, Fits, int]]]:
    """Feature names in use, and by model the places of its features and its trees. A row per node comes to the driver."""
    rows = fitted.orderBy("model_id", "tree", "node").toArrow()
    names = sorted(set(rows.column("feature").to_pylist()) - {None})
    place = {n: j for j, n in enumerate(names)} | {None: -1}
    model, tree, node, cut, share = (rows.column(c).to_numpy() for c in ("model_id", "tree", "node", "threshold", "share"))
    feature = np.array([place[n] for n in rows.column("feature").to_pylist()], np.int64)
    out = {}
    for m in np.unique(model):
        on = model == m
        n, heap = int(tree[on].max()) + 1, int(node[on].max()) + 1
        fits = Fits(*[np.zeros(n, int)] * 4, np.full((n, heap), -1), np.zeros((n, heap)), np.zeros((n, heap, 2)))
        at = tree[on], node[on]
        fits.feature[at], fits.cut[at] = feature[on], np.nan_to_num(cut[on])
        fits.mass[at] = np.column_stack([1 - share[on], share[on]])
        out[int(m)] = np.unique(feature[on][feature[on] >= 0]), fits, (heap - 1).bit_length() - 1
    return names, out


def forest_votes(features: DataFrame | Vectors, fitted: DataFrame) -> DataFrame:
    """Votes ``model_id, station, win_end, pred`` of long features or vectors: the class of the larger share, averaged over a model's trees.

    A window's features are gathered once and meet all trees of all models there. A window that lacks a feature of a model's trees,
    or has no number there, has no vote of that model.
    """
    spark = fitted.sparkSession
    names, forests = _loaded(fitted)
    sent = spark.sparkContext.broadcast(forests)
    places = F.broadcast(spark.createDataFrame([(n, j) for j, n in enumerate(names)], "feature STRING, place INT"))
    width, every = len(names), features.names if isinstance(features, Vectors) else None
    known = features.windows if every is not None else features.select("station", "win_end", "feature", "value").join(places, "feature", "left").groupBy("station", "win_end").agg(
        F.collect_list(F.when(F.col("place").isNotNull() & F.col("value").isNotNull(), F.struct("place", "value"))).alias("x")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.full((batch.num_rows, width), np.nan)
            if every is not None:
                held = packed.matrix(batch, len(every))
                for j, name in enumerate(names):
                    if name in every:
                        x[:, j] = held[:, every.index(name)]
            else:
                pairs = batch.column("x")
                row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(pairs).to_numpy())
                flat = pc.list_flatten(pairs)
                x[row, flat.field("place").to_numpy()] = flat.field("value").to_numpy(zero_copy_only=False)
            for model, (used, fits, depth) in sent.value.items():
                on = np.flatnonzero(~np.isnan(x[:, used]).any(axis=1))
                if width:
                    shares = _shares(fits, np.arange(len(fits.fold)), np.nan_to_num(x[on]), [depth])[depth]
                else:
                    shares = np.repeat(fits.mass[:, 1, 1:], len(on), axis=1)
                keys = batch.take(pa.array(on)).select(["station", "win_end"]).columns
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(on), model)), *keys, pa.array(votes_of(shares).astype(float))], ["model_id", "station", "win_end", "pred"]
                )

    return known.mapInArrow(run, "model_id BIGINT, station BIGINT, win_end BIGINT, pred DOUBLE")
