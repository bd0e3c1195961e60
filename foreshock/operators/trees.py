"""Decision trees grown level by level for a whole set of models in one job.

A model's tree is a set of rows, and so is the set of all models: each level ranks the values of every
(model, node, feature), picks the best split of every node, and moves samples to child nodes. Nodes are
numbered like a heap (root 1, children 2i and 2i+1). The finished tree is a rule table, one row per leaf and
feature, so that prediction is one join with long features.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreshock.operators import packed
from foreshock.operators.chunks import place
from foreshock.operators.packed import Packed, Vectors
from foreshock.operators.ranking import class_ranks, value_splits
from foreshock.sources.tables import cut_lineage

NODE = ("model_id", "node")


def balanced_weights(rows: DataFrame) -> DataFrame:
    """Class weights per model, from its distinct windows: ``model_id, w0, w1``."""
    counts = rows.select("model_id", "station", "win_end", "label").distinct().groupBy("model_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") <= 0).alias("c0"), F.count_if(F.col("label") > 0).alias("c1")
    )
    return counts.selectExpr("model_id", "try_divide(n, 2 * c0) AS w0", "try_divide(n, 2 * c1) AS w1")


def _impurity(criterion: str, a: str, b: str) -> str:
    """Impurity of a side with class masses a and b, times its mass."""
    if criterion == "gini":
        return f"(2 * {a} * {b} / ({a} + {b}))"
    part = "CASE WHEN {v} > 0 THEN -{v} * log2({v} / ({a} + {b})) ELSE 0D END"
    return f"({part.format(v=a, a=a, b=b)} + {part.format(v=b, a=a, b=b)})"


def split_scores(ranked: DataFrame, weights: DataFrame, criterion: str = "gini") -> DataFrame:
    """Every possible split ``value <= v`` of each node with its score (smaller is better)."""
    totals = (
        ranked.groupBy(*NODE, "feature")
        .agg(F.max(F.col("below0") + F.col("n0")).alias("c0"), F.max(F.col("below1") + F.col("n1")).alias("c1"))
        .groupBy(*NODE)
        .agg(F.max("c0").alias("c0"), F.max("c1").alias("c1"))
    )
    sides = (
        ranked.join(F.broadcast(totals.join(weights, "model_id")), list(NODE))  # one row per node
        .selectExpr(*NODE, "feature", "value", "c0", "c1", "w0", "w1", "below0 + n0 AS l0", "below1 + n1 AS l1")
        .filter("l0 + l1 < c0 + c1 AND c0 > 0 AND c1 > 0")
        .selectExpr(
            "*", "l0 * w0 AS a0", "l1 * w1 AS a1", "(c0 - l0) * w0 AS b0", "(c1 - l1) * w1 AS b1"
        )
    )
    score = f"round({_impurity(criterion, 'a0', 'a1')} + {_impurity(criterion, 'b0', 'b1')}, 9)"
    return sides.selectExpr(*NODE, "feature", "value", "a0", "a1", "b0", "b1", f"{score} AS score")


def _some_features(scores: DataFrame, count: int) -> DataFrame:
    """A random choice of features per node. The window is over a node's features, a few dozen rows."""
    digest = F.md5(F.concat_ws(":", *NODE, "feature"))
    order = Window.partitionBy(*NODE).orderBy("digest")
    names = scores.select(*NODE, "feature").distinct().withColumn("digest", digest)
    kept = names.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= count)
    return scores.join(kept.select(*NODE, "feature"), [*NODE, "feature"], "left_semi")


def best_splits(
    ranked: DataFrame, weights: DataFrame, criterion: str = "gini", max_features: int | None = None
) -> DataFrame:
    """Best split per node: ``feature, threshold`` half way to the next value, and the votes of both sides."""
    scores = split_scores(ranked, weights, criterion)
    if max_features:
        scores = _some_features(scores, max_features)
    best = scores.groupBy(*NODE).agg(
        F.min(F.struct("score", "feature", "value", "a0", "a1", "b0", "b1")).alias("s")
    ).select(*NODE, "s.*")
    following = (
        ranked.select(*NODE, "feature", F.col("value").alias("v"))
        .join(F.broadcast(best.select(*NODE, "feature", "value")), [*NODE, "feature"])
        .filter("v > value")
        .groupBy(*NODE)
        .agg(F.min("v").alias("above"))
    )
    return best.join(following, list(NODE)).selectExpr(
        *NODE,
        "feature",
        "(value + above) / 2 AS threshold",
        "CAST(a1 > a0 AS DOUBLE) AS left_vote",
        "CAST(b1 > b0 AS DOUBLE) AS right_vote",
    )


def grow_stumps(rows: DataFrame, criterion: str = "gini") -> DataFrame:
    """Trees of depth one: ``model_id, feature, threshold, left_vote, right_vote``.

    ``rows`` are the long training rows ``model_id, station, win_end, label, feature, value``.
    """
    rooted = rows.withColumn("node", F.lit(1).cast("bigint"))
    ranked = class_ranks(rooted, value_splits(rows), NODE)
    return best_splits(ranked, balanced_weights(rows), criterion).drop("node")


def stumps_from_ranks(ranked: DataFrame, selected: DataFrame, weights: DataFrame, criterion: str = "gini") -> DataFrame:
    """The same from values already ranked for the significance test, limited to each model's features.

    ``weights`` are rows ``model_id, label, weight``.
    """
    sides = weights.groupBy("model_id").agg(
        F.max(F.when(F.col("label") <= 0, F.col("weight"))).alias("w0"),
        F.max(F.when(F.col("label") > 0, F.col("weight"))).alias("w1"),
    )
    kept = ranked.join(F.broadcast(selected.select("model_id", "feature")), ["model_id", "feature"], "left_semi")
    return best_splits(kept.withColumn("node", F.lit(1).cast("bigint")), sides, criterion).drop("node")


def stump_rules(stumps: DataFrame) -> DataFrame:
    return stumps.selectExpr(
        "model_id",
        "inline(array(named_struct('leaf', 2L, 'vote', left_vote, 'lo', CAST('-Infinity' AS DOUBLE), 'hi', threshold),"
        " named_struct('leaf', 3L, 'vote', right_vote, 'lo', threshold, 'hi', CAST('Infinity' AS DOUBLE))))",
        "feature",
        "1L AS n_terms",
    ).select("model_id", "leaf", "vote", "feature", "lo", "hi", "n_terms")


def grow_trees(
    rows: DataFrame | Packed, depth: int = 3, criterion: str = "gini", max_features: int | None = None
) -> DataFrame:
    """Rule table of one tree per model: ``model_id, leaf, vote, feature, lo, hi, n_terms``.

    Each level is one pass over the samples of nodes that can still be split; two over packed samples.
    """
    if isinstance(rows, Packed):
        return tree_rules(grow_packed(rows, depth, criterion, max_features), depth)
    splits, weights = cut_lineage(value_splits(rows)), cut_lineage(balanced_weights(rows))
    state = cut_lineage(
        rows.select("model_id", "station", "win_end", "label", "feature", "value").withColumn("node", F.lit(1).cast("bigint"))
    )
    levels: list[DataFrame] = []
    for _ in range(depth):
        found = cut_lineage(best_splits(class_ranks(state, splits, NODE), weights, criterion, max_features))
        if found.isEmpty():
            break
        levels.append(found)
        moved = (
            state.join(found.select(*NODE, "feature", "threshold"), [*NODE, "feature"])
            .selectExpr("model_id", "station", "win_end", "node * 2 + CAST(value > threshold AS BIGINT) AS child")
        )
        state = cut_lineage(
            state.join(moved, ["model_id", "station", "win_end"]).withColumn("node", F.col("child")).drop("child")
        )
    if not levels:
        raise ValueError("no feature separates the classes of any model")
    nodes = levels[0]
    for found in levels[1:]:
        nodes = nodes.unionByName(found)
    return tree_rules(cut_lineage(nodes), depth)


# ---- growth over packed samples ---------------------------------------------------------------------------
#
# A first pass counts classes by (node, feature, range of values), which tells what lies below each range and which features a node can
# be split by. A second deals the values of the features that nodes try to their ranges, where every cut between neighbouring
# values is scored; cuts between ranges are scored from the ranges' ends. No model's sample and no node meets in one task.


def _heap_nodes(found: np.ndarray, level: int, x: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Nodes of a level that the rows of ``x`` are in, 0 where a path has ended. ``found`` has place and cut of each node."""
    node = np.ones(len(x), np.int64)
    column = np.full(len(found), -1)
    split = found[:, 0] >= 0
    column[split] = np.searchsorted(columns, found[split, 0])
    for _ in range(level):
        j = column[node]
        right = x[np.arange(len(x)), np.maximum(j, 0)] > found[node, 1]
        node = np.where((j >= 0) & (node > 0), 2 * node + right, 0)
    return node


def _range_counts(rows: Packed, found: dict[int, np.ndarray], level: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By model, class counts ``[node, feature, range, class]`` and whether a feature has two values in a node ``[node, feature]``."""
    nodes, chosen, splits = 1 << level, rows.chosen, rows.splits
    parts = max(map(len, splits)) + 1

    def count(model: int, y: np.ndarray, tests: np.ndarray, x: np.ndarray) -> np.ndarray:
        columns, p = chosen[model], x.shape[1]
        node = _heap_nodes(found[model], level, x, columns)
        r = np.flatnonzero(node)
        at = (node[r] - nodes)[:, None] * p + np.arange(p)
        cell = (at * parts + packed.parts_of(x[r], [splits[j] for j in columns])) * 2 + y[r][:, None]
        sums = np.bincount(cell.ravel(), minlength=nodes * p * parts * 2).astype(float)
        ends = np.full((2, nodes, p), np.inf)
        value = np.where(np.isnan(x), np.inf, x)
        for k in np.unique(node[r]):
            mine = value[node == k]
            ends[:, k - nodes] = mine.min(axis=0), (-mine).min(axis=0)
        return np.concatenate([sums, ends.ravel()])

    def merge(arrays: np.ndarray) -> np.ndarray:
        cut = arrays.shape[1] // (2 * parts + 2) * 2 * parts
        return np.concatenate([arrays[:, :cut].sum(axis=0), arrays[:, cut:].min(axis=0)])

    out = {}
    for model, flat in packed.collected(rows, count, merge=merge).items():
        p = len(chosen[model])
        counts, ends = np.split(flat, [nodes * p * parts * 2])
        low, high = ends.reshape(2, nodes, p)
        out[model] = counts.reshape(nodes, p, parts, 2), (low < -high) & np.isfinite(low)
    return out


class Level(NamedTuple):
    """What tasks know of a model at a level: its nodes so far, the features each node tries (-1 for none), class counts of each
    node, those below each range ``[node, feature, range, class]`` and the weights of the classes."""

    found: np.ndarray
    tried: np.ndarray
    total: np.ndarray
    below: np.ndarray
    weight: np.ndarray


def _level(model: int, rows: Packed, found: np.ndarray, level: int, counts: np.ndarray, able: np.ndarray, weight: np.ndarray, most: int | None) -> Level | None:
    nodes, columns = 1 << level, rows.chosen[model]
    total = counts[:, 0].sum(axis=1)
    tried = np.full((nodes, min(most or len(columns), len(columns))), -1)
    for k in np.flatnonzero((total > 0).all(axis=1)):
        key = lambda j: hashlib.md5(f"{model}:{nodes + k}:{rows.names[columns[j]]}".encode()).hexdigest()  # noqa: E731, B023
        some = sorted(np.flatnonzero(able[k]), key=key)[: tried.shape[1]]
        tried[k, : len(some)] = some
    return Level(found, tried, total, counts.cumsum(axis=2) - counts, weight) if (tried >= 0).any() else None


_DEALT = "place INT, part INT, node ARRAY<BIGINT>, value ARRAY<DOUBLE>, label ARRAY<BOOLEAN>"
_CUTS = "place INT, part INT, cuts ARRAY<DOUBLE>"


def _deal(rows: Packed, sent, level: int):
    """Values of the features that nodes try, one row for each feature and range in a batch. Nodes of all models are numbered on."""
    read, base, chosen, splits, nodes = packed.batches(rows._replace(windows=None)), rows.base, rows.chosen, rows.splits, 1 << level

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in read(found):
            parts = packed.parts_of(b.x, splits)
            held = []
            for number, (model, known) in enumerate(sent.value.items()):
                r = np.flatnonzero(b.on[:, model - base])
                node = _heap_nodes(known.found, level, b.x[r[:, None], chosen[model]], chosen[model])
                r, node = r[node > 0], node[node > 0] - nodes
                i, t = np.nonzero(known.tried[node] >= 0)
                r, node = r[i], node[i]
                column = chosen[model][known.tried[node, t]]
                held.append((column, parts[r, column], number * nodes + node, b.x[r, column], b.y[r]))
            column, part, node, value, y = (np.concatenate(c) for c in zip(*held))
            cell = column * (max(map(len, splits)) + 1) + part
            order = np.argsort(cell, kind="stable")
            first = packed.starts_of(cell[order].astype(float))
            ends = pa.array(np.append(first, len(cell)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in (node, value, y)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[order][first], pa.int32()) for c in (column, part)), *lists], ["place", "part", "node", "value", "label"]
            )

    return run


def _score(a: np.ndarray, b: np.ndarray, entropy: bool) -> np.ndarray:
    """Impurity of both sides of cuts, ``a`` and ``b`` being their class masses, times their masses."""
    sides = []
    for m in (a, b):
        if entropy:
            with np.errstate(divide="ignore", invalid="ignore"):
                sides.append(np.where(m > 0, -m * np.log2(m / m.sum(axis=1)[:, None]), 0.0).sum(axis=1))
        else:
            sides.append(2 * m[:, 0] * m[:, 1] / (m[:, 0] + m[:, 1]))
    return np.round(sides[0] + sides[1], 9)


def _nodes_of(known: dict[int, Level], node: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class counts and class weights of numbered nodes."""
    total, weight = np.concatenate([k.total for k in known.values()]), np.stack([k.weight for k in known.values()])
    return total[node], weight[node // nodes]


def _cut(rows: Packed, sent, level: int, entropy: bool):
    """The best cut between values of a range, by node, with the range's ends and the counts up to them: rows ``node, first, last, n0,
    n1, score, value, above, l0, l1``."""
    chosen, nodes = rows.chosen, 1 << level

    def run(key: tuple, part: pa.Table) -> pa.Table:
        column, number = key[0].as_py(), key[1].as_py()
        node, value, y = (pc.list_flatten(part.column(c)).to_numpy() for c in ("node", "value", "label"))
        order = np.lexsort((value, node))
        node, value, y = node[order], value[order], y[order]
        starts = packed.starts_of(value, node)
        n = np.stack([np.add.reduceat((y == side).astype(float), starts) for side in (False, True)], axis=1)
        node, value = node[starts], value[starts]
        known, models = sent.value, list(sent.value)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        below = np.stack([
            known[m].below[k % nodes, np.searchsorted(chosen[m], column), number] for k in node[first] for m in [models[k // nodes]]
        ])
        size = np.diff(np.append(first, len(node)))
        upto = np.cumsum(n, axis=0)
        upto += np.repeat(below - (upto[first] - n[first]), size, axis=0)
        at = np.flatnonzero(np.append(node[1:] == node[:-1], False))
        total, weight = _nodes_of(known, node[at], nodes)
        score = _score(upto[at] * weight, (total - upto[at]) * weight, entropy)
        order = np.lexsort((value[at], score, node[at]))
        best = order[packed.starts_of(node[at][order].astype(float))]
        out = np.full((len(first), 10), np.nan)
        last = first + size - 1
        out[:, :5] = np.column_stack([node[first], value[first], value[last], upto[last]])
        out[np.searchsorted(node[first], node[at][best]), 5:] = np.column_stack([score[best], value[at][best], value[at[best] + 1], upto[at[best]]])
        return pa.table({"place": pa.array([column], pa.int32()), "part": pa.array([number], pa.int32()), "cuts": pa.array([out.ravel()], pa.list_(pa.float64()))})

    return run


def _best_cuts(cuts: pa.Table, known: dict[int, Level], level: int, entropy: bool) -> np.ndarray:
    """The best cut of each node from those within ranges and those between them: rows ``node, place, cut, votes left and right``."""
    nodes, found = 1 << level, [np.array(c.values).reshape(-1, 10) for c in cuts.column("cuts").combine_chunks()]
    sizes = [len(f) for f in found]
    column, part = (np.repeat(cuts.column(c).to_numpy(), sizes) for c in ("place", "part"))
    rows = np.concatenate(found)
    order = np.lexsort((part, column, rows[:, 0]))
    rows, column = rows[order], column[order]
    inner = ~np.isnan(rows[:, 5])
    same = np.flatnonzero((rows[1:, 0] == rows[:-1, 0]) & (column[1:] == column[:-1]))
    total, weight = _nodes_of(known, rows[same, 0].astype(int), nodes)
    between = _score(rows[same, 3:5] * weight, (total - rows[same, 3:5]) * weight, entropy)
    table = np.concatenate([
        np.column_stack([rows[inner, 0], column[inner], rows[inner, 5:]]),
        np.column_stack([rows[same, 0], column[same], between, rows[same, 2], rows[same + 1, 1], rows[same, 3:5]]),
    ])
    table = table[np.lexsort((table[:, 3], table[:, 1], table[:, 2], table[:, 0]))]
    table = table[packed.starts_of(table[:, 0])]
    total, weight = _nodes_of(known, table[:, 0].astype(int), nodes)
    a, b = table[:, 5:] * weight, (total - table[:, 5:]) * weight
    return np.column_stack([table[:, :2], (table[:, 3] + table[:, 4]) / 2, a[:, 1] > a[:, 0], b[:, 1] > b[:, 0]])


_NODES = "model_id BIGINT, node BIGINT, feature STRING, threshold DOUBLE, left_vote DOUBLE, right_vote DOUBLE"


def grow_packed(rows: Packed, depth: int, criterion: str, max_features: int | None) -> DataFrame:
    """Split nodes of one tree per model: ``model_id, node, feature, threshold, left_vote, right_vote``. By level, class counts of nodes, features
    and ranges come to the driver, whatever the number of windows."""
    spark = rows.windows.sparkSession
    found = {m: np.tile([-1.0, 0.0], (2 << depth, 1)) for m in rows.chosen}
    weights = {m: n[-1].sum() / (2 * np.maximum(n[-1], 1)) for m, n in packed.class_counts(rows).items()}
    out: list[tuple] = []
    for level in range(depth):
        if not rows.chosen:
            break
        counts = _range_counts(rows, found, level)
        levels = {m: _level(m, rows, found[m], level, *counts[m], weights[m], max_features) for m in counts}
        known = {m: k for m, k in sorted(levels.items()) if k is not None}
        if not known:
            break
        sent = spark.sparkContext.broadcast(known)
        dealt = place(rows.windows.mapInArrow(_deal(rows, sent, level), _DEALT), "place", "part").groupBy("place", "part")
        cuts = dealt.applyInArrow(_cut(rows, sent, level, criterion == "entropy"), _CUTS).toArrow()
        sent.unpersist()
        models = list(known)
        for node, column, cut, left, right in _best_cuts(cuts, known, level, criterion == "entropy"):
            model, number = models[int(node) >> level], (1 << level) + int(node) % (1 << level)
            found[model][number] = column, cut
            out.append((model, number, rows.names[int(column)], float(cut), float(left), float(right)))
    if not out:
        raise ValueError("no feature separates the classes of any model")
    return spark.createDataFrame(out, _NODES)


def tree_rules(nodes: DataFrame, depth: int) -> DataFrame:
    """Leaves as conjunctions of ranges ``lo < value <= hi``. A tree has at most ``2^depth`` leaves."""
    side = (
        "inline(array(named_struct('leaf', node * 2, 'vote', left_vote, 'lo', CAST('-Infinity' AS DOUBLE), 'hi', threshold),"
        " named_struct('leaf', node * 2 + 1, 'vote', right_vote, 'lo', threshold, 'hi', CAST('Infinity' AS DOUBLE))))"
    )
    edges = nodes.selectExpr("model_id", side, "feature")
    inner = nodes.selectExpr("model_id", "node AS leaf")
    leaves = edges.join(inner, ["model_id", "leaf"], "left_anti").select("model_id", "leaf", "vote")
    # A leaf lies under the edges whose end is one of its ancestors (or itself).
    ups = F.expr(f"explode(filter(transform(sequence(0, {depth - 1}), d -> shiftright(leaf, d)), a -> a > 1)) AS up")
    terms = leaves.select("model_id", "leaf", "vote", ups).join(
        edges.selectExpr("model_id", "leaf AS up", "feature", "lo", "hi"), ["model_id", "up"]
    )
    merged = terms.groupBy("model_id", "leaf", "vote", "feature").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    count = merged.groupBy("model_id", "leaf").agg(F.count("*").alias("n_terms"))
    return merged.join(count, ["model_id", "leaf"]).select("model_id", "leaf", "vote", "feature", "lo", "hi", "n_terms")


def predict_rules(features: DataFrame | Vectors, rules: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Votes of every model for every window: ``model_id, station, win_end, pred``.

    Long features meet the rule table by name; a leaf holds when all its ranges do. The rule table has at most
    ``depth * 2^depth`` rows a model, whatever the number of windows; vectors of windows meet it in their tasks.
    """
    if isinstance(features, Vectors):
        return _vector_votes(features, rules)
    matched = (
        features.select("station", "win_end", "feature", "value", *extra)
        .join(rules, "feature")
        .filter("value > lo AND value <= hi")
        .groupBy("model_id", "station", "win_end", *extra, "leaf", "vote", "n_terms")
        .agg(F.count("*").alias("met"))
    )
    return matched.filter("met = n_terms").select("model_id", "station", "win_end", *extra, F.col("vote").alias("pred"))


def predict_stumps(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Votes of rule tables whose leaves have one range each: no grouping, so votes can be averaged map-side."""
    met = features.select("station", "win_end", "feature", "value").join(rules, "feature")
    return met.filter("value > lo AND value <= hi").select("model_id", "station", "win_end", F.col("vote").alias("pred"))


def _vector_votes(vectors: Vectors, rules: DataFrame) -> DataFrame:
    at, width = {n: j for j, n in enumerate(vectors.names)}, len(vectors.names)
    held: dict[int, dict] = {}
    for r in rules.collect():
        held.setdefault(r["model_id"], {}).setdefault(r["leaf"], []).append(r)
    tables = []
    for model, leaves in sorted(held.items()):
        kept = [terms for terms in leaves.values() if len(terms) == terms[0]["n_terms"] and all(t["feature"] in at for t in terms)]
        if kept:
            terms = [t for leaf in kept for t in leaf]
            first = np.cumsum([0, *map(len, kept)])[:-1]
            column, lo, hi = np.array([at[t["feature"]] for t in terms]), *(np.array([t[c] for t in terms], float) for c in ("lo", "hi"))
            tables.append((model, column, lo, hi, first, np.array([leaf[0]["vote"] for leaf in kept])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = packed.matrix(batch, width)
            for model, column, lo, hi, first, vote in tables:
                met = np.logical_and.reduceat((x[:, column] > lo) & (x[:, column] <= hi), first, axis=1)
                row, leaf = np.nonzero(met)
                keys = batch.take(pa.array(row)).select(["station", "win_end"]).columns
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), model)), *keys, pa.array(vote[leaf])], ["model_id", "station", "win_end", "pred"])

    return vectors.windows.mapInArrow(run, "model_id BIGINT, station BIGINT, win_end BIGINT, pred DOUBLE")
