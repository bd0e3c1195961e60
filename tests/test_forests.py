"""Trees and forests of whole model sets against plain growth of each tree."""

import hashlib
import math

import numpy as np
import pytest

from foreshock.operators import forests, models, sampling, trees
from foreshock.sources.tables import cut_lineage

LONG = "model_id BIGINT, station BIGINT, win_end BIGINT, label DOUBLE, feature STRING, value DOUBLE"
KEYS = models.KEYS


def sample(seed, n):
    """Classes apart in a checkered plane, with ties and a feature of no use."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.normal(size=n).round(2), rng.normal(size=n)]).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 0.2) ^ (rng.random(n) < 0.15)).astype(float)
    return x, y


def long_rows(spark, sets):
    return spark.createDataFrame(
        [(m, 1, i, float(y[i]), f"f{j}", float(x[i, j])) for m, (x, y) in enumerate(sets) for i in range(len(x)) for j in range(x.shape[1])], LONG
    ).repartition(5)


def folds_of(rows):
    return cut_lineage(sampling.shuffle_split(rows.select("model_id", "station", "win_end", "label").distinct()))


def plain_tree(x, y, n, w, depth, entropy, choose, node=1):
    """Share of the upper class as a function of a row; every split of every chosen feature is tried."""
    mass = np.array([(n * (y == 0)).sum() * w[0], (n * (y == 1)).sum() * w[1]])
    best = None
    if depth and mass.all():
        able = [j for j in range(x.shape[1]) if len(set(x[n > 0, j])) > 1]
        for j in choose(node, able):
            values = sorted(set(x[n > 0, j]))
            for v, above in zip(values, values[1:]):
                score = 0.0
                for side in (x[:, j] <= v, x[:, j] > v):
                    a, b = (n * side * (y == 0)).sum() * w[0], (n * side * (y == 1)).sum() * w[1]
                    score += sum(-m * math.log2(m / (a + b)) for m in (a, b) if m) if entropy else 2 * a * b / (a + b)
                best = min(best, (round(score, 9), j, v, above)) if best else (round(score, 9), j, v, above)
    if best is None:
        return lambda r: mass[1] / mass.sum()
    _, j, v, above = best
    left = x[:, j] <= v
    low = plain_tree(x, y, n * left, w, depth - 1, entropy, choose, 2 * node)
    high = plain_tree(x, y, n * ~left, w, depth - 1, entropy, choose, 2 * node + 1)
    return lambda r: low(r) if r[j] <= (v + above) / 2 else high(r)


def chooser(model, tree, count):
    key = lambda node, j: hashlib.md5((f"{model}:{node}:f{j}" if tree < 0 else f"{model}:{tree}:{node}:f{j}").encode()).hexdigest()
    return lambda node, able: sorted(able, key=lambda j: key(node, j))[:count]


def plain_forest(model, x, y, on, entropy, count, depth, tree_numbers):
    """Votes of a forest that learns from the rows ``on``."""
    w = on.sum() / (2 * np.array([(on * (y == 0)).sum(), (on * (y == 1)).sum()]))
    digest = np.array([int(hashlib.md5(f"{model}:1:{i}".encode()).hexdigest()[:8], 16) % forests.PRIME for i in range(len(x))])
    grown = [
        plain_tree(x, y, on * forests.copies(digest, t), w, depth, entropy, chooser(model, t, count)) for t in tree_numbers
    ]
    return lambda r: float(round(float(np.mean([tree(r) for tree in grown])), 9) > 0.5)


def accuracy(vote, x, y, tests):
    right = np.array([vote(r) for r in x]) == y
    parts = [right[tests & (y == c)].mean() for c in (0, 1) if (tests & (y == c)).any()]
    return sum(parts) / len(parts)


def check_search(spark, sets, points, code, shape):
    rows = long_rows(spark, sets)
    folded = folds_of(rows)
    fitted, searched = forests.search_forests(rows, folded, points, code)
    tests = {}
    for r in folded.collect():
        if r.test:
            tests.setdefault((r.model_id, r.fold), set()).add(r.win_end)
    scores = {(r.model_id, r.point, r.fold): r.score for r in searched.collect()}
    assert len(scores) == len(sets) * len(points) * 5
    votes = {(r.model_id, r.win_end): r.pred for r in forests.forest_votes(rows.filter("model_id = 0"), fitted).collect()}
    assert len(votes) == len(sets) * len(sets[0][0])
    for m, (x, y) in enumerate(sets):
        means = []
        for i, point in enumerate(points):
            for f in range(5):
                test = np.isin(np.arange(len(x)), list(tests[m, f]))
                vote = plain_forest(m, x, y, (~test).astype(float), *shape(point))
                assert scores[m, i, f] == pytest.approx(accuracy(vote, x, y, test), abs=1e-12), (m, point, f)
            means.append(round(sum(scores[m, i, f] for f in range(5)) / 5, 12))
        vote = plain_forest(m, x, y, np.ones(len(x)), *shape(points[int(np.argmax(means))]))
        assert [votes[m, i] for i in range(len(sets[0][0]))] == [vote(r) for r in sets[0][0]]


def test_grid_of_trees_is_each_point_alone(spark):
    points = [{"max_depth": d, "criterion": c, "max_features": s} for d in (1, 4) for c in ("gini", "entropy") for s in ("sqrt", None)]
    check_search(
        spark, [sample(0, 70), sample(1, 55)], points, "DT",
        lambda p: (p["criterion"] == "entropy", 1 if p["max_features"] else 3, p["max_depth"], [-1]),
    )


def test_grid_of_forests_is_each_point_alone(spark):
    points = [{"n_estimators": n, "max_depth": d, "criterion": "gini", "max_features": s} for n in (1, 5) for d in (2, 3) for s in ("auto", None)]
    check_search(
        spark, [sample(2, 50), sample(3, 64)], points, "RF",
        lambda p: (False, 1 if p["max_features"] else 3, p["max_depth"], range(p["n_estimators"])),
    )


def test_one_point_is_the_tree_grown_by_levels(spark):
    rows = long_rows(spark, [sample(4, 80), sample(5, 60)])
    fitted, searched = forests.search_forests(rows, folds_of(rows), [{"max_depth": 3, "criterion": "gini", "max_features": None}])
    feats = rows.filter("model_id = 0")
    want = {(r.model_id, r.win_end): r.pred for r in trees.predict_rules(feats, trees.grow_trees(rows, 3)).collect()}
    assert searched.count() == 0
    assert {(r.model_id, r.win_end): r.pred for r in forests.forest_votes(feats, fitted).collect()} == want


def test_more_rows_than_bins_and_blocks_of_models(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 2))
    sets = [(x, (x[:, 0] > 0.5).astype(float)), (x, (x[:, 1] > -1).astype(float))]
    rows = long_rows(spark, sets)
    ends = forests.bins(rows).collect()
    assert all(200 < len(r.bins) <= forests.BINS for r in ends)
    monkeypatch.setattr(forests, "MAX_FITS", 1)
    monkeypatch.setattr(forests, "HELD", 500)
    point = {"n_estimators": 15, "max_depth": 3, "criterion": "entropy", "max_features": None}
    fitted, _ = forests.search_forests(rows, folds_of(rows), [point], "RF")
    right = forests.forest_votes(rows.filter("model_id = 0"), fitted).collect()
    for m, (_, y) in enumerate(sets):
        assert np.mean([r.pred == y[r.win_end] for r in right if r.model_id == m]) > 0.98


def test_bootstraps_are_poisson_counts():
    digest = np.random.default_rng(7).integers(0, forests.PRIME, 20000)
    first, second = forests.copies(digest, 0), forests.copies(digest, 1)
    assert abs(first.mean() - 1) < 0.03 and abs(first.var() - 1) < 0.05 and abs((first == 0).mean() - math.exp(-1)) < 0.01
    assert abs(np.corrcoef(first, second)[0, 1]) < 0.03


def test_edges(spark):
    """A sample of one class, no rows, an unknown point, equal rows of both classes, windows that lack a feature."""
    x, y = sample(8, 40)
    point = {"max_depth": 3, "criterion": "gini", "max_features": None}
    rows = long_rows(spark, [(x, np.zeros(40))])
    with pytest.raises(ValueError, match="one class"):
        forests.search_forests(rows, folds_of(rows), [point])
    with pytest.raises(ValueError, match="grid point"):
        forests.search_forests(rows, folds_of(rows), [{"max_depth": 3, "criterion": "mse", "max_features": None}])
    none = rows.limit(0)
    fitted, searched = forests.search_forests(none, folds_of(none), [point, point])
    assert fitted.count() == searched.count() == 0 and forests.forest_votes(rows, fitted).count() == 0
    same = long_rows(spark, [(np.ones((40, 2)), y)])
    fitted, _ = forests.search_forests(same, folds_of(same), [point])
    assert [(r.node, r.feature, r.share) for r in fitted.collect()] == [(1, None, pytest.approx(0.5))]
    assert {r.pred for r in forests.forest_votes(same, fitted).collect()} == {0.0}
    rows = long_rows(spark, [(x, y)])
    fitted, _ = forests.search_forests(rows, folds_of(rows), [point])
    used = [r.feature for r in fitted.filter("feature IS NOT NULL").select("feature").distinct().collect()]
    gap = rows.filter(f"NOT (win_end = 3 AND feature = '{used[0]}')").selectExpr(
        "station", "win_end", "feature", f"CASE WHEN win_end = 4 AND feature = '{used[0]}' THEN NULL ELSE value END AS value"
    )
    assert {r.win_end for r in forests.forest_votes(gap, fitted).collect()} == set(range(40)) - {3, 4}
