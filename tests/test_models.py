"""Sampling, selection and classifiers against direct computations."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foreshock.operators import models, neighbours, ranking, sampling, selection, store, trees
from foreshock.functions import names

LONG = "model_id BIGINT, station BIGINT, win_end BIGINT, label DOUBLE, feature STRING, value DOUBLE"


def long_rows(spark, x, y, model=0):
    data = [(model, 1, i, float(y[i]), f"f{j:02d}", float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1])]
    return spark.createDataFrame(data, LONG)


def data(seed=0, n=80, k=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, k)), 2)
    y = (x[:, 1] + 0.5 * x[:, 2] > 0.3).astype(float)
    return x, y


def test_exact_quantiles_large_group_with_hot_value(spark):
    """More rows than the sketch keeps exactly, a third of them equal."""
    df = spark.range(60_000).selectExpr("'a' AS g", "CASE WHEN id % 3 = 0 THEN 7D ELSE CAST((id * 7919) % 60013 AS DOUBLE) / 1000 END AS v")
    values = np.array([r.v for r in df.select("v").collect()])
    got = ranking.exact_quantiles(df, ["g"], "v", {"a": 0.005, "b": 0.5, "c": 0.995}).first()
    assert [got.a, got.b, got.c] == pytest.approx(list(np.quantile(values, [0.005, 0.5, 0.995])), abs=1e-12)


def test_exact_quantiles_go_one_way_for_groups_of_every_size(spark):
    """One value, millions of ties, many different values, infinities and small groups, through several rounds of cuts."""
    parts = [
        "SELECT 'one' AS g, 5D AS v", "SELECT 'ties' AS g, CAST(id % 2 AS DOUBLE) AS v FROM range(2000001)",
        "SELECT 'wide' AS g, CAST((id * 7919) % 60013 AS DOUBLE) / 7 AS v FROM range(60013)",
        "SELECT 'edge' AS g, CASE WHEN id < 2 THEN double('-Infinity') WHEN id > 97 THEN double('Infinity') ELSE CAST(id AS DOUBLE) END AS v FROM range(100)",
        "SELECT 'two' AS g, CAST(id AS DOUBLE) AS v FROM range(2)", "SELECT 'none' AS g, CAST(NULL AS DOUBLE) AS v",
    ]
    df = spark.sql(" UNION ALL ".join(parts))
    qs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.77, "e": 1.0}
    got = {r.g: [r.a, r.b, r.c, r.d, r.e] for r in ranking.exact_quantiles(df, ["g"], "v", qs, cell=40).collect()}
    wide = np.sort((np.arange(60013) * 7919 % 60013) / 7)
    ties = np.sort(np.arange(2000001) % 2).astype(float)
    assert set(got) == {"one", "ties", "wide", "edge", "two"}
    assert got["one"] == [5.0] * 5 and got["two"] == pytest.approx([0, 0.013, 0.5, 0.77, 1])
    assert got["wide"] == pytest.approx(list(np.quantile(wide, list(qs.values()))), abs=1e-9)
    assert got["ties"] == list(np.quantile(ties, list(qs.values())))
    assert got["edge"][0] == -math.inf and got["edge"][2] == pytest.approx(49.5) and got["edge"][4] == math.inf


def test_undersample_ratio_seed_and_no_replacement(spark):
    labels = spark.range(1000).selectExpr("1L AS station", "id AS win_end", "CAST(id < 30 AS DOUBLE) AS label")
    got = sampling.undersample(labels, 3, seed=5).collect()
    assert len(set(got)) == len(got)
    for m in range(3):
        mine = [r for r in got if r.model_id == m]
        assert sum(r.label for r in mine) == 30 and len(mine) == 30 + int(30 / 0.75)
        order = sorted(range(30, 1000), key=lambda w: hashlib.md5(f"{m + 5}:1:{w}".encode()).hexdigest())[:40]
        assert {r.win_end for r in mine if r.label == 0} == set(order)


def test_split_has_a_quarter_in_each_fold(spark):
    s = spark.range(101).selectExpr("0L AS model_id", "1L AS station", "id AS win_end", "0D AS label")
    got = sampling.shuffle_split(s).groupBy("fold").agg(F.count_if("test").alias("t"), F.count("*").alias("n")).collect()
    assert {(r.t, r.n) for r in got} == {(26, 101)} and len(got) == 5


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_are_not_broadcast(spark):
    """Rows of few windows times many models look small to the planner; only the cuts, one a group, go to the driver."""
    labels = spark.range(400).selectExpr("id % 3 AS station", "id AS win_end", "CAST(id < 30 AS DOUBLE) AS label")
    drawn = sampling.undersample(labels, 50)
    split = sampling.shuffle_split(drawn)
    for plan in (executed(drawn), executed(split)):
        assert "BuildRight" in plan and "BuildLeft" not in plan
    assert drawn.count() == 50 * 70 and split.filter("test").count() == 50 * 5 * 18


def test_ranks_move_once_for_all_models(spark):
    """Values of a window are dealt once, whatever the number of models that drew it, and ranks are those of each model alone."""
    x, y = data(7, n=120, k=3)
    x[:40, 0] = 0.5
    feats = long_rows(spark, x, y).select("station", "win_end", "feature", "value")
    mine = [(m, 1, i, float(y[i])) for m in range(9) for i in range(120) if (i * 7 + m * 5) % 9 < 4]
    drawn = spark.createDataFrame(mine, "model_id BIGINT, station BIGINT, win_end BIGINT, label DOUBLE")
    ranked = selection.ranked_values(drawn, feats)
    unfolded = "Generate explode(models"
    plan = executed(ranked)
    assert unfolded in plan and "Exchange" not in plan[plan.index("Window [") : plan.index(unfolded)].split("SortMergeJoin")[0]
    got = {(r.model_id, r.feature, r.value): (r.n0, r.n1, r.below0, r.below1) for r in ranked.collect()}
    want = {}
    for m in range(9):
        own = [i for k, _, i, _ in mine if k == m]
        for j in range(3):
            for v in set(x[own, j]):
                at = [[sum(1 for i in own if y[i] == c and test(x[i, j])) for c in (0, 1)] for test in (lambda u: u == v, lambda u: u < v)]
                want[m, f"f{j:02d}", v] = (*at[0], *at[1])
    assert got == want


def test_mann_whitney_with_ties_and_p(spark):
    rng = np.random.default_rng(2)
    v, y = rng.integers(0, 6, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    df = spark.createDataFrame([(0, "a__b", float(a), float(b)) for a, b in zip(v, y)], "model_id BIGINT, feature STRING, value DOUBLE, label DOUBLE")
    ranked = ranking.class_ranks(df, ranking.value_splits(df))
    r = selection.mann_whitney(ranked).first()
    pos, neg = v[y > 0], v[y <= 0]
    u = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert r.u == pytest.approx(u)
    n, (_, t) = len(v), np.unique(v, return_counts=True)
    sd = math.sqrt(len(pos) * len(neg) / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
    z = (max(u, len(pos) * len(neg) - u) - len(pos) * len(neg) / 2 - 0.5) / sd
    assert r.z == pytest.approx(z)
    p = selection.p_values(selection.mann_whitney(ranked)).first().p_value
    assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_fisher_against_enumeration():
    for a, b, c, d in [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (8, 2, 1, 5)]:
        n, r, k = a + b + c + d, a + b, a + c
        prob = {i: math.comb(r, i) * math.comb(n - r, k - i) / math.comb(n, k) for i in range(max(0, k - (n - r)), min(r, k) + 1)}
        want = sum(v for v in prob.values() if v <= prob[a] * (1 + 1e-9))
        assert selection.fisher_two_sided(a, b, c, d) == pytest.approx(want)


def test_constants_have_no_p_and_two_valued_features_use_fisher(spark):
    rows = [(0, f, float(v), float(y)) for f, vals in {"c__c": [1, 1, 1, 1], "b__b": [0, 0, 1, 1]}.items() for v, y in zip(vals, [0, 0, 1, 1])]
    df = spark.createDataFrame(rows, "model_id BIGINT, feature STRING, value DOUBLE, label DOUBLE")
    got = selection.p_values(selection.mann_whitney(ranking.class_ranks(df, ranking.value_splits(df)))).collect()
    assert [(r.feature, round(r.p_value, 6)) for r in got] == [("b__b", round(1 / 3, 6))]


def test_fdr_and_topk_take_the_first_whether_or_not_they_pass(spark):
    p = [0.001, 0.002, 0.2, 0.9]
    df = spark.createDataFrame([(0, f"f{i}", v) for i, v in enumerate(p)], "model_id BIGINT, feature STRING, p_value DOUBLE")
    flags = {r.feature: r.relevant for r in selection.fdr_flag(df).collect()}
    h = sum(1 / i for i in range(1, 5))
    last = max((i + 1 for i, v in enumerate(p) if v <= 0.05 * (i + 1) / (4 * h)), default=0)
    assert flags == {f"f{i}": i < last for i in range(4)}
    assert {r.feature for r in selection.select_topk(df, 3).collect()} == {"f0", "f1", "f2"}


def test_frequency_order_and_blank_names(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (0, "c"), (0, "")], "model_id BIGINT, feature STRING")
    assert [(r.feature, r.n) for r in selection.feature_frequency(df).collect()] == [("c", 2), ("b", 1), ("a", 1)]


def test_glob_and_feature_lines(spark):
    import re

    assert re.match(names.glob_to_regex("rsam__*[!a]?"), "rsam__mean_bx")
    df = spark.createDataFrame([("1.234e-05 rsam__quantile  q",)], "s STRING")
    p, f = names.feature_line(F.col("s"))
    assert tuple(df.select(p, f).first()) == (1.234e-05, "rsam__quantile q")


def brute_tree(x, y, depth, w=None):
    """Greedy weighted gini tree as a function of a row; ties by feature, then value."""
    if w is None:
        w = (len(y) / (2 * (y <= 0).sum()), len(y) / (2 * (y > 0).sum()))
    mass = lambda m: ((y[m] <= 0).sum() * w[0], (y[m] > 0).sum() * w[1])
    vote = lambda m: float(mass(m)[1] > mass(m)[0])
    every = np.ones(len(y), bool)
    if depth == 0 or len(set(y)) < 2:
        v = vote(every)
        return lambda r: v
    best = None
    for j, v in itertools.chain.from_iterable(((j, v) for v in np.unique(x[:, j])[:-1]) for j in range(x.shape[1])):
        left = x[:, j] <= v
        (a0, a1), (b0, b1) = mass(left), mass(~left)
        score = (round(2 * a0 * a1 / (a0 + a1) + 2 * b0 * b1 / (b0 + b1), 9), j, v)
        if best is None or score < best[0]:
            best = (score, left)
    if best is None:
        v = vote(every)
        return lambda r: v
    (_, j, v), left = best
    cut = (v + x[x[:, j] > v, j].min()) / 2
    low, high = brute_tree(x[left], y[left], depth - 1, w), brute_tree(x[~left], y[~left], depth - 1, w)
    return lambda r: low(r) if r[j] <= cut else high(r)


@pytest.mark.parametrize("depth", [1, 3])
def test_trees_equal_brute_force(spark, depth):
    (x0, y0), (x1, y1) = data(0), data(1)
    rows = long_rows(spark, x0, y0, 0).unionByName(long_rows(spark, x1, y1, 1))
    rules = trees.stump_rules(trees.grow_stumps(rows)) if depth == 1 else trees.grow_trees(rows, depth)
    feats = rows.filter("model_id = 0").select("station", "win_end", "feature", "value")
    got = {(r.model_id, r.win_end): r.pred for r in trees.predict_rules(feats, rules).collect()}
    if depth == 1:
        assert got == {(r.model_id, r.win_end): r.pred for r in trees.predict_stumps(feats, rules).collect()}
    for m, (x, y) in enumerate(((x0, y0), (x1, y1))):
        tree = brute_tree(x, y, depth)
        assert [got[(m, i)] for i in range(len(x0))] == [tree(r) for r in x0]


def test_bayes_equals_direct(spark):
    x, y = data(4)
    rows = long_rows(spark, x, y)
    got = {r.win_end: r.pred for r in models.bayes_votes(rows.select("station", "win_end", "feature", "value"), models.fit_bayes(rows)).collect()}
    eps = 1e-9 * x.var(axis=0).max()
    score = []
    for c in (0, 1):
        part = x[y == c]
        m, v = part.mean(axis=0), part.var(axis=0) + eps
        score.append(np.log(len(part) / len(x)) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(axis=1))
    assert [got[i] for i in range(len(x))] == list((score[1] > score[0]).astype(float))


@pytest.mark.parametrize("k,p,weights", [(3, 2, "uniform"), (6, 1, "distance"), (5, 3, "distance")])
def test_neighbours_equal_direct_for_small_blocks(spark, k, p, weights):
    x, y = data(5)
    rows = long_rows(spark, x, y)
    inputs = rows.select("model_id", "station", "win_end", "feature", "value")
    got = {r.win_end: r.pred for r in models.neighbour_votes(inputs, models.neighbour_blocks(rows, 16), k, p, weights).collect()}
    for i in range(len(x)):
        d = (np.abs(x - x[i]) ** p).sum(axis=1)
        near = sorted(range(len(x)), key=lambda j: (d[j], j))[:k]
        if weights == "uniform":
            w = [1.0] * k
        elif d[near[0]] == 0:
            w = [float(d[j] == 0) for j in near]
        else:
            w = [d[j] ** (-1 / p) for j in near]
        assert got[i] == float(sum(wj * (2 * y[j] - 1) for wj, j in zip(w, near)) > 0)


def plain_neighbour_votes(inputs, rows, k, p):
    """Every window against every training row of its model."""
    ordered = "transform(array_sort(collect_list(struct(feature, value))), x -> x.value)"
    asked = inputs.groupBy("model_id", "station", "win_end").agg(F.expr(ordered).alias("vec"))
    held = rows.groupBy("model_id", "station", "win_end", "label").agg(F.expr(ordered).alias("tvec"))
    held = held.withColumnsRenamed({"station": "s", "win_end": "w"})
    gap = f"aggregate(zip_with(vec, tvec, (u, v) -> pow(abs(u - v), {p})), 0D, (a, d) -> a + d) AS d"
    pairs = asked.join(held, "model_id").selectExpr("model_id", "station", "win_end", "s", "w", "label", gap)
    order = Window.partitionBy("model_id", "station", "win_end").orderBy("d", "s", "w")
    near = pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return near.groupBy("model_id", "station", "win_end").agg(F.expr("CAST(sum(2 * label - 1) > 0 AS DOUBLE)").alias("pred"))


@pytest.mark.parametrize("block,k,p", [(8, 3, 2), (2048, 4, 2), (16, 7, 1)])
def test_neighbours_with_missing_infinite_equal_and_skewed_values(spark, rows, block, k, p):
    rng = np.random.default_rng(11)
    odd = [None, math.nan, math.inf, -math.inf]
    train, asked = [], []
    for m in range(4):
        x = np.round(rng.normal(size=(90, 4)) * [1, 1e6, 20, 1e-3], 4)
        x[30:60] = x[rng.integers(0, 3, 30)]
        for to, n in ((train, 60), (asked, 90)):
            for i in range(90 - n, 90):
                values = [float(v) for v in x[i]]
                if m and i % 9 == m:
                    values[i % 4] = odd[(i // 9) % 4]
                if m == 2 and i % 13 == 0:
                    values = values[:3]
                if m == 3 and i % 4 == 0:
                    values[i % 3] = odd[i % 3]
                to.extend((m, i % 5, i, float(rng.random() < 0.5) if to is train else 0.0, f"f{j}", v) for j, v in enumerate(values))
    labels = {(r[0], r[2]): r[3] for r in train}
    train = [(*r[:3], labels[r[0], r[2]], *r[4:]) for r in train]
    training = spark.createDataFrame(train, LONG)
    inputs = spark.createDataFrame(asked, LONG).drop("label")
    got = rows(models.neighbour_votes(inputs, models.neighbour_blocks(training, block), k, p))
    assert len(got) == 360 and got == rows(plain_neighbour_votes(inputs, training, k, p))


def test_windows_meet_few_training_rows(spark):
    """Blocks hold rows that are near, so that a window needs few of them, and of equal rows no more than votes count."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(1500, 5)) * [1, 1, 300, 1, 200], rng.integers(0, 2, 1500)
    x[:400] = x[0]
    training = long_rows(spark, x, y)
    blocks = models.neighbour_blocks(training, 64)
    sizes = {r.block: r.n for r in blocks.groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert max(sizes.values()) <= 64 and sum(sizes.values()) == 1100 + models.MOST
    boxes = models._boxes(blocks)
    asked = models._vectors(training).mapInArrow(neighbours.router(boxes, 2), "model_id BIGINT, station BIGINT, win_end BIGINT, vec ARRAY<DOUBLE>, block BIGINT")
    first = models._nearest_of_blocks(asked, blocks, 3, 2, boxes, set())
    visits = first.agg(F.sum(F.size("others") + 1)).first()[0]
    assert visits < 1500 * len(sizes) / 3


def test_windows_of_models_are_packed_once(spark):
    """Values of a window are gathered once, not once for each model, and come in the order of the names."""
    feats = spark.createDataFrame([(1, w, f, None if v is None else w + v) for w in range(3) for f, v in (("b", 0.5), ("a", 0.25), ("c", None)) if v or w], "station BIGINT, win_end BIGINT, feature STRING, value DOUBLE")
    chosen = spark.createDataFrame([(0, "b"), (0, "a"), (1, "c"), (2, "c"), (2, "b")], "model_id BIGINT, feature STRING")
    inputs = models.input_rows(feats, chosen)
    got = {(r.model_id, r.win_end): r.vec for r in inputs.collect()}
    want = {0: lambda w: [w + 0.25, w + 0.5], 1: lambda w: [None] if w else [], 2: lambda w: [w + 0.5, None] if w else [0.5]}
    assert got == {(m, w): f(w) for m, f in want.items() for w in range(3) if f(w)}
    plan = executed(inputs)
    assert plan.index("BroadcastNestedLoopJoin") < plan.index("collect_list(struct(feature")


def test_searched_neighbours_vote_with_their_points(spark, rows):
    (x0, y0), (x1, y1) = data(0), data(1)
    training = long_rows(spark, x0, y0, 0).unionByName(long_rows(spark, x1, y1, 1))
    folded = sampling.shuffle_split(training.select("model_id", "station", "win_end", "label").distinct(), folds=2)
    points = [{"n_neighbors": 3, "weights": "uniform", "p": 2}, {"n_neighbors": 12, "weights": "distance", "p": 1}]
    best = models.search_neighbours(training, folded, points)
    found = {r.model_id: r.asDict() for r in best.collect()}
    assert set(found) == {0, 1}
    blocks, inputs = models.neighbour_blocks(training), training.drop("label")
    got = rows(models.searched_neighbour_votes(inputs, blocks.join(best, "model_id")))
    want = [r for m, f in found.items() for r in rows(models.neighbour_votes(inputs.filter(f"model_id = {m}"), blocks, f["k"], f["p"], f["weights"]))]
    assert got == sorted(want) and len(got) == 160


def test_unknown_classifier_is_an_error():
    with pytest.raises(ValueError, match="unknown classifier"):
        models.grid_points("XX")
    assert len(models.grid_points("DT")) == 24


def test_impute_and_store(spark, tmp_path):
    vals = [1.0, 2.0, 4.0, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(1, i, "a", "mean", "", "a__mean", v) for i, v in enumerate(vals)] + [(1, 0, "b", "mean", "", "b__mean", None)],
                               "station BIGINT, win_end BIGINT, stream STRING, calculator STRING, params STRING, feature STRING, value DOUBLE")
    got = {(r.feature, r.win_end): r.value for r in store.impute(df).collect()}
    assert [got[("a__mean", i)] for i in range(7)] == [1, 2, 4, 2, 4, 1, 2] and got[("b__mean", 0)] == 0
    store.write_features(df, str(tmp_path / "f"))
    back = store.read_features(spark, str(tmp_path / "f"), 1, 4, ["mean"])
    assert back.count() == 3
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "calculator" in plan
