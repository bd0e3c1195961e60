"""Packed windows give what long rows give, model by model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreshock.operators import forests, linear, models, packed, sampling, selection, trees
from foreshock.sources.tables import cut_lineage

NAMES = ["a__mean", "b__mean", "c__maximum", "d__minimum", "e__mean"]
FEATURES = "station BIGINT, win_end BIGINT, feature STRING, value DOUBLE"
SAMPLES = "model_id BIGINT, station BIGINT, win_end BIGINT, label DOUBLE"
KEYS = models.KEYS


def tables(spark, seed=0, n=90, n_models=70, share=0.7):
    """Long features with ties, and samples of more models than a word has bits, numbered from 3."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(size=n).round(1), rng.normal(size=n), np.full(n, 2.0), rng.integers(0, 2, n)]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 2] > 0.3) ^ (rng.random(n) < 0.2)).astype(float)
    feats = spark.createDataFrame([(i % 7, 600 * i, f, float(x[i, j])) for i in range(n) for j, f in enumerate(NAMES)], FEATURES).repartition(5)
    drawn = spark.createDataFrame(
        [(m + 3, i % 7, 600 * i, float(y[i])) for m in range(n_models) for i in np.flatnonzero(rng.random(n) < share).tolist()], SAMPLES
    ).repartition(3)
    return cut_lineage(feats), cut_lineage(drawn)


def both(spark, keep=3, **shape):
    """Features and training rows, long and packed; each model has its own features."""
    feats, drawn = tables(spark, **shape)
    chosen = selection.select_topk(selection.p_values(selection.mann_whitney(selection.ranked_values(drawn, feats))), keep)
    vectors = packed.window_vectors(feats)
    sampled = packed.sampled_windows(drawn, feats, vectors)
    return feats, cut_lineage(models.training_rows(drawn, feats, chosen)), vectors, models.training_rows(sampled, feats, chosen), drawn


def votes(df):
    return {(r.model_id, r.station, r.win_end): r.pred for r in df.collect()}


def test_windows_are_stored_once_for_all_models(spark):
    feats, drawn = tables(spark)
    sampled = packed.sampled_windows(drawn, feats, packed.window_vectors(feats))
    assert sampled.windows.count() == drawn.select("station", "win_end").distinct().count() < 100 < drawn.count()
    found = {}
    for r in sampled.windows.collect():
        for w, word in enumerate(r.models):
            for b in range(64):
                if word >> b & 1:
                    found[sampled.base + 64 * w + b, r.station, r.win_end] = r.label
    assert found == {(r.model_id, r.station, r.win_end): r.label for r in drawn.collect()}


def test_rank_sums_are_those_of_ranked_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(packed, "HELD", 50)
    feats, drawn = tables(spark, seed=1)
    sampled = packed.sampled_windows(drawn, feats, packed.window_vectors(feats))
    got, want = (rows(selection.mann_whitney(selection.ranked_values(s, feats)).select("model_id", "feature", "c0", "c1", "n_values", "a0", "a1", "u", "z")) for s in (sampled, drawn))
    assert len(got) == 350 and [r[:8] for r in got] == [r[:8] for r in want]
    assert all(a[8] is None and b[8] is None or a[8] == pytest.approx(b[8], rel=1e-12) for a, b in zip(got, want))


def test_a_window_twice_in_a_sample_or_with_a_feature_twice_is_an_error(spark):
    feats, drawn = tables(spark, n=20, n_models=2)
    vectors = packed.window_vectors(feats)
    with pytest.raises(Exception, match="twice"):
        packed.sampled_windows(drawn.unionAll(drawn), feats, vectors)
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        packed.window_vectors(feats.unionAll(feats))


def test_missing_values_are_null_and_stations_may_be(spark):
    feats = spark.createDataFrame([(1, 0, "a", 1.0), (1, 0, "b", 2.0), (1, 600, "b", float("nan")), (None, 0, "a", None), (None, 0, "b", 5.0)], FEATURES)
    got = {(r.station, r.win_end): r.x for r in packed.window_vectors(feats).windows.collect()}
    assert got[1, 0] == [1.0, 2.0] and got[None, 0] == [None, 5.0] and got[1, 600][0] is None and np.isnan(got[1, 600][1])


@pytest.mark.parametrize("criterion, most, depth", [("gini", 2, 3), ("entropy", None, 4)])
def test_trees_of_packed_windows_are_those_of_long_rows(spark, rows, criterion, most, depth):
    feats, long, vectors, packs, _ = both(spark, keep=4, seed=2)
    want = trees.grow_trees(long.filter("model_id < 20"), depth, criterion, most)
    got = trees.grow_trees(packs._replace(chosen={m: c for m, c in packs.chosen.items() if m < 20}), depth, criterion, most)
    named = ["model_id", "leaf", "vote", "feature", "lo", "hi", "n_terms"]
    assert rows(got.select(named)) == rows(want.select(named))
    assert votes(trees.predict_rules(vectors, got)) == votes(trees.predict_rules(feats, want))


def test_missing_values_meet_no_rule(spark):
    feats, long, vectors, packs, _ = both(spark, keep=2, seed=3, n_models=4)
    rules = cut_lineage(trees.grow_trees(packs, 2))
    gap = feats.filter("NOT (win_end = 600 AND feature <> 'a__mean')").withColumn("value", F.expr("CASE win_end WHEN 1200 THEN double('nan') WHEN 1800 THEN NULL ELSE value END"))
    got = votes(trees.predict_rules(packed.window_vectors(gap), rules))
    assert got == votes(trees.predict_rules(gap, rules)) and not {1200, 1800} & {k[2] for k in got}


def only(packs, long, n):
    return packs._replace(chosen={m: c for m, c in packs.chosen.items() if m < 3 + n}), long.filter(f"model_id < {3 + n}")


@pytest.mark.parametrize("code, n", [("DT", 90), ("RF", 90), ("DT", 500)])
def test_searches_over_packed_windows_are_those_over_long_rows(spark, rows, monkeypatch, code, n):
    """Bins of one value, and of several, that reach over ranges; blocks of models."""
    feats, long, vectors, packs, drawn = both(spark, keep=4, seed=4, n=n, n_models=4)
    packs, long = only(packs, long, 3)
    folded = cut_lineage(sampling.shuffle_split(drawn.filter("model_id < 6")))
    sizes = {"n_estimators": [4]} if code == "RF" else {}
    points = [{"max_depth": d, "criterion": c, "max_features": s} | {k: v[0] for k, v in sizes.items()} for d in (2, 5) for c in ("gini", "entropy") for s in ("sqrt", None)]
    want, scores = forests.search_forests(long, folded, points, code)
    monkeypatch.setattr(forests, "MAX_FITS", 30)
    monkeypatch.setattr(forests, "HELD", 200)
    got, found = forests.search_forests(packs, folded, points, code)
    assert rows(found) == rows(scores) and len(rows(got)) > 10
    for a, b in zip(rows(got.fillna(-1.0).fillna("")), rows(want.fillna(-1.0).fillna(""))):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-12)
    assert votes(forests.forest_votes(vectors, got)) == votes(forests.forest_votes(feats, want))


def test_growth_of_packed_samples_shuffles_no_counts(spark):
    """What meets by model is a byte a value, not class counts by node."""
    _, _, _, packs, drawn = both(spark, keep=4, seed=5, n=300, n_models=3)
    block = {m: forests.Grown([packs.names[j] for j in c], [low for low, _ in ends], [high for _, high in ends], None, None) for (m, c), ends in zip(packs.chosen.items(), forests.packed_bins(packs).values())}
    pieces = forests.packed_samples(packs, block, digests=True).collect()
    n = drawn.count()
    assert sum(len(r.codes) for r in pieces) == 4 * n and sum(len(r.label) for r in pieces) == n and sum(len(r.digest) for r in pieces) == 4 * n


def test_packed_samples_of_one_class_are_an_error(spark):
    _, _, _, packs, drawn = both(spark, keep=2, seed=6, n=40, n_models=2)
    one = packs._replace(windows=packs.windows.filter("label > 0"))
    with pytest.raises(ValueError, match="one class"):
        forests.search_forests(one, drawn, [{"max_depth": 2, "criterion": "gini", "max_features": None}])
    none = packs._replace(chosen={})
    assert forests.search_forests(none, drawn, [{"max_depth": 2, "criterion": "gini", "max_features": None}])[0].count() == 0


@pytest.mark.parametrize("kind", ["LR", "SVM"])
def test_linear_fits_of_packed_windows_are_those_of_long_rows(spark, rows, monkeypatch, kind):
    feats, long, vectors, packs, drawn = both(spark, keep=4, seed=7, n_models=4)
    packs, long = only(packs, long, 3)
    folded = cut_lineage(sampling.shuffle_split(drawn.filter("model_id < 6")))
    want, scores = linear.search_linear(long, folded, kind, [{"C": 0.1}, {"C": 10}])
    monkeypatch.setattr(linear, "STEP", 20)
    got, found = linear.search_linear(packs, folded, kind, [{"C": 0.1}, {"C": 10}])
    assert rows(found) == rows(scores)
    for a, b in zip(rows(got), rows(want)):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-5, abs=1e-7)
    gap = feats.filter("NOT (win_end = 600 AND feature <> 'a__mean')").withColumn("value", F.expr("CASE win_end WHEN 1200 THEN double('nan') ELSE value END"))
    assert votes(linear.linear_votes(packed.window_vectors(gap), got)) == votes(linear.linear_votes(gap, got))


def test_neighbours_of_packed_windows_are_those_of_long_rows(spark, rows):
    feats, long, vectors, packs, _ = both(spark, keep=4, seed=8, n_models=4)
    chosen = long.select("model_id", "feature").distinct()
    want = models.neighbour_votes(models.input_rows(feats, chosen), models.neighbour_blocks(long, 16))
    got = models.neighbour_votes(models.input_rows(vectors, packs), models.neighbour_blocks(packs, 16))
    assert len(votes(got)) == 360 and votes(got) == votes(want)
