"""Trained models: held-out accuracy, parts against plain computations, edge cases; and the pipeline."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from foreshock.llm import quality_model, samples, toxicity
from foreshock.llm.words import slices

SF = "/root/testdata/sf0.1"
DOCS = "doc_id BIGINT, text STRING, label STRING, score STRING, toxic BIGINT"
LABELS = "doc_id BIGINT, quality INT, toxic INT"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality_model.fit(x, y, trees=20, depth=3)

    def walk(row):
        total = trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert ((trees.score(x) > 0.5) == (y == 1)).mean() > 0.95
    assert np.allclose(quality_model.fit(x, np.ones(600)).score(x), 601 / 602)
    assert len(quality_model.fit(x[:0], y[:0]).score(x[:0])) == 0


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in quality_model.op8_boosted_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    right = [got[i].predicted == q for i, q in labels.items() if held(i)]
    assert len(right) > 500 and np.mean(right) > 0.97


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "", "", 0), (None, "", "", "", 0), (2, "a b", "", "", 0), (2, "a b", "", "", 0)], DOCS)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 0, 0)], LABELS)
    trees = quality_model.train(docs, labels)
    rows = quality_model.with_score(docs, trees, ["doc_id", "label"], "s").collect()
    assert len(rows) == 4 and all(0 <= r.s <= 1 for r in rows) and list(rows[0].asDict()) == ["doc_id", "label", "s"]
    assert quality_model.with_score(docs.limit(0), trees, ["doc_id"]).collect() == []


def test_sample_is_bounded_and_leaves_out_held_rows(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "", "", 0) for i in range(200)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], LABELS)
    got = samples.labelled_texts(docs, labels, "quality", 50).collect()
    assert len(got) == 50 and not any(held(r.doc_id) for r in got)


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    n, features = 800, 12
    dense = rng.poisson(0.4, size=(n, features))
    grade = np.clip(dense[:, :3].sum(axis=1), 0, 2)
    row, column = np.nonzero(dense)
    weights, thresholds = toxicity.fit(row, column, np.log1p(dense[row, column]), grade, features, 2)
    assert thresholds[0] < thresholds[1] and weights[:3].min() > 5 * np.abs(weights[3:]).max()
    score = np.log1p(dense) @ weights
    expected = (1 / (1 + np.exp(thresholds[None, :] - score[:, None]))).sum(axis=1)
    assert np.corrcoef(expected, grade)[0, 1] > 0.95


def test_features_are_words_and_their_beginnings():
    texts = next(slices(pa.array(["Trash trashy tra", None, "trash"])))[1]
    owner, key, _ = toxicity.sparse(texts)
    owner, key, times = toxicity._counted(owner, key)
    assert [int((owner == i).sum()) for i in range(3)] == [5, 0, 2]  # three words, tras and trash of longer ones; trash and tras
    assert set(key[owner == 2]) <= set(key[owner == 0]) and times[owner == 0].max() == 2


def test_toxicity_on_held_out_rows(spark):
    got = {r.doc_id: r for r in toxicity.op1_ordinal_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    caught = [got[i].toxic for i, t in labels.items() if held(i) and t]
    false = [got[i].toxic for i, t in labels.items() if held(i) and not t]
    assert np.mean(caught) > 0.85 and np.mean(false) < 0.01
    assert all(0 <= r.p_toxic <= r.severity <= toxicity.LEVELS and r.toxic == (r.p_toxic >= toxicity.FLAG) for r in got.values())


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "", "", 0), (None, "", "", "", 0), (2, "a b", "", "", 0)], DOCS)
    for labels in ([], [(2, 1, 0)], [(2, 1, 1)], [(1, 0, 1), (2, 0, 0), (None, 1, 1)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
        rows = toxicity.severity(docs, model).collect()
        assert len(rows) == 3 and all(0 <= r.severity <= toxicity.LEVELS for r in rows)


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives."""
    sf = "/root/testdata/sf0.01"
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(spark.createDataFrame(stage(spark, docs[-1], sf).toPandas()))
    return [d.toPandas() for d in docs]


def test_pipeline_stages(spark, stages):
    raw, good, single, clean, masked, mix = stages
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id").quality
    marked = raw.doc_id.map(labels)
    assert marked[raw.doc_id.isin(good.doc_id)].eq(0).mean() < 0.01 and good.doc_id.isin(raw.doc_id).all()
    assert set(raw.doc_id[marked.eq(1)]) - set(good.doc_id) == set() or len(set(raw.doc_id[marked.eq(1)]) - set(good.doc_id)) < 5
    assert single.text.nunique() == len(single) and set(good.text) - set(single.text) != set()

    sets = {}
    for i, t in zip(good.doc_id, good.text):
        w = t.lower().split()
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    kept = set(single.doc_id)
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    for i in kept:  # no two kept ones are near
        assert not any(j < i and sets[i] and min(len(sets[i]), len(sets[j])) * 10 >= 8 * max(len(sets[i]), len(sets[j])) and near(sets[i], sets[j]) for j in kept)
    for i in set(sets) - kept:  # and each that went is near to another
        assert any(j != i and near(sets[i], sets[j]) for j in sets)

    squeeze = lambda t: " ".join(t.lower().split())
    items = [squeeze(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    leaks = {i for i, t in zip(single.doc_id, single.text) if any(x in squeeze(t) for x in items)}
    assert leaks and set(single.doc_id) - set(clean.doc_id) == leaks
    assert set(masked.doc_id) == set(clean.doc_id) and not masked.text.str.contains("AKIA[A-Z0-9]{16}|[0-9a-f]{24}|password=[0-9a-f]{6}").any()
    assert (masked.n_chars == masked.text.str.len()).all() and masked.text.str.contains("[SECRET]", regex=False).any()
    before = dict(zip(clean.doc_id, clean.text))
    assert all(t == before[i] for i, t in zip(masked.doc_id, masked.text) if "[SECRET]" not in t)
    total = masked.text.str.split().str.len().groupby(masked.source).sum()
    taken = mix.groupby("source").taken.sum()
    for source, target in mix.groupby("source").target.first().items():
        assert target <= 3 * total[source] + 1e-6 and abs(taken[source] - target) <= mix[mix.source == source]["size"].max()
    assert list(mix.columns[:5]) == corpus_pipeline.COLUMNS


def test_pipeline_stages_on_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.01")
        assert out.collect() == [] and out.columns[:5] == corpus_pipeline.COLUMNS


def test_pipeline_stages_with_nulls_and_extra_columns(spark):
    rows = [(i, "some words here " * 30 if i % 3 else None, None, "s" if i % 2 else None, None, 7) for i in range(12)] + [(None, None, None, None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score BIGINT")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.01").count() <= 13
