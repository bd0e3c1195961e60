"""Toxicity: cumulative-link ordinal regression on sparse text features.

``P(grade > k) = 1 / (1 + exp(t_k - w x))`` with one weight vector ``w`` for all ordered thresholds ``t_0 <= t_1 <= ...``; the expected severity is
the sum of these chances over k. Features are words and the first four to eight bytes of longer words, hashed; their value is
``log(1 + times in the text)``.

The labels say toxic or not. Grades above 0 are read from how much a text holds of what sets toxic texts apart: toxic training
texts are cut into equal parts by how often features occur in them that are found (nearly) only in toxic ones.

Counts of features are taken by Spark over the sample; the ``FEATURES`` most telling ones are kept, and only their
occurrences in the sample reach the fit. Every row is scored from its whole text.

Defined results: null and empty texts have no features and get the severity of the thresholds alone. Repeated rows get equal
results, ids may be null, other columns are not read. Without toxic training rows, or with nothing else, all severities are the smoothed share
of toxic rows and nothing is flagged unless that share is above a half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.llm.samples import SAMPLE, labelled_texts
from foreshock.llm.words import Texts, slices
from foreshock.sources.tables import cut_lineage

PREFIXES = (4, 5, 6, 7, 8)
FEATURES = 4096
LEAST_TEXTS = 3
#: Grades above 0.
LEVELS = 2
STEPS, RATE, PENALTY = 300, 0.1, 3e-5
#: Least distance of two thresholds.
GAP = 0.05
#: Chance of any toxicity from which a text is flagged.
FLAG = 0.25


def sparse(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and number of occurrences, in the order of texts."""
    doc = texts.doc
    keys, owners = [texts.hashes()], [doc]
    for k in PREFIXES:
        rows, value = texts.prefixes(k)
        keys.append(value)
        owners.append(doc[rows])
    return np.concatenate(owners), np.concatenate(keys), texts.counts


def _counted(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], key[at], np.diff(np.append(at, len(key)))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each feature, toxic and other, by slice."""
    for batch in batches:
        for at, texts in slices(batch.column("text")):
            toxic = batch.column("label").slice(at, len(texts)).to_numpy() > 0
            owner, key, _ = sparse(texts)
            owner, key, _ = _counted(owner, key)
            keys, place = np.unique(key, return_inverse=True)
            bad = np.bincount(place, toxic[owner], len(keys)).astype(np.int64)
            all_ = np.bincount(place, minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bad), pa.array(all_ - bad)], ["feature", "toxic", "other"])


class Lookup:
    """Places of hashed features in a sorted table; a small bit table answers most misses."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(np.asarray(keys, np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(self.bits[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(rows):
            return rows, rows
        place = np.minimum(np.searchsorted(self.keys, wanted[rows]), len(self.keys) - 1)
        same = self.keys[place] == wanted[rows]
        return rows[same], place[same]


def _matrix(texts: Texts, lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature number and occurrences of the chosen features."""
    owner, key, _ = sparse(texts)
    rows, place = lookup.find(key)
    return _counted(owner[rows], place)


@dataclass
class Ordinal:
    lookup: Lookup
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, texts: Texts) -> np.ndarray:
        """``P(grade > k)`` of each text."""
        owner, feature, times = _matrix(texts, self.lookup)
        score = np.bincount(owner, np.log1p(times) * self.weights[feature], len(texts)) if len(owner) else np.zeros(len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, features: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the mean negative log likelihood of the grades and a small square penalty, by
    adaptive gradient steps. Thresholds are a first one and gaps above 0, so their order holds throughout."""
    n = max(len(grade), 1)
    base = [min(max(((grade > k).sum() + 0.5) / (n + 1), 1e-6), 1 - 1e-6) for k in range(levels)]
    logits = np.log((1 - np.array(base)) / np.array(base))
    params = np.concatenate([np.zeros(features), logits[:1], np.maximum(np.diff(logits), GAP)])
    if len(grade) == 0 or grade.min() == grade.max():
        return params[:features], np.cumsum(params[features:])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, t = params[:features], np.cumsum(params[features:])
        score = np.bincount(row, value * w[column], len(grade))
        above = np.hstack([np.ones((len(grade), 1)), 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -50, 50))), np.zeros((len(grade), 1))])
        slope = above * (1 - above)
        rows = np.arange(len(grade))
        chance = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-300)
        by_score = above[rows, grade] + above[rows, grade + 1] - 1
        by_t = np.zeros((len(grade), levels + 2))
        by_t[rows, grade] += np.minimum(slope[rows, grade] / chance, 1 / GAP)
        by_t[rows, grade + 1] -= np.minimum(slope[rows, grade + 1] / chance, 1 / GAP)
        at_t = by_t[:, 1 : levels + 1].sum(axis=0) / n
        gradient = np.concatenate(
            [np.bincount(column, value * by_score[row], features) / n + PENALTY * w, at_t[::-1].cumsum()[::-1]]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params = params - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        params[features + 1 :] = np.maximum(params[features + 1 :], GAP)
    return params[:features], np.cumsum(params[features:])


def _collector(lookup: Lookup, marks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                owner, feature, times = _matrix(texts, lookup)
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                telling = np.bincount(owner, times * marks[feature], len(texts)).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").slice(at, len(texts)), pa.array(telling),
                        pa.ListArray.from_arrays(bounds, pa.array(feature.astype(np.int32))),
                        pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32))),
                    ],
                    ["label", "telling", "features", "times"],
                )

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, levels: int = LEVELS) -> Ordinal:
    """The model, fitted on a bounded sample of labelled rows, each text once."""
    rows = labelled_texts(docs, labels, label, sample)
    rows = cut_lineage(rows.groupBy("text").agg(F.max("label").alias("label")).select("label", "text"))
    n = {bool(x): c for x, c in rows.groupBy(F.col("label") > 0).count().collect()}  # two numbers
    bad, good = n.get(True, 0), n.get(False, 0)
    tally = rows.mapInArrow(_tally, "feature BIGINT, toxic BIGINT, other BIGINT").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    )
    tally = tally.where(f"toxic + other >= {LEAST_TEXTS}").withColumn(
        "odds", F.expr(f"ln((toxic + 0.1D) / ({bad} + 0.2D)) - ln((other + 0.1D) / ({good} + 0.2D))")
    )
    telling = F.abs("odds") * F.sqrt(F.col("toxic") + F.col("other"))
    chosen = tally.orderBy(telling.desc(), "feature").limit(FEATURES).select("feature", "odds").toPandas()  # a bounded table
    lookup = Lookup(chosen["feature"].to_numpy(np.int64).view(np.uint64))
    marks = np.zeros(len(chosen))
    order = np.argsort(chosen["feature"].to_numpy(np.int64).view(np.uint64))
    marks[:] = chosen["odds"].to_numpy(float)[order] > np.log(20)

    schema = "label INT, telling DOUBLE, features ARRAY<INT>, times ARRAY<INT>"
    got = rows.mapInArrow(_collector(lookup, marks), schema).toArrow()
    label_, amount = got.column("label").to_numpy(), got.column("telling").to_numpy()
    lists = got.column("features").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    column, times = lists.flatten().to_numpy(), got.column("times").combine_chunks().flatten().to_numpy()
    grade = np.zeros(len(label_), np.int64)
    toxic = label_ > 0
    if toxic.any():
        edges = np.quantile(amount[toxic], np.arange(1, levels) / levels)
        grade[toxic] = 1 + np.searchsorted(edges, amount[toxic], "left")
    row = np.repeat(np.arange(len(label_)), sizes)
    weights, thresholds = fit(row, column, np.log1p(times), grade, len(lookup.keys), levels)
    return Ordinal(lookup, weights, thresholds)


def _scorer(model: Ordinal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                chances = model.chances(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)), pa.array(chances.sum(axis=1)), pa.array(chances[:, 0]),
                        pa.array((chances >= FLAG).sum(axis=1).astype(np.int64)), pa.array(chances[:, 0] >= FLAG),
                    ],
                    ["doc_id", "severity", "p_toxic", "grade", "toxic"],
                )

    return run


def severity(docs: DataFrame, model: Ordinal, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: expected severity, the chance of any, the grade and whether it is flagged."""
    plain = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    return plain.mapInArrow(_scorer(model), "doc_id BIGINT, severity DOUBLE, p_toxic DOUBLE, grade BIGINT, toxic BOOLEAN")


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return severity(docs, train(docs, labels))
