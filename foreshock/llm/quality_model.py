"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are cut into at most ``BINS`` classes each at quantiles of the training rows; trees are grown
level by level from histograms of gradients and held as flat arrays, in which all rows of a batch step down together
in numpy. The trees are fitted on a bounded sample of labelled rows (``samples.SAMPLE``); every row is scored from its
text alone.

Defined results: null and empty texts have all statistics 0 and a score like any other; repeated rows get equal scores; a row
without id is not held out. Without labelled rows, or with one class only, every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foreshock.llm.samples import SAMPLE, labelled_texts
from foreshock.llm.words import Texts, grams, mix, slices

BINS, DEPTH, TREES, RATE, LEAST_ROWS, SMOOTH = 64, 4, 80, 0.15, 20, 1.0
THRESHOLD = 0.3

STATISTICS = (
    "log_words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "repeat_2", "repeat_5", "lines",
    "upper", "digits", "symbols", "sentence_ends", "commas", "exclamations", "other_bytes", "loud_words", "marked_words",
    "capital_words", "repeat_next", "bars",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _mask(bytes(range(65, 91))), _mask(b"0123456789")
_SYMBOL, _STOP, _COMMA, _LOUD = _mask(b"#*$%&<>@~^_=+\\/{}[]"), _mask(b".?"), _mask(b",;:"), _mask(b"!")
_LETTER = _mask(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def statistics(texts: Texts) -> np.ndarray:
    """One row of statistics per text."""
    n, data = len(texts), texts.data
    counts = texts.counts.astype(float)
    some, size = np.maximum(counts, 1), np.maximum(np.diff(texts.offsets).astype(float), 1)
    words, doc = texts.hashes(), texts.doc
    points = texts.code_points()
    length = points[texts.ends] - points[texts.starts]

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, n)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data])])
        return (total[texts.offsets[1:]] - total[texts.offsets[:-1]]) / size

    def repeats(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct share and largest share of runs of ``k`` words."""
        runs = grams(words, k)
        home = doc[: len(runs)]
        whole = np.arange(len(runs)) + k <= texts.bounds[1:][home]
        keys = runs[whole] ^ mix(home[whole].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys)
        keys = keys[order]
        distinct, largest = np.zeros(n), np.zeros(n)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
        if len(first):
            owner = home[whole][order][first]
            np.add.at(distinct, owner, 1)
            np.maximum.at(largest, owner, np.diff(np.append(first, len(keys))))
        return distinct / np.maximum(counts - k + 1, 1), largest / np.maximum(counts - k + 1, 1)

    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    uppers = np.concatenate([[0], np.cumsum(_UPPER[data])])
    own_letters, own_uppers = letters[texts.ends] - letters[texts.starts], uppers[texts.ends] - uppers[texts.starts]
    last = data[texts.ends - 1] if len(doc) else data[:0]
    first = data[texts.starts] if len(doc) else data[:0]
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    distinct, top = repeats(1)
    columns = [
        np.log1p(counts), per_doc(length) / some, per_doc(length >= 12) / some, per_doc(length <= 2) / some, distinct, top,
        1 - repeats(2)[0], 1 - repeats(5)[0], share(_mask(b"\n")), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_STOP),
        share(_COMMA), share(_LOUD), share(_mask(bytes(range(128, 256)))),
        per_doc((own_letters >= 3) & (own_uppers * 2 > own_letters)) / some, per_doc(_SYMBOL[last] | _LOUD[last]) / some,
        per_doc(_UPPER[first]) / some, per_doc(same) / some, share(_mask(b"|")),
    ]
    out = np.stack(columns, axis=1)
    out[counts == 0] = 0.0
    return out


@dataclass
class Trees:
    """Full binary trees of one depth as flat arrays: node ``i`` has children ``2i + 1`` and ``2i + 2``."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.start)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boosted trees for the chance of label 1 (logistic loss)."""
    share = (y.sum() + 1) / (len(y) + 2)
    start, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        trees = 0
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if trees else []
    place = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1) if trees else None
    total, grown = np.full(len(y), start), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        feature, threshold, bin_at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            best = np.zeros(width)
            for f in range(x.shape[1]):
                key = (node - base) * bins + place[:, f]
                g, w, k = (np.bincount(key, v, width * bins).reshape(width, bins).cumsum(axis=1) for v in (gradient, weight, None))
                gain = g**2 / (w + SMOOTH) + (g[:, -1:] - g) ** 2 / (w[:, -1:] - w + SMOOTH) - g[:, -1:] ** 2 / (w[:, -1:] + SMOOTH)
                gain[(k < LEAST_ROWS) | (k[:, -1:] - k < LEAST_ROWS)] = 0
                at = gain[:, : len(edges[f])].argmax(axis=1) if len(edges[f]) else np.zeros(width, np.int64)
                value = gain[np.arange(width), at] if len(edges[f]) else np.zeros(width)
                for i in np.flatnonzero(value > best + 1e-12):
                    best[i] = value[i]
                    feature[base + i], threshold[base + i], bin_at[base + i] = f, edges[f][at[i]], at[i]
            node = 2 * node + 1 + (place[np.arange(len(y)), feature[node]] > bin_at[node])
        g, w = (np.bincount(node - inner, v, inner + 1) for v in (gradient, weight))
        leaf = -RATE * g / (w + SMOOTH)
        total += leaf[node - inner]
        for store, value in zip(grown, (feature, threshold, leaf)):
            store.append(value)
    shape = (trees, inner)
    return Trees(start, np.array(grown[0], np.int64).reshape(shape), np.array(grown[1], float).reshape(shape), np.array(grown[2], float).reshape(trees, inner + 1))


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in slices(batch.column("text")):
            label = batch.column("label").slice(at, len(texts))
            yield pa.RecordBatch.from_pydict({"label": label} | dict(zip(STATISTICS, map(pa.array, statistics(texts).T))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees for ``label``, fitted on a bounded sample."""
    schema = "label INT, " + ", ".join(f"{s} DOUBLE" for s in STATISTICS)
    rows = labelled_texts(docs, labels, label, sample).select("label", "text").mapInArrow(_sampler, schema).toArrow()
    x = np.stack([rows.column(s).to_numpy() for s in STATISTICS], axis=1).reshape(-1, len(STATISTICS))
    y = rows.column("label").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the same trees whatever order the tasks ended in
    return fit(x[order], y[order])


def _scorer(trees: Trees, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [trees.score(statistics(texts)) for _, texts in slices(batch.column(text))]
            score = pa.array(np.concatenate(parts) if parts else np.empty(0))
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), score], [*(batch.schema.names[i] for i in kept), "score"])

    return run


def with_score(docs: DataFrame, trees: Trees, columns: list[str], score: str = "score", text: str = "text") -> DataFrame:
    """The named columns of ``docs`` and each row's score."""
    own = "_text" if text not in columns else f"c{columns.index(text)}"
    plain = docs.selectExpr(*[f"`{c}` AS c{i}" for i, c in enumerate(columns)], *([f"CAST(`{text}` AS STRING) AS _text"] if own == "_text" else []))
    types = [f"c{i} {plain.schema[i].dataType.simpleString()}" for i in range(len(columns))]
    return plain.mapInArrow(_scorer(trees, own), ", ".join([*types, "score DOUBLE"])).toDF(*columns, score)


def op8_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_score(docs, train(docs, labels), ["doc_id"])
    held_out = "coalesce(crc32(CAST(doc_id AS STRING)) % 5 = 0, false) AS held_out"
    return scored.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", held_out, "score", f"CAST(score >= {THRESHOLD} AS INT) AS predicted")
