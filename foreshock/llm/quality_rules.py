"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Rolling hashes of several n-gram lengths are compared within each text in numpy; characters inside repeated
n-grams are found with a running sum over words, so overlaps count once.

Defined results: a null or empty text has no words and all counts 0, and fails for being short. Repeated rows each
get their row. Null ids stay null. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foreshock.llm.words import Texts, grams, mix, slices

MIN_WORDS = 50
BASE_GRAM = 3
MAX_REPEAT_PERCENT = 50
#: Largest share of word characters inside repeated runs of so many words.
GRAM_LIMITS = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
LINE_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

SCHEMA = (
    "doc_id BIGINT, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT, "
    "dup_line_chars BIGINT, "
    + ", ".join(f"dup_{n}gram_chars BIGINT" for n in GRAM_LIMITS)
    + ", base_failed BOOLEAN, kept BOOLEAN"
)


def _per_doc(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries occur at least twice."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _covered(texts: Texts, words: np.ndarray, salt: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a run of ``n`` words found twice or more in their text."""
    out = np.zeros(len(words) + 1, np.int32)
    runs = grams(words, n)
    if len(runs):
        doc_end = np.repeat(texts.bounds[1:], texts.counts)[: len(runs)]
        whole = np.flatnonzero(np.arange(len(runs)) + n <= doc_end)
        hit = whole[_repeated(runs[whole] ^ salt[whole])]
        out[hit] += 1
        np.subtract.at(out, hit + n, 1) if len(hit) else None
    return np.cumsum(out[:-1]) > 0


def _duplicate_lines(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and the characters of words in them."""
    count, chars = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    points = texts.code_points()
    for i in range(len(texts)):
        raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
        if b"\n" not in raw:
            continue
        seen, at = set(), int(texts.offsets[i])
        for line in raw.split(b"\n"):
            if line and not line.isspace():
                if line in seen:
                    low, high = np.searchsorted(texts.starts, (at, at + len(line)))
                    count[i] += 1
                    chars[i] += (points[texts.ends[low:high]] - points[texts.starts[low:high]]).sum()
                seen.add(line)
            at += len(line) + 1
    return count, chars


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """All columns but the id for some texts."""
    words, points = texts.hashes(lower=False), texts.code_points()
    length = points[texts.ends] - points[texts.starts]
    salt = np.repeat(mix(np.arange(1, len(texts) + 1, dtype=np.uint64)), texts.counts)
    n_words, word_chars = texts.counts.astype(np.int64), _per_doc(texts.bounds, length)
    symbols = _per_doc(texts.offsets, _SYMBOL[texts.data])
    n_dup, dup_chars = _duplicate_lines(texts)
    n_repeat = _per_doc(texts.bounds, _covered(texts, words, salt, BASE_GRAM))
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat}
    out["dup_line_chars"] = dup_chars
    bad = dup_chars > LINE_LIMIT * word_chars
    for n, limit in GRAM_LIMITS.items():
        inside = _per_doc(texts.bounds, np.where(_covered(texts, words, salt, n), length, 0))
        out[f"dup_{n}gram_chars"] = inside
        bad |= inside > limit * word_chars
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return out | {"base_failed": failed, "kept": ~failed & ~bad}


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in slices(batch.column("text")):
            out = {"doc_id": batch.column("doc_id").slice(at, len(texts))} | measure(texts)
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its repetition measures and the verdict."""
    plain = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    return plain.mapInArrow(_map, SCHEMA)


def op6_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    grams_ = ", ".join(f"coalesce(sum(chars) FILTER (n = {n}), 0)::BIGINT AS dup_{n}gram_chars" for n in GRAM_LIMITS)
    bad = " AND ".join(f"dup_{n}gram_chars <= {limit!r}::DOUBLE * word_chars" for n, limit in GRAM_LIMITS.items())
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
base AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM w),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k FROM
      (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS dup_line_chars FROM l WHERE k > 1 GROUP BY doc_id),
g AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, s) AS k FROM (
      SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS s FROM (
        SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT unnest([{BASE_GRAM}, {", ".join(map(str, GRAM_LIMITS))}]) AS n)))),
c AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS pos FROM g WHERE k > 1),
cw AS (SELECT c.doc_id, c.n, length(w.ws[c.pos]) AS chars FROM c JOIN w ON w.doc_id = c.doc_id),
cov AS (SELECT doc_id, count(*) FILTER (n = {BASE_GRAM}) AS n_repeat_words, {grams_} FROM cw GROUP BY doc_id),
f AS (SELECT base.*, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
      coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in GRAM_LIMITS)}
      FROM base LEFT JOIN dl ON dl.doc_id = base.doc_id LEFT JOIN cov ON cov.doc_id = base.doc_id),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND dup_line_chars <= {LINE_LIMIT!r}::DOUBLE * word_chars AND {bad} AS kept FROM v
"""


ORACLE_OP6 = _oracle()
