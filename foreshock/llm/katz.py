"""Language-model scores from a Katz backoff model of word pairs, trained on the corpus itself.

The model. Words are lower-cased in A-Z; a text is its words and one end token, and its first word follows a start mark.
Counts c up to ``K`` keep the share ``d_c`` that Good and Turing give them (with Katz's correction, so that counts above ``K``
are trusted); where the counts of counts do not give shares between 0 and 1, absolute discounting does. Counts above
``K`` give up the fixed ``TAIL``, so every context has some mass left. Then

    P1(w)   = d1(c(w)) c(w) / N          for known words; the rest of the mass goes to one unknown word
    P(w|h)  = d2(c(hw)) c(hw) / c(h)     for pairs that were seen
            = a(h) P1(w)                 otherwise, with a(h) = left(h) / c(h) / (1 - sum of P1 over words seen after h)
            = P1(w)                      after contexts that were never seen

so the probabilities of all words after any context add up to one exactly.

How it runs. A first pass counts words. Each task then turns its texts into chunks: the distinct pairs with the texts they occur in and
how often. Chunks are cut into buckets by the second word, so a bucket knows the full count of its words and pairs; words with more than
``HOT_TOKENS`` tokens (at most four a planned bucket) are cut by the first word as well, and their counts, known from the first pass, go
to all tasks. A bucket adds up, for each text of a chunk, the parts of the score that it knows; the parts that depend on discounts are
kept as numbers of occurrences by count, so one pass over the pairs does; these are written as a table. For pairs never seen, the context and
the text go to a second table cut by context, where the sums over the context's seen words meet and give the
backoff weight. A pair is one entry per chunk, and one small entry per text that has it, however often it occurs there.

Defined results: a null or empty text is just its end token; rows are scored one by one, whatever their ids;
rows without id count as training rows; with no training text every probability is that of the unknown word,
score and base score follow the same formulas. Words are held as 64-bit hashes.
"""

from __future__ import annotations

import gc
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.llm.words import mix, seeds, slices
from foreshock.sources.tables import cut_lineage

#: Largest count that Good-Turing discounts.
K = 5
#: Mass that larger counts give up.
TAIL = 1e-3
#: Tokens and texts of a chunk at most (a longer text is a chunk of its own).
CHUNK_TOKENS, CHUNK_TEXTS = 1_200_000, 60_000
#: Tokens for which one bucket is planned, and those from which a word is dealt over all buckets.
BUCKET_TOKENS = 1_500_000
HOT_TOKENS = BUCKET_TOKENS // 4

START, END = (int(x) for x in seeds(2, 31))
CHUNKS = "bucket INT, chunk BIGINT, held BOOLEAN, payload BINARY"


# ---- packed arrays ---------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value."""
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    body = b"".join([len(head).to_bytes(4, "little"), head, *(a.tobytes() for a in arrays)])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    body = pa.decompress(value[8:], decompressed_size=int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    at = 4 + int.from_bytes(body[:4], "little")
    out = []
    for kind, n in json.loads(body[4:at]):
        a = np.frombuffer(body, kind, n, at)
        at += a.nbytes
        out.append(a)
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins in sorted columns."""
    n = len(keys[0])
    if not n:
        return np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def pair_bucket(words: np.ndarray, before: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each pair: that of its word, for hot words (sorted) one by the word before."""
    place = bucket_of(words, buckets)
    if len(hot):
        found = hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words
        place[found] = bucket_of(mix(before[found] ^ mix(words[found])), buckets)
    return place


# ---- chunks ----------------------------------------------------------------------------------------------


def held_out(ids: pa.Array) -> np.ndarray:
    """Rows that the model does not learn from."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids.to_pylist()], bool)


class _Chunks:
    """Collects texts and gives them out as chunks, training and held-out texts apart."""

    def __init__(self, emit):
        self.emit, self.parts, self.tokens, self.texts = emit, {False: [], True: []}, {False: 0, True: 0}, {False: 0, True: 0}
        task = TaskContext.get()
        self.next = (task.partitionId() if task else 0) << 24

    def add(self, ids: pa.Array, words: np.ndarray, counts: np.ndarray, held: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = np.array([*ids.to_pylist(), None], object)[:-1]
        row = np.repeat(np.arange(len(counts)), counts)
        for side in (False, True):
            rows = np.flatnonzero(held == side)
            if len(rows):
                self.parts[side].append((ids[rows], words[held[row] == side], counts[rows]))
                self.tokens[side] += int(counts[rows].sum())
                self.texts[side] += len(rows)
            if self.tokens[side] > CHUNK_TOKENS or self.texts[side] > CHUNK_TEXTS:
                yield from self.flush(side)

    def flush(self, side: bool) -> Iterator[pa.RecordBatch]:
        if self.parts[side]:
            ids, words, counts = (np.concatenate(x) for x in zip(*self.parts[side]))
            self.parts[side], self.tokens[side], self.texts[side] = [], 0, 0
            self.next += 1
            yield from self.emit(self.next, side, ids, words, counts)

    def close(self) -> Iterator[pa.RecordBatch]:
        for side in (False, True):
            yield from self.flush(side)


def _chunker(emit):
    """Texts to chunks; ``words`` of a text end with the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(emit)
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(at, len(texts))
                words = np.insert(texts.hashes(), texts.bounds[1:], np.uint64(END))
                yield from chunks.add(ids, words, texts.counts + 1, held_out(ids))
        yield from chunks.close()

    return run


def _rows(bucket: list, chunk: int, held: bool, payload: list) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array([held] * n, pa.bool_()), pa.array(payload, pa.binary())],
        ["bucket", "chunk", "held", "payload"],
    )


def _words_emitter(buckets: int):
    """Distinct words of a training chunk with their counts, by bucket."""

    def emit(chunk, held, ids, words, counts):
        if held:
            return
        words, n = np.unique(words, return_counts=True)
        place = bucket_of(words, buckets)
        for b in np.unique(place).tolist():
            yield _rows([b], chunk, held, [pack(words[place == b], narrow(n[place == b]))])

    return emit


def _pairs_emitter(buckets: int, hot: np.ndarray):
    """Distinct pairs of a chunk with the texts they occur in and how often, cut by the second word. One bucket of the chunk also gets the ids."""

    def emit(chunk, held, ids, words, counts):
        ends = np.cumsum(counts)
        doc = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[ends - counts] = START
        place = pair_bucket(words, before, hot, buckets)
        by_bucket = np.argsort(narrow(place), kind="stable")
        cut = np.searchsorted(place[by_bucket], np.arange(buckets + 1))
        home = int(bucket_of(np.array([END], np.uint64), buckets)[0])
        for b in sorted({*np.flatnonzero(np.diff(cut)).tolist(), home}):
            rows = by_bucket[cut[b] : cut[b + 1]]
            w, h = words[rows], before[rows]
            order = np.argsort(h, kind="stable")  # rows come by text
            order = order[np.argsort(w[order], kind="stable")]
            w, h, d = w[order], h[order], doc[rows][order]
            each = runs(w, h, d)
            times = np.diff(np.append(each, len(w)))
            w, h, d = w[each], h[each], d[each]
            at = runs(w, h)
            first = runs(w[at])
            arrays = [
                w[at][first], narrow(np.diff(np.append(first, len(at)))), h[at],
                narrow(np.diff(np.append(at, len(w)))), narrow(d), narrow(times), np.array([len(counts)], np.uint32),
            ]
            if b == home:
                known = np.array([i is not None for i in ids], bool)
                arrays += [np.array([int(i) if k else 0 for i, k in zip(ids, known)], np.int64), known]
            yield _rows([b], chunk, held, [pack(*arrays)])

    return emit


# ---- discounts -------------------------------------------------------------------------------------------


def shares(n: list[int], k: int = K) -> np.ndarray:
    """Share of its mass that each count 1..k keeps; ``n[r - 1]`` is the number of types seen r times, to k + 1."""
    r = np.arange(1, k + 1)
    have = np.array(n, float)
    if have.min() > 0:
        cut = (k + 1) * have[k] / have[0]
        if cut < 1:
            turing = (r + 1) * have[1:] / (r * have[:k])
            out = (turing - cut) / (1 - cut)
            if (out > 0).all() and (out < 1).all():
                return out
    less = min(0.9, max(0.1, have[0] / (have[0] + 2 * have[1]))) if have[0] else 0.5
    return 1 - less / r


def kept(c: np.ndarray, share: np.ndarray, tail: float = TAIL) -> np.ndarray:
    """Discounted counts."""
    c = np.asarray(c, np.int64)
    out = c - tail
    small = (c >= 1) & (c <= len(share))
    out[small] = c[small] * share[c[small] - 1]
    return np.where(c > 0, out, 0.0)


# ---- one bucket of words ---------------------------------------------------------------------------------


def _word_totals(hot_tokens: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """How many words of the bucket have each count up to K + 1; 0 stands for all words, -1 for all tokens and -2 for
        end tokens. Hot words are rows of their own, -3 with the word."""
        got = [unpack(p) for p in rows["payload"]]
        words, n = np.concatenate([g[0] for g in got]), np.concatenate([g[1].astype(np.int64) for g in got])
        words, n = _sum_by(words, n)
        small = np.bincount(np.minimum(n, K + 2), minlength=K + 3)
        hot = n > hot_tokens
        r = [-2, -1, 0, *range(1, K + 2), *[-3] * int(hot.sum())]
        counts = [n[words == np.uint64(END)].sum(), n.sum(), len(n), *small[1 : K + 2], *n[hot]]
        return pd.DataFrame({"r": r, "word": [*[0] * (K + 4), *words[hot].view(np.int64)], "n": counts})

    return run


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = runs(keys)
    return [keys[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)]


def _bucket_scorer(total: int, share: np.ndarray, unknown: float, context_buckets: int, hot: np.ndarray, hot_counts: np.ndarray):

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Parts of the score by text of a chunk (kind 0, its place tells whether it is held
        out), sums by context (kind 1), unseen pairs (kind 2) and how many pairs have each count (kind 4)."""
        got = [unpack(p) for p in rows["payload"]]
        held = rows["held"].to_numpy()
        learn = [g for g, x in zip(got, held) if not x]
        w = np.concatenate([np.repeat(g[0], g[1]) for g in learn]) if learn else np.empty(0, np.uint64)
        h = np.concatenate([g[2] for g in learn]) if learn else np.empty(0, np.uint64)
        c = np.concatenate([_times(g) for g in learn]) if learn else np.empty(0, np.int64)
        pair = mix(w) + h * np.uint64(3)  # one 64-bit name per pair
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], runs(pair[order])
        pairs, w, h = pair[at], w[order][at], h[order][at]
        c = np.add.reduceat(c[order], at) if len(at) else c
        del pair, order, at
        words, count = _sum_by(w, c)
        known, whole = _look(hot, hot_counts, words)
        count = np.where(known, whole, count)  # their other pairs are elsewhere
        p1 = kept(count, share) / max(total, 1)
        small = np.bincount(np.minimum(c, K + 2), minlength=K + 3)
        out = [(4, 0, 0, pack(small[1 : K + 2]))]

        # sums over the words seen after a context
        behind = p1[np.searchsorted(words, w)] if len(w) else np.empty(0)
        order = np.argsort(h)
        at = runs(h[order])
        contexts = h[order][at]
        which = np.empty(len(h), np.int64)
        which[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
        mass = np.bincount(which, behind, len(at))
        numbers = [np.bincount(which[(c == r) if r <= K else (c > K)], minlength=len(at)) for r in range(1, K + 2)]
        place = bucket_of(contexts, context_buckets)
        for b in np.unique(place).tolist():
            own = place == b
            out.append((1, b, 0, pack(contexts[own], mass[own], *(narrow(x[own]) for x in numbers))))

        for chunk, x, g in zip(rows["chunk"], held, got):
            n = int(g[6][0])
            doc, often, texts = g[4].astype(np.int64), g[5].astype(np.int64), g[3].astype(np.int64)
            gw = np.repeat(g[0], g[1])
            gp = mix(gw) + g[2] * np.uint64(3)
            found, cp = _look(pairs, c, gp)
            known, cw = _look(hot, hot_counts, g[0])
            cw = np.repeat(np.where(known, cw, _look(words, count, g[0])[1]), g[1])
            base = np.log10(cw + 0.5)
            own = np.where(cw > 0, -np.log10(np.maximum(cw, 1)), 0.0)  # as a context, which each word but the end is once
            own[gw == np.uint64(END)] = 0.0
            uni = np.log10(np.where(cw > 0, kept(cw, share) / max(total, 1), unknown))
            pair_part = np.where(cp > K, np.log10(np.maximum(cp - TAIL, TAIL)), np.log10(np.maximum(cp, 1)))
            value = own + np.where(cp > 0, pair_part, uni)
            spread = lambda v: np.bincount(doc, np.repeat(v, texts) * often, n)
            columns = [spread(value), spread(base), np.bincount(doc, often, n).astype(np.int64), spread((cw > 0).astype(float)).astype(np.int64)]
            columns[2:] = [narrow(v) for v in columns[2:]]
            columns += [narrow(spread((cp == r).astype(float)).astype(np.int64)) for r in range(1, K + 1)]
            here = np.flatnonzero(columns[2])
            columns = [v[here] for v in columns]
            out.append((0, int(x), int(chunk), pack(narrow(here), np.array([n]), *columns, *g[7:])))
            unseen = np.repeat(cp == 0, texts)
            if unseen.any():
                context, where, met = np.repeat(g[2], texts)[unseen], doc[unseen], often[unseen]
                place = bucket_of(context, context_buckets)
                for b in np.unique(place).tolist():
                    sel = place == b
                    ranked = np.argsort(context[sel], kind="stable")
                    ctx, docs, many = context[sel][ranked], where[sel][ranked], met[sel][ranked]
                    first = runs(ctx)
                    out.append((2, b, int(chunk), pack(ctx[first], narrow(np.diff(np.append(first, len(ctx)))), narrow(docs), narrow(many), np.array([n]))))
        return pd.DataFrame(out, columns=["kind", "place", "chunk", "payload"])

    return run


def _times(g: list[np.ndarray]) -> np.ndarray:
    """Count of each pair of a chunk, from its counts by text."""
    at = np.cumsum(g[3].astype(np.int64)) - g[3]
    return np.add.reduceat(g[5].astype(np.int64), at.astype(np.int64)) if len(at) else np.empty(0, np.int64)


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of wanted keys, 0 where a key is missing."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    same = keys[at] == wanted
    return same, np.where(same, values[at], 0)


def unknown_mass(total: int, types: int, share: np.ndarray, n: list[int]) -> float:
    """Probability of the unknown word: what all known words leave."""
    if not total:
        return 1.0
    return (sum((1 - s) * r * m for r, s, m in zip(range(1, K + 1), share, n)) + TAIL * (types - sum(n[:K]))) / total


def _backoff(share: np.ndarray):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Backoff weights of the bucket's contexts, added up by text for the unseen pairs."""
        sums = [unpack(p) for p in rows["payload"][rows["kind"] == 1]]
        contexts = np.empty(0, np.uint64)
        if sums:
            columns = [np.concatenate([np.asarray(s[i], np.float64 if i == 1 else np.uint64 if i == 0 else np.int64) for s in sums]) for i in range(K + 3)]
            contexts, mass, *numbers = _sum_by(*columns)
            left = sum((1 - s) * r * m for r, s, m in zip(range(1, K + 1), share, numbers)) + TAIL * numbers[K]
            weight = np.log10(left) - np.log10(np.maximum(1 - mass, 1e-300))
        out = []
        for chunk, payload in zip(rows["chunk"][rows["kind"] == 2], rows["payload"][rows["kind"] == 2]):
            ctx, texts, doc, often, n = unpack(payload)
            found, value = _look(contexts, weight, ctx) if len(contexts) else (None, np.zeros(len(ctx)))
            total = np.bincount(doc.astype(np.int64), np.repeat(value, texts) * often, int(n[0]))
            here = np.flatnonzero(total)
            out.append((3, 0, int(chunk), pack(narrow(here), n, total[here])))
        return pd.DataFrame(out, columns=["kind", "place", "chunk", "payload"])

    return run


def _gather(total: int, types: int, texts: int, share: np.ndarray):
    share_log = np.log10(share)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """All parts of a chunk to one row per text."""
        n = int(unpack(rows["payload"].iloc[0])[1][0])
        parts, extra, ids, held = [np.zeros(n, float if i < 2 else np.int64) for i in range(4 + K)], np.zeros(n), None, False
        for kind, place, payload in zip(rows["kind"], rows["place"], rows["payload"]):
            here, _, *got = unpack(payload)
            if kind == 3:
                extra[here] += got[0]
                continue
            held = bool(place)
            if len(got) > 4 + K:
                ids = pd.Series(pd.array(got[4 + K], "Int64")).mask(~got[5 + K])
            for total_, value in zip(parts, got[: 4 + K]):
                total_[here] += value
        score = parts[0] + extra + sum(s * m for s, m in zip(share_log, parts[4:]))
        if texts:
            score = score - np.log10(texts)  # the start mark as a context
        n_tokens = parts[2]
        base = parts[1] - n_tokens * np.log10(total + 0.5 * (types + 1))
        return pd.DataFrame(
            {"doc_id": ids, "held_out": held, "n_tokens": n_tokens, "n_known": parts[3], "train_tokens": total, "base_score": base, "score": score}
        )

    return run


RESULT = "doc_id BIGINT, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE, score DOUBLE"
PARTS = "kind INT, place BIGINT, chunk BIGINT, payload BINARY"


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of data frames that are no longer held: it does so when the driver's JVM collects them."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def katz_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its score and base score."""
    spark = docs.sparkSession
    plain = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    spread = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = plain.mapInArrow(_chunker(_words_emitter(spread)), CHUNKS)
    by_count = words.groupBy("bucket").applyInPandas(_word_totals(HOT_TOKENS), "r INT, word BIGINT, n BIGINT").groupBy("r", "word").agg(F.sum("n").alias("n"))
    rows = by_count.collect()  # K + 4 numbers and the hot words
    n = {r: int(x) for r, word, x in rows if r > -3}
    hot = sorted((word % (1 << 64), int(x)) for r, word, x in rows if r == -3)
    hot, hot_counts = np.array([w for w, _ in hot], np.uint64), np.array([x for _, x in hot], np.int64)
    total, types, texts = n.get(-1, 0), n.get(0, 0), n.get(-2, 0)
    seen = [n.get(r, 0) for r in range(1, K + 2)]
    share = shares(seen)
    buckets = 1 + total // BUCKET_TOKENS

    scorer = _bucket_scorer(total, share, unknown_mass(total, types, share, seen), buckets, hot, hot_counts)
    pairs = plain.mapInArrow(_chunker(_pairs_emitter(buckets, hot)), CHUNKS)
    parts = cut_lineage(pairs.groupBy("bucket").applyInPandas(scorer, PARTS))
    del words, by_count, pairs
    counts = parts.where("kind = 4").select("payload").mapInArrow(_add_counts, "r INT, n BIGINT").groupBy("r").agg(F.sum("n"))
    m = {r: int(x) for r, x in counts.collect()}  # K + 1 numbers
    pair_share = shares([m.get(r, 0) for r in range(1, K + 2)])
    free_shuffles(spark)  # after a later job: Spark holds on to the last one's plan

    weights = parts.where("kind IN (1, 2)").groupBy("place").applyInPandas(_backoff(pair_share), PARTS)
    both = parts.where("kind = 0").unionByName(weights)
    return both.groupBy("chunk").applyInPandas(_gather(total, types, texts, pair_share), RESULT)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            n = unpack(payload)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(n) + 1), pa.int32()), pa.array(n, pa.int64())], ["r", "n"])


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
