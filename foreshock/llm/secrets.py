"""Secret scans. Three fixed patterns give the base spans; values in a wider credential context are added when they would
take many guesses.

The number of guesses is the cheapest way to write a value as a row of parts: words of a ranked dictionary, dates, repeats, keyboard
walks and brute-force spans. Each part costs the logarithm of its guesses, each further part a constant, and dynamic programming over
positions finds the minimum over every way to cut the value, parts of longer walks and repeats included. ``hunter`` plus a year is
cheap; random characters cost their whole length, and so does a row of words that is long enough.

The dictionary is a short fixed list of frequent passwords and at most ``WORDS`` of the most frequent words of the texts themselves, counted over
all of them; what stands in a credential context is not counted, so a value never makes itself cheap.

A value that reaches beyond the base spans is added whole, so spans may overlap. Values without a digit or a letter with case, as prose in
scripts without spaces has them, are not scored.

Defined results: null and empty texts have no spans (the digest of the empty string). Repeated rows each get their row, null
ids stay null, and only id and text are read. Positions are code points of the whole text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.llm.words import Texts, slices
from foreshock.sources.tables import cut_lineage

KINDS = ("assign", "access", "hex", "guess")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Log10 of the guesses from which a value in a credential context counts as a secret.
MIN_LOG_GUESSES = 8.0
#: Log10 of the guesses that each part after the first adds.
PART_COST = 0.5
#: Words learnt from the texts (the bound of what comes to the driver and goes to each task), and the letters a word may have.
WORDS, WORD_LETTERS = 50_000, (3, 24)
#: Log10 of the guesses that a walk's beginning, a repeat's period and each step of either add.
WALK_COST, REPEAT_COST, STEP_COST = math.log10(40), math.log10(8), math.log10(2)
#: Longest period of a repeat, fewest characters of a walk.
PERIOD, WALK = 8, 3

# The base patterns.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_DIGITS = b"0123456789abcdef"

# Words of a wider credential context (names may end in them, as DB_PASS), and what may stand between them and the value.
CONTEXT = re.compile(
    rb"""(?i:(?:pwd|pass|passphrase|passcode|password|passwd|secret|token|credentials?|auth|authorization|bearer|private[_-]?key"""
    rb"""|access[_-]?key|secret[_-]?key|client[_-]?secret|api[_-]?key)\b)["']?(?:[ \t]*(?:[:=]|=>|\bis\b)[ \t]*|[ \t]+(?=["']))["']?(?:(?i:bearer|basic)[ \t]+)?([^\s"'<>,;]+)"""
)
HINTS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"auth", b"bearer", b"key")

# Frequent words and passwords, most frequent first.
COMMON = (
    "password 123456 12345678 qwerty abc123 monkey letmein dragon baseball iloveyou master sunshine ashley bailey shadow "
    "superman michael football jesus ninja mustang access batman trustno1 hello charlie welcome login admin root user test "
    "guest pass secret token default changeme change temp demo example sample public private server database mysql oracle "
    "linux windows google apple love money summer winter spring autumn monday friday january march april june july august "
    "october december london paris berlin madrid house water world people time work life home family friend school music "
    "computer internet network system office company service account email hunter killer pepper ginger cookie flower "
    "purple orange yellow silver golden diamond princess soccer hockey jordan thomas daniel andrew joshua robert jessica "
    "hannah amanda jennifer the and for you with this that have from your none null true false undefined empty required "
    "optional string number value field name here below above"
).split()
# Rows of keyboards.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "abcdefghijklmnopqrstuvwxyz")

_RANK = {w: i + 1 for i, w in enumerate(COMMON)}
_COLUMNS = list(zip(*(row[:7] for row in ROWS[:4])))
_LINES = [*ROWS, *_COLUMNS]
_NEXT = {x for line in _LINES for a, b in zip(line, line[1:]) for x in (a + b, b + a)}
_DATES = [re.compile(x) for x in (r"(?:19|20)\d\d", r"[0-3]?\d[./-][0-3]?\d[./-](?:19|20)?\d\d", r"(?:19|20)\d\d[./-]?[0-1]\d[./-]?[0-3]\d", r"[0-3]\d[0-1]\d(?:19|20)\d\d")]
_YEAR, _DAY = math.log10(120), math.log10(120 * 365)
_LEET = str.maketrans("04315@$!7", "oaeisasit")
_HEX = np.zeros(256, bool)
_HEX[list(HEX_DIGITS)] = True


class Words:
    """Ranks of words: that of the fixed list or of the learnt one, whichever is better."""

    def __init__(self, learnt: list[str] = ()):
        self.rank: Mapping[str, int] = {**{w: i + 1 for i, w in enumerate(learnt)}}
        for w, r in _RANK.items():
            self.rank[w] = min(r, self.rank.get(w, r))
        self.longest = max(map(len, self.rank))

    def cost(self, value: str, low: str, plain: str, i: int, j: int) -> float:
        """Log10 of the guesses for the word at ``i:j``, infinite where there is none. Swapped digits double it."""
        rank = min(self.rank.get(low[i:j], math.inf), 2 * self.rank.get(plain[i:j], math.inf))
        if rank == math.inf:
            return rank
        return math.log10(rank + 1) + (0.0 if value[i:j] == low[i:j] else 0.3 if value[i + 1 : j] == low[i + 1 : j] else 1.0)


_FIXED = Words()


def alphabet(value: str) -> int:
    """Characters that brute force tries at each place."""
    classes = [(10, str.isdigit), (26, str.islower), (26, str.isupper)]
    size = sum(k for k, test in classes if any(map(test, value))) + (30 if any(not c.isalnum() for c in value) else 0)
    return max(size, 10)


def folded(value: str) -> tuple[str, str]:
    """The value in lower case, and that with digits and signs read as letters, place by place."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    return low, low.translate(_LEET)


def log_guesses(value: str, words: Words = _FIXED, enough: float = math.inf) -> float:
    """Log10 of the guesses for ``value``: the cheapest row of parts. Costs only grow along a row, so as soon as everything that
    a later position can build upon has reached ``enough``, the answer has too and the rest need not be read; what is returned then is at
    least ``enough`` and no more than the minimum. Work and memory are linear in the length."""
    n = len(value)
    low, plain = folded(value)
    per_char = math.log10(alphabet(value))
    best, part = [0.0] + [math.inf] * n, [0.0] + [PART_COST] * n
    brute = walk = math.inf
    repeats = [math.inf] * (PERIOD + 1)
    dated: dict[int, list[tuple[int, float]]] = {}
    for j in range(1, n + 1):
        for k, date in enumerate(_DATES):
            if found := date.match(value, j - 1):
                dated.setdefault(found.end(), []).append((j - 1, _DAY if k else _YEAR))
        brute = min(best[j - 1] + part[j - 1], brute) + per_char
        now = brute
        linked = j > 1 and low[j - 2 : j] in _NEXT
        walk = walk + STEP_COST if linked else math.inf
        if linked and j >= WALK and low[j - 3 : j - 1] in _NEXT:
            walk = min(walk, best[j - WALK] + part[j - WALK] + WALK_COST + (WALK - 1) * STEP_COST)
        now = min(now, walk)
        for unit in range(1, min(PERIOD, j - 1) + 1):
            if value[j - 1] != value[j - 1 - unit]:
                repeats[unit] = math.inf
                continue
            i = j - 1 - unit
            repeats[unit] = min(repeats[unit], best[i] + part[i] + unit * per_char + REPEAT_COST) + STEP_COST
            now = min(now, repeats[unit])
        for i in range(max(0, j - words.longest), j - WORD_LETTERS[0] + 1):
            now = min(now, best[i] + part[i] + words.cost(value, low, plain, i, j))
        for i, cost in dated.pop(j, ()):
            now = min(now, best[i] + part[i] + cost)
        best[j] = now
        # a part that ends later begins within the longest word (or the ten characters of a date) or is one of the open ones
        if now >= enough and min(brute, *best[max(0, j - max(words.longest, 10)) : j + 1]) >= enough and min(walk, *repeats) >= enough:
            return now if j == n else enough
    return best[n]


def scan(text: bytes, hexes: list[tuple[int, int]], words: Words = _FIXED) -> list[tuple[str, int, int]]:
    """Spans in bytes, by start and kind: of the patterns, then values that the context adds."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [("hex", i, j) for i, j in hexes]
    starts, ends = _merged(spans)
    for m in CONTEXT.finditer(text):
        i = m.start(1)
        value = m[1].decode(errors="replace").rstrip(".!?)")
        j = i + len(value.encode())
        at = bisect_right(starts, i) - 1
        if len(value) < MIN_VALUE or "\ufffd" in value or (at >= 0 and j <= ends[at]) or not any(c.isdigit() or c.lower() != c.upper() for c in value):
            continue
        if log_guesses(value, words, MIN_LOG_GUESSES) >= MIN_LOG_GUESSES:
            spans.append(("guess", i, j))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of what the spans cover, those that touch as one."""
    starts, ends = [], []
    for _, i, j in sorted(spans, key=lambda s: s[1]):
        if ends and i <= ends[-1]:
            ends[-1] = max(ends[-1], j)
        else:
            starts.append(i)
            ends.append(j)
    return starts, ends


def spans_of(texts: Texts, words: Words = _FIXED) -> dict[int, list[tuple[str, int, int]]]:
    """Spans in bytes of the texts that have any, by text."""
    hexes: dict[int, list] = {}
    inside = _HEX[texts.data]
    if inside.any():
        change = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        for i, j in zip(*_long(np.flatnonzero(change == 1), np.flatnonzero(change == -1))):
            while i < j:  # a run goes on into the next text only in this buffer
                k = int(np.searchsorted(texts.offsets, i, "right")) - 1
                end = min(j, int(texts.offsets[k + 1]))
                if end - i >= MIN_HEX:
                    hexes.setdefault(k, []).append((i - int(texts.offsets[k]), end - int(texts.offsets[k])))
                i = end
    low = texts.lowered().tobytes()
    wanted = set(hexes)
    for hint in (*HINTS, b"akia"):
        at = low.find(hint)
        while at >= 0:
            k = int(np.searchsorted(texts.offsets, at, "right")) - 1
            wanted.add(k)
            at = low.find(hint, max(at + 1, int(texts.offsets[k + 1]) - len(hint)))
    out = {}
    for k in sorted(wanted):
        raw = texts.data[texts.offsets[k] : texts.offsets[k + 1]].tobytes()
        if found := scan(raw, hexes.get(k, []), words):
            out[k] = found
    return out


def _long(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    keep = ends - starts >= MIN_HEX
    return starts[keep].tolist(), ends[keep].tolist()


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{i}:{j}" for kind, i, j in spans)


SCHEMA = "doc_id BIGINT, n_assign BIGINT, n_access BIGINT, n_hex BIGINT, base_sha256 STRING, spans STRING, n_added BIGINT"


def frequent_words(docs: DataFrame, text: str = "text", limit: int = WORDS) -> list[str]:
    """The most frequent words (runs of letters in lower case) of all texts, the most frequent first, equally frequent ones by name: all
    of every level of counts (an eighth of a doubling each) down to the last with which there are no more than ``limit``. Credential contexts are
    cut out before. Words are counted in partial sums, so no word is hot; the size of each level (a few hundred) and ``limit`` words at most come to the driver."""
    least, most = WORD_LETTERS
    plain = F.col(f"`{text}`").cast("string")
    low = F.lower(plain)
    named = reduce(or_, (low.contains(hint.decode()) for hint in HINTS))
    prose = F.lower(F.when(named, F.regexp_replace(plain, CONTEXT.pattern.decode(), " ")).otherwise(plain))
    word = F.regexp_extract_all(prose, F.lit(rf"(?<!\p{{L}})\p{{L}}{{{least},{most}}}(?!\p{{L}})"), F.lit(0))
    counts = docs.select(F.explode(word).alias("word")).groupBy("word").count()
    counts = cut_lineage(counts.withColumn("level", F.floor(8 * F.log2("count"))))
    cut, total = None, 0
    for level, size in sorted(map(tuple, counts.groupBy("level").agg(F.count("*")).collect()), reverse=True):
        total += size
        if total > limit:
            break
        cut = level
    found = [] if cut is None else counts.where(F.col("level") >= cut).select("word", "count").collect()
    return [r["word"] for r in sorted(found, key=lambda r: (-r["count"], r["word"]))]


def _mapper(learnt: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty, words = hashlib.sha256(b"").hexdigest(), Words(learnt)
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                n, found = len(texts), spans_of(texts, words)
                counts, digests, joined = np.zeros((4, n), np.int64), [empty] * n, [""] * n
                points = texts.code_points() if found else None
                for k, spans in found.items():
                    low = int(texts.offsets[k])
                    spans = [(kind, int(points[low + i] - points[low]), int(points[low + j] - points[low])) for kind, i, j in spans]
                    for kind, _, _ in spans:
                        counts[KINDS.index(kind), k] += 1
                    digests[k] = hashlib.sha256(_joined([s for s in spans if s[0] != "guess"]).encode()).hexdigest()
                    joined[k] = _joined(spans)
                ids = batch.column("doc_id").slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c) for c in counts[:3]), pa.array(digests), pa.array(joined), pa.array(counts[3])],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"],
                )

    return run


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", learnt: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs`` with its spans. Without ``learnt``, words are learnt from ``docs`` first."""
    plain = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    return plain.mapInArrow(_mapper(frequent_words(docs, text) if learnt is None else learnt), SCHEMA)


def _masker(text: str, mask: bytes, learnt: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(learnt)
        for batch in batches:
            column, new = batch.column(text), {}
            for at, texts in slices(column):
                for k, spans in spans_of(texts, words).items():
                    raw = texts.data[texts.offsets[k] : texts.offsets[k + 1]].tobytes()
                    out, end = [], 0
                    for _, i, j in spans:
                        if i >= end:
                            out += [raw[end:i], mask]
                        end = max(end, j)
                    new[at + k] = b"".join([*out, raw[end:]]).decode()
            if new:
                changed = np.zeros(len(column), bool)
                changed[list(new)] = True
                column = pc.replace_with_mask(column, pa.array(changed), pa.array([new[k] for k in sorted(new)], column.type))
            place = batch.schema.get_field_index(text)
            yield batch.set_column(place, batch.schema.field(place), column)

    return run


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", learnt: list[str] | None = None) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mask``; all columns stay. Words are learnt as for the spans."""
    return docs.mapInArrow(_masker(text, mask.encode(), frequent_words(docs, text) if learnt is None else learnt), docs.schema)


def op7_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
