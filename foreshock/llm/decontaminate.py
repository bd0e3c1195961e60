"""Benchmark decontamination by template canonicalisation.

Texts become tokens (numbers, and runs of letters; a capitalised word inside a sentence carries a name mark). A window of
``n`` tokens becomes a template: lower case, with typed placeholders for numbers, names, and units that follow a number. Items are cut into
windows side by side, of which there is at least one more than tokens that ``COVERAGE`` lets differ; documents have a window at every
position. So wherever an item stands in a document, one of its windows is met whole. Windows
are joined by their hash; each hit says where the whole item would lie. There item and document are compared token by token, where that does
not suffice also with words put in or left out (in order, at offsets that differ by no more than the tokens that may be missing), and the slots are
checked: where values differ, equal values of the item must stand for equal values of the document and the other way round, which a
question with other numbers, names or units keeps and a chance likeness breaks. Values that stand as they are (whatever their case or mark) are always
consistent; ``COVERAGE`` of the slots must be, unless the tokens that stand as they are reach half-way from ``COVERAGE`` to all.

Windows that consist of placeholders alone are compared as they
stand. The windows of the benchmark are joined like any table; Spark sends them to all tasks only where their size allows. A document is cut into
tokens once, whatever the number of window lengths, and its windows are hashed as they are taken, in compiled code.

Defined results: null and empty texts and items have no tokens and no hits. Repeated rows of documents with one id and text give one
result, as do repeated items; rows without id are reported with a null id. Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.sources.tables import cut_lineage

WINDOW = 6
#: Share of an item's tokens that must stand in the document.
COVERAGE = 0.8

# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd yard yards mi mile inch inches foot feet miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "g kg mg lb lbs oz gram grams kilogram kilograms pound pounds s sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years l ml liter liters litre litres gallon gallons mph kmh usd eur gbp dollar dollars euro euros "
    "cent cents percent degree degrees"
).split()

MARK, NUMBER, UNIT = "§", "0", "%"
NAME = r" (?=\p{Lu}\p{L})(?<=[\p{Ll}\p{N},;] )"  # the blank before a name
TOKEN = rf"\p{{N}}(?:[\p{{N}}.,:/]*\p{{N}})?|{MARK}?\p{{L}}+"


def tokens(text: Column) -> Column:
    """Tokens of a text; names begin with the mark."""
    marked = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(" ")), NAME, f" {MARK}")
    return F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, however often what follows uses them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def with_forms(df: DataFrame, text: str = "text") -> DataFrame:
    """Tokens of ``text`` as three arrays of the same length in place of it: ``plain``, in lower case without marks, ``form``, with all
    placeholders, and ``counted``, with those of numbers and units only. Tokens hold no blanks, so whole texts are rewritten at
    once. Rows without tokens are left out."""
    line = _once(df, line=F.lower(F.array_join(tokens(F.col(text)), " "))).drop(text).where("line <> ''")
    counted = F.regexp_replace("line", r"\p{N}[^ ]*+", NUMBER)
    measured = F.regexp_replace(counted, rf"{NUMBER} (?:{'|'.join(UNITS)})(?![^ ])", f"{NUMBER} {UNIT}")
    bare = lambda x: F.replace(x, F.lit(MARK), F.lit(""))
    line = _once(line, measured=measured)
    lines = {"plain": bare(F.col("line")), "form": F.regexp_replace("measured", rf"{MARK}\p{{L}}+", MARK), "counted": bare(F.col("measured"))}
    return _once(line, **{name: F.split(x, " ") for name, x in lines.items()}).drop("line", "measured")


def slot(x: Column) -> Column:
    return x.isin(NUMBER, MARK, UNIT)


def document_windows(formed: DataFrame, lengths: list[int]) -> DataFrame:
    """Windows of all lengths at every position: as they stand, with placeholders where these leave a literal token, and with names as
    they stand beside placeholders of numbers and units (a capital letter need not make a name). Length and kind are columns, so that the compiled
    code holds one window."""
    kinds, places = ("plain", "form", "counted"), range(max(lengths))
    hashed = formed.select("doc_id", "text_hash", *(F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in kinds)).where(F.size("plain") >= min(lengths))
    cut = hashed.select("*", F.explode(F.sequence(F.lit(0), F.size("plain") - min(lengths))).alias("block"))
    cut = cut.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where("block + n <= size(plain)")
    token = lambda c, j: F.get(c, F.col("block") + j)
    count = lambda *slots: sum(
        F.when((F.col("n") > j) & token("form", j).isin(*slots), 1).otherwise(0) for j in places
    )
    name, number, unit = (F.xxhash64(F.lit(x)) for x in (MARK, NUMBER, UNIT))
    cut = cut.select("*", count(name).alias("names"), count(number, unit).alias("numbers"))
    some, both = F.col("names") + F.col("numbers"), (F.col("names") > 0) & F.col("numbers").between(1, F.col("n") - 1)
    kind = F.explode(F.array(F.lit(0), F.when(some.between(1, F.col("n") - 1), 1), F.when(both, 2))).alias("kind")
    cut = cut.select("*", kind).where("kind IS NOT NULL")
    one = [F.when(F.col("n") > j, F.when(F.col("kind") == 0, token("plain", j)).when(F.col("kind") == 1, token("form", j)).otherwise(token("counted", j))) for j in places]
    return cut.select("doc_id", "text_hash", "block", F.xxhash64("n", *one).alias("key"))


def item_windows(wanted: DataFrame, n: int) -> DataFrame:
    """Windows side by side, in each form that a document's window can have: a name may be marked there or not."""
    mine = wanted.where(F.col("n") == n)
    places = F.transform(F.sequence(F.lit(0), F.floor(F.size("plain") / n).cast("int") - 1), lambda k: k * n)
    cut = mine.select("item_id", "plain", "form", "capital", F.explode(places).alias("place"))

    def forms(k: Column) -> Column:
        literal = F.get("plain", k)
        either = F.when(F.get("capital", k), F.array(F.lit(MARK), literal)).otherwise(F.array(literal))
        return F.when(F.get("form", k).isin(NUMBER, UNIT), F.array(F.get("form", k))).otherwise(either)

    rows = F.array(F.array().cast("array<string>"))
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("place") + k)
    rows = F.aggregate(spots, rows, lambda acc, k: F.flatten(F.transform(acc, lambda a: F.transform(forms(k), lambda f: F.concat(a, F.array(f))))))
    as_is = F.array(F.slice("plain", F.col("place") + 1, n))
    each = cut.select("item_id", "place", F.explode(F.array_union(as_is, rows)).alias("one"))
    return each.select("item_id", "place", F.xxhash64(F.lit(n), *(F.xxhash64(F.get("one", F.lit(j))) for j in range(n))).alias("key")).distinct()


def items(benchmark: DataFrame, n: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """Items with their tokens and the length of their windows: with one more window than tokens that may differ, one is met whole."""
    plain = benchmark.selectExpr("CAST(item_id AS BIGINT) AS item_id", "CAST(text AS STRING) AS text").distinct()
    plain = with_forms(plain.withColumn("capital", F.transform(tokens(F.col("text")), lambda x: x.rlike(rf"^{MARK}?\p{{Lu}}"))))
    edits = F.size("plain") - F.ceil(F.size("plain") * F.lit(coverage)).cast("int")
    return plain.withColumn("n", F.least(F.lit(n), F.floor(F.size("plain") / (edits + 1))).cast("int"))


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and item that it holds: ``doc_id, text_hash, item_id, start, n_tokens, n_matched, n_slots,
    reworded``."""
    wanted = cut_lineage(items(benchmark, n, coverage))
    lengths = [r[0] for r in wanted.select("n").distinct().orderBy("n").collect()]  # at most n numbers
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if lengths:
        formed = with_forms(plain.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"))
        asked = item_windows(wanted, lengths[0])
        for k in lengths[1:]:
            asked = asked.unionByName(item_windows(wanted, k))
        hits = document_windows(formed, lengths).join(cut_lineage(asked), "key")
        hits = hits.select("doc_id", "text_hash", "item_id", (F.col("block") - F.col("place")).alias("start"))
    else:
        hits = plain.selectExpr("doc_id", "0L AS text_hash", "0L AS item_id", "0 AS start").limit(0)
    hits = cut_lineage(hits.distinct())

    some = hits.select("doc_id", "text_hash").distinct().withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    same = (F.xxhash64("text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = plain.join(some, same, "left_semi").distinct()
    texts = with_forms(texts.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text"))
    both = hits.join(texts, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_hash")
    both = both.join(wanted.selectExpr("item_id AS _item", "plain AS item", "form AS item_form"), F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    # the stretch of the document where the item may lie, with room for the words that may be put in or left out
    reach = F.size("item") - F.ceil(F.size("item") * F.lit(coverage)).cast("int")
    both = both.withColumn("reach", reach).withColumn("low", F.greatest(F.col("start") - F.col("reach"), F.lit(0)))
    span = F.col("start") + F.size("item") + F.col("reach") - F.col("low")
    near = [F.slice(c, F.col("low") + 1, span).alias(c) for c in ("plain", "form")]
    both = cut_lineage(both.select("doc_id", "text_hash", "item_id", "start", "item", "item_form", "reach", "low", *near))

    straight = cut_lineage(_compared(_once(both, pairs=_straight()), coverage))
    one = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("text_hash") == F.col("_hash")) & (F.col("item_id").eqNullSafe(F.col("_item")))
    done = straight.selectExpr("doc_id AS _id", "text_hash AS _hash", "item_id AS _item")
    rest = both.join(done, one, "left_anti").where(F.col("reach") > 0).where(_may_suffice(coverage))
    return straight.unionByName(_compared(_shifted(rest), coverage))


def _same(i: Column, j: Column) -> Column:
    """Whether token ``i`` of the item and ``j`` of the stretch are equal, or of one type."""
    return (F.get("item_form", i) == F.get("form", j)) | (F.get("item", i) == F.get("plain", j))


def _pair(i: Column, j: Column) -> Column:
    return F.struct(F.get("item", i).alias("a"), F.get("plain", j).alias("b"), slot(F.get("item_form", i)).alias("slot"))


def _straight() -> Column:
    """Equal tokens of the item and of the document from ``start``, at one offset."""
    back = F.col("start") - F.col("low")
    at = F.filter(F.sequence(F.lit(0), F.size("item") - 1), lambda i: F.coalesce(_same(i, back + i), F.lit(False)))
    return F.transform(at, lambda i: _pair(i, back + i))


def _may_suffice(coverage: float) -> Column:
    """Whether enough of the item's tokens occur in the stretch at all, in whatever order."""
    either = lambda i: F.array_contains("form", F.get("item_form", i)) | F.array_contains("plain", F.get("item", i))
    return F.size(F.filter(F.sequence(F.lit(0), F.size("item") - 1), either)) >= F.ceil(F.size("item") * F.lit(coverage))


def _shifted(both: DataFrame) -> DataFrame:
    """Longest row of equal tokens in order, at offsets from ``start`` that differ by no more than tokens may be missing. ``ends`` holds, for
    the item's tokens so far and each offset, the places (item, stretch) of the longest row that ends there or before."""
    out = both.withColumn("back", F.col("start") - F.col("reach") - F.col("low")).withColumn("offsets", F.sequence(F.lit(0), 2 * F.col("reach")))
    longer = lambda x, y: F.when(F.size(x) >= F.size(y), x).otherwise(y)
    none = F.array().cast("array<struct<i:int,j:int>>")

    def met(ends: Column, i: Column, d: Column) -> Column:
        j = F.col("back") + i + d
        at = F.array(F.struct(i.cast("int").alias("i"), j.cast("int").alias("j")))
        with_it = F.when(_same(i, j), F.concat(F.get(ends, d), at)).otherwise(F.get(ends, d))
        return longer(with_it, F.coalesce(F.get(ends, d + 1), none))

    def step(ends: Column, i: Column) -> Column:
        own = F.transform("offsets", lambda d: met(ends, i, d))
        empty = F.array().cast("array<array<struct<i:int,j:int>>>")
        return F.aggregate(own, empty, lambda acc, x: F.concat(acc, F.array(longer(x, F.coalesce(F.try_element_at(acc, F.lit(-1)), none)))))

    ends = F.aggregate(F.sequence(F.lit(0), F.size("item") - 1), F.transform("offsets", lambda _: none), step)
    out = _once(out, places=F.element_at(ends, -1)).where(F.size("places") > 0)
    out = out.withColumn("start", F.col("low") + F.get("places", F.lit(0))["j"] - F.get("places", F.lit(0))["i"])
    return _once(out, pairs=F.transform("places", lambda p: _pair(p["i"], p["j"])))


def _compared(out: DataFrame, coverage: float) -> DataFrame:
    """The best placing of each item whose equal tokens and slots suffice."""
    out = out.withColumn("n_matched", F.size("pairs").cast("bigint")).withColumn("n_tokens", F.size("item").cast("bigint"))
    out = out.where(F.col("n_matched") >= F.ceil(F.col("n_tokens") * coverage))
    out = _once(out, met=F.filter("pairs", lambda p: p["slot"]))
    out = _once(out, slots=F.array_distinct("met"), changed=F.filter("met", lambda p: p["a"] != p["b"]))
    out = _once(out, swaps=F.array_distinct("changed"))
    alone = lambda p: F.size(F.filter("swaps", lambda q: (q["a"] == p["a"]) | (q["b"] == p["b"]))) == 1
    broken = F.size("changed") - F.size(F.filter("changed", alone))
    kept = F.col("n_matched") - F.size("changed")
    consistent = (F.size("met") - broken >= F.ceil(F.size("met") * coverage)) | (kept >= F.ceil(F.col("n_tokens") * (1 + coverage) / 2))
    out = out.where(consistent).select(
        "doc_id", "text_hash", "item_id", F.col("start").cast("bigint").alias("start"), "n_tokens", "n_matched",
        F.size("slots").cast("bigint").alias("n_slots"), (F.size("changed") > 0).alias("reworded"),
    )
    best = F.max(F.struct("n_matched", (-F.col("start")).alias("back"), "n_tokens", "n_slots", "reworded")).alias("best")
    out = out.groupBy("doc_id", "text_hash", "item_id").agg(best)
    return out.selectExpr(
        "doc_id", "text_hash", "item_id", "-best.back AS start", "best.n_tokens", "best.n_matched", "best.n_slots", "best.reworded"
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay."""
    # written first: its size is known then, and where it is small the texts need no shuffle
    found = cut_lineage(leaks(docs, benchmark).selectExpr("doc_id AS _id", "text_hash AS _hash").distinct())
    same = (F.xxhash64(F.col("text").cast("string")) == F.col("_hash")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id"))
    return docs.join(found, same, "left_anti")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark).drop("text_hash")


def _oracle() -> str:
    """The same rules in SQL: windows at every position, one offset, then shifted ones."""
    words = (
        rf"regexp_extract_all(regexp_replace(regexp_replace(replace(coalesce(text, ''), '{MARK}', ' '), "
        rf"'([\p{{Ll}}\p{{N}},;] )(\p{{Lu}}\p{{L}}+)', '\1{MARK}\2', 'g'), '([\p{{Ll}}\p{{N}},;] )(\p{{Lu}}\p{{L}}+)', '\1{MARK}\2', 'g'), '{TOKEN}')"
    )
    typed = rf"list_transform(words, lambda x: CASE WHEN regexp_matches(x, '^\p{{N}}') THEN '{NUMBER}' WHEN starts_with(x, '{MARK}') THEN '{MARK}' ELSE lower(x) END)"
    units = ", ".join(f"'{u}'" for u in UNITS)
    formed = (
        f"SELECT *, list_transform(form, lambda x, i: CASE WHEN x = '{MARK}' THEN plain[i] ELSE x END) AS counted FROM ("
        f"SELECT * EXCLUDE (typed), list_transform(typed, lambda x, i: CASE WHEN i > 1 AND typed[i - 1] = '{NUMBER}' AND x IN ({units}) THEN '{UNIT}' ELSE x END) AS form "
        f"FROM (SELECT *, list_transform(words, lambda x: lower(ltrim(x, '{MARK}'))) AS plain, {typed} AS typed FROM"
    )
    slots = f"('{NUMBER}', '{MARK}', '{UNIT}')"
    enough = f"ceil(size * {COVERAGE!r}::DOUBLE)"
    straight = f"""(SELECT *, list_transform(list_filter(range(0, size), lambda i: start + i >= 0 AND start + i < len(plain)
     AND (item_form[i + 1] = form[start + i + 1] OR item[i + 1] = plain[start + i + 1])),
     lambda i: {{'a': item[i + 1], 'b': plain[start + i + 1], 'slot': item_form[i + 1] IN {slots}}}) AS pairs FROM placed)"""
    shifted = f"""(SELECT r.* EXCLUDE (start), chain[1].j - chain[1].i AS start,
     list_transform(chain, lambda q: {{'a': item[q.i + 1], 'b': plain[q.j + 1], 'slot': item_form[q.i + 1] IN {slots}}}) AS pairs
     FROM (SELECT rest.*, ends[-1] AS chain FROM rest JOIN chains ON chains.no = rest.no AND chains.i = rest.size) r WHERE len(chain) > 0)"""

    def judged(pairs: str) -> str:
        return f"""(
  SELECT doc_id, text, item_id, start, size::BIGINT AS n_tokens, len(pairs)::BIGINT AS n_matched, len(list_distinct(met))::BIGINT AS n_slots, len(changed) > 0 AS reworded
  FROM (SELECT *, list_distinct(changed) AS swaps FROM (SELECT *, list_filter(met, lambda p: p.a <> p.b) AS changed
        FROM (SELECT *, list_filter(pairs, lambda p: p.slot) AS met FROM {pairs})))
  WHERE len(pairs) >= {enough}
    AND (len(met) - len(list_filter(changed, lambda p: len(list_filter(swaps, lambda q: q.a = p.a OR q.b = p.b)) <> 1)) >= ceil(len(met) * {COVERAGE!r}::DOUBLE)
         OR len(pairs) - len(changed) >= ceil(size * {1 + COVERAGE!r}::DOUBLE / 2)))"""

    return rf"""
WITH RECURSIVE
d AS ({formed} (SELECT DISTINCT doc_id, text, {words} AS words FROM documents)) WHERE len(words) > 0)),
b AS (SELECT *, len(plain) AS size, (len(plain) - ceil(len(plain) * {COVERAGE!r}::DOUBLE))::INT AS reach,
      least({WINDOW}, len(plain) // ((len(plain) - ceil(len(plain) * {COVERAGE!r}::DOUBLE))::INT + 1)) AS n
      FROM ({formed} (SELECT DISTINCT item_id, {words} AS words FROM benchmark)) WHERE len(words) > 0))),
dp AS (SELECT doc_id, text, n, pos, plain[pos + 1 : pos + n] AS win, form[pos + 1 : pos + n] AS typed, counted[pos + 1 : pos + n] AS counted FROM (
  SELECT doc_id, text, plain, form, counted, n, unnest(range(0, len(plain) - n + 1)) AS pos FROM d, (SELECT DISTINCT n FROM b) WHERE len(plain) >= n)),
dw AS (SELECT doc_id, text, n, pos, win AS key FROM dp
       UNION SELECT doc_id, text, n, pos, typed FROM dp WHERE len(list_filter(typed, lambda x: x IN {slots})) BETWEEN 1 AND n - 1
       UNION SELECT doc_id, text, n, pos, counted FROM dp WHERE list_contains(typed, '{MARK}')
             AND len(list_filter(typed, lambda x: x IN ('{NUMBER}', '{UNIT}'))) BETWEEN 1 AND n - 1),
bp AS (SELECT item_id, n, unnest(range(0, n * (len(plain) // n), n)) AS pos, words, plain, form FROM b),
bf(item_id, n, pos, k, words, plain, form, key) AS (
  SELECT item_id, n, pos, 0, words[pos + 1 : pos + n], plain[pos + 1 : pos + n], form[pos + 1 : pos + n], []::VARCHAR[] FROM bp
  UNION ALL
  SELECT item_id, n, pos, k + 1, words, plain, form, list_append(key, unnest(
    CASE WHEN form[k + 1] IN ('{NUMBER}', '{UNIT}') THEN [form[k + 1]] WHEN regexp_matches(words[k + 1], '^{MARK}?\p{{Lu}}') THEN ['{MARK}', plain[k + 1]] ELSE [plain[k + 1]] END))
  FROM bf WHERE k < n),
bw AS (SELECT item_id, n, pos, key FROM bf WHERE k = n UNION SELECT item_id, n, pos, plain FROM bf WHERE k = 0),
h AS MATERIALIZED (SELECT DISTINCT dw.doc_id, dw.text, bw.item_id, dw.pos - bw.pos AS start FROM dw JOIN bw ON dw.n = bw.n AND dw.key = bw.key),
placed AS MATERIALIZED (SELECT h.doc_id, h.text, h.item_id, h.start, b.plain AS item, b.form AS item_form, b.size, b.reach, d.plain, d.form
  FROM h JOIN b ON b.item_id IS NOT DISTINCT FROM h.item_id JOIN d ON d.doc_id IS NOT DISTINCT FROM h.doc_id AND d.text IS NOT DISTINCT FROM h.text),
straight AS MATERIALIZED (SELECT * FROM {judged(straight)}),
rest AS MATERIALIZED (SELECT row_number() OVER () AS no, * FROM placed r WHERE reach > 0 AND NOT EXISTS (SELECT 1 FROM straight s
         WHERE s.doc_id IS NOT DISTINCT FROM r.doc_id AND s.text IS NOT DISTINCT FROM r.text AND s.item_id IS NOT DISTINCT FROM r.item_id)),
-- longest common rows, one token of the item after another; an entry of ends for each offset
chains(no, i, ends) AS (
  SELECT no, 0, list_transform(range(0, 2 * reach + 1), lambda d: []::STRUCT(i BIGINT, j BIGINT)[]) FROM rest
  UNION ALL
  SELECT no, i + 1, list_transform(range(1, len(own) + 1), lambda d: list_reduce(own[1 : d], lambda x, y: CASE WHEN len(y) >= len(x) THEN y ELSE x END)) FROM (
    SELECT chains.no, chains.i, list_transform(range(0, 2 * reach + 1), lambda d: CASE
        WHEN start - reach + chains.i + d BETWEEN greatest(start - reach, 0) AND least(start + size + reach, len(plain)) - 1
             AND (item_form[chains.i + 1] = form[start - reach + chains.i + d + 1] OR item[chains.i + 1] = plain[start - reach + chains.i + d + 1])
             AND len(ends[d + 1]) + 1 >= coalesce(len(ends[d + 2]), 0)
        THEN list_append(ends[d + 1], {{'i': chains.i::BIGINT, 'j': (start - reach + chains.i + d)::BIGINT}})
        WHEN coalesce(len(ends[d + 2]), 0) > len(ends[d + 1]) THEN ends[d + 2] ELSE ends[d + 1] END) AS own
    FROM chains JOIN rest ON rest.no = chains.no WHERE chains.i < size)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY n_matched DESC, start, n_tokens DESC, n_slots DESC, reworded DESC) AS k
      FROM (SELECT * FROM straight UNION ALL SELECT * FROM {judged(shifted)}))
SELECT doc_id, item_id, start::BIGINT AS start, n_tokens, n_matched, n_slots, reworded FROM r WHERE k = 1
"""


ORACLE_OP10 = _oracle()
