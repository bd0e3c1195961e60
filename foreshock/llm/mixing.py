"""Mixing sources to target weights by Pareto order sampling.

A source whose target is ``m`` times its size takes each of its documents ``floor(m)`` times for certain. The rest of the
target is a fixed-size sample: each document gets the rank ``U / (1 - U) / odds``, random odds over the odds of its
inclusion, and the lowest ranks are taken until their words fill the rest. Inclusion odds are those of the rest's share of
the source, tilted towards short documents by ``sqrt(mean size / size)``, so that a few very long ones rarely fill
a rest. ``U`` is a digest of the id and a seed: reruns agree.

Ranks are never sorted as a whole. A histogram over ten bits of the rank per step narrows each source's cut to one
cell, until a cell holds few rows; only those are ordered. So a source with a third of all rows is
counted in partial sums. Sources get their weights by position in a range-sorted table of sources.

Defined results: null texts and texts without words have size 0 and take 0 words; rows with the same id, source and size
share a rank and are taken together; rows without id share the digest of the empty text; null is a source of its own, the
last. With no words at all every target is 0. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foreshock.sources.tables import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20240
#: Bits of a rank, bits a histogram step settles, and rows of a cell that are ordered at once.
BITS, STEP_BITS, CELL_ROWS = 50, 10, 20_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def measured(docs: DataFrame, keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size, u`` of every row, and the columns to ``keep``."""
    digest = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{SEED}"))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
    plain = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        words_in(F.col(f"`{text}`").cast("string")).alias("size"),
        *[F.col(f"`{c}`") for c in keep],
    )
    return plain.withColumn("u", u)


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Sources with the repeating weights in code point order, null last: positions are counted within the parts of
    a range-sorted table, plus the sizes of the parts before."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = cut_lineage(ranged.select("*", F.monotonically_increasing_id().alias("at")))
    ranged = ranged.selectExpr("*", "shiftright(at, 33) AS part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part of the table
    offset = ranged.groupBy("part").agg(F.count("*").alias("n"))
    offset = offset.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.expr("at & 8589934591")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    return ranged.join(offset, "part").select(*sources.columns, weight.alias("weight"))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Shares by weight of all words, stopped at ``most`` times a source's size; what is cut off is dealt anew
    among the others until none is above. Each round is one sum over the table of sources."""
    sources = cut_lineage(sources)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rest, weight = total, None
    while True:
        full = F.lit(False) if weight is None else _above(rest, weight, most)
        row = sources.select("source_size", "weight", full.alias("full")).agg(
            F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0)),
        ).first()
        new = (total - most * row[0], row[1])
        if new == (rest, weight):
            break
        rest, weight = new
    if not weight:
        return sources.withColumn("target", (F.col("source_size") * most).cast("double"))
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(weight))
    return sources.withColumn("target", F.when(_above(rest, weight, most), (F.col("source_size") * most).cast("double")).otherwise(share))


def _above(rest: int, weight: int, most: int) -> Column:
    """Whether a source's share would be above its stop, in whole numbers."""
    exact = T.DecimalType(38, 0)
    share = F.lit(rest).cast(exact) * F.col("weight").cast("decimal(9,0)")
    stop = F.lit(most * max(weight, 1)).cast("decimal(18,0)") * F.col("source_size").cast("decimal(19,0)")
    return share > stop


def ranked(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's figures, their rank and its first ``BITS`` bits."""
    joined = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    size = F.greatest(F.col("size"), F.lit(1)).cast("double")
    share = F.col("rest") / F.col("source_size")
    odds = F.when(F.col("rest") > 0, share / (1 - share) * F.sqrt(F.col("mean_size") / size))
    rank = F.col("u") / (1 - F.col("u")) / odds
    joined = joined.withColumn("rank", rank)
    return joined.withColumn("place", F.floor(F.col("rank") / (1 + F.col("rank")) * float(1 << BITS)).cast("bigint"))


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: its size and target, the certain copies, and the last rank that is taken."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = targets(weighted(sizes, weights), most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("bigint")
    sources = sources.withColumn("whole", whole).select(
        "source", "source_size", "target", "whole",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"),
        (F.col("source_size") / F.col("n")).alias("mean_size"),
    )
    sources = cut_lineage(sources)
    drawn = ranked(rows, sources.where("rest > 0")).where("size > 0")

    cell = cut_lineage(sources.where("rest > 0").selectExpr("source", "rest", "0L AS cell", "0L AS taken"))
    bits = 0
    while bits < BITS:
        bits += STEP_BITS
        inside = _inside(drawn, cell, bits - STEP_BITS)
        heaps = inside.groupBy("source", "rest", "taken", F.shiftright("place", BITS - bits).alias("cell"))
        heaps = heaps.agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        heaps = heaps.withColumn("taken", F.col("taken") + F.coalesce(F.sum("words").over(before), F.lit(0)))
        last = heaps.where("taken <= rest").groupBy("source", "rest").agg(F.max_by(F.struct("cell", "taken", "n"), "cell").alias("x"))
        cell = cut_lineage(last.select("source", "rest", "x.cell", "x.taken", "x.n"))
        if (cell.agg(F.max("n")).first()[0] or 0) <= CELL_ROWS:
            break

    order = ["place", "rank", "size", "doc_id"]
    so_far = Window.partitionBy("source").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = _inside(drawn, cell, bits)
    inside = inside.groupBy("source", "rest", "taken", *order).agg(F.sum("size").alias("words"))
    inside = inside.withColumn("filled", F.col("taken") + F.sum("words").over(so_far) - F.col("words") / 2)
    end = inside.where("filled <= rest").groupBy("source").agg(F.max(F.struct(*order)).alias("last"))
    ends = cell.join(end.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source", F.shiftleft("cell", BITS - bits).alias("first_place"), "last"
    )
    ends = ends.withColumnRenamed("source", "_source")
    return cut_lineage(sources.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"))


def _inside(drawn: DataFrame, cell: DataFrame, bits: int) -> DataFrame:
    """The rows in each source's cell."""
    other = cell.selectExpr("source AS _source", "cell AS _cell", "taken")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("place", BITS - bits) == F.col("_cell"))
    return drawn.join(other, same).drop("_source", "_cell")


def mixed(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows with the number of copies and of words that the mix takes."""
    out = ranked(rows, ends)
    below = F.col("place") < F.col("first_place")
    upto = F.struct("place", "rank", "size", "doc_id") <= F.col("last")
    extra = F.when((F.col("size") > 0) & F.coalesce(below | upto, F.lit(False)), 1).otherwise(0)
    return out.withColumn("copies", F.col("whole") + extra).withColumn("taken", F.col("size") * F.col("copies"))


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return mixed(rows, cuts(rows)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE_OP2 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
             1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight FROM d GROUP BY source),
f(step, capped, rest, w) AS (
  SELECT 0, 0::BIGINT, (SELECT sum(source_size)::BIGINT FROM s), (SELECT sum(weight)::BIGINT FROM s)
  UNION ALL
  SELECT step + 1, nc, (SELECT sum(source_size)::BIGINT FROM s) - 3 * ns, nw FROM (
    SELECT f.step, f.capped, count(*) FILTER (f.rest * s.weight > 3 * f.w * s.source_size) AS nc,
           coalesce(sum(s.source_size) FILTER (f.rest * s.weight > 3 * f.w * s.source_size), 0)::BIGINT AS ns,
           coalesce(sum(s.weight) FILTER (f.rest * s.weight <= 3 * f.w * s.source_size), 0)::BIGINT AS nw
    FROM f, s GROUP BY f.step, f.capped) WHERE nc > capped AND nw > 0),
g AS (SELECT rest, w FROM f ORDER BY step DESC LIMIT 1),
t AS (SELECT s.*, CASE WHEN g.rest * s.weight > 3 * g.w * s.source_size THEN 3.0::DOUBLE * s.source_size
                       ELSE g.rest::DOUBLE * s.weight::DOUBLE / g.w::DOUBLE END AS target FROM s, g),
m AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest, source_size::DOUBLE / n AS mean_size FROM m),
q AS (SELECT d.doc_id, d.size, r.source, r.source_size, r.target, r.whole, r.rest,
             CASE WHEN r.rest > 0 THEN d.u / (1 - d.u) / ((r.rest / r.source_size) / (1 - r.rest / r.source_size)
               * sqrt(r.mean_size / greatest(d.size, 1)::DOUBLE)) END AS rank
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
p AS (SELECT *, floor(rank / (1 + rank) * {float(1 << BITS)!r}::DOUBLE)::BIGINT AS place FROM q),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, rank, size, doc_id) - size / 2.0::DOUBLE AS filled FROM p)
SELECT doc_id, size, source_size, target, size * (whole + x) AS taken, source, (whole + x)::BIGINT AS copies
FROM (SELECT *, CASE WHEN size > 0 AND rest > 0 AND filled <= rest THEN 1 ELSE 0 END AS x FROM c)
"""
