"""Exact order statistics of large groups: quantiles, k smallest, ranks.

One group (a feature, a model) may hold a third of all rows, so no group is sorted in one task. A first pass
finds where to look, from a sketch or a histogram of fixed size; only the narrow part that decides is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreshock.operators.chunks import place
from foreshock.sources.tables import cut_lineage

HASH_BUCKETS = 4096
ACCURACY = 10_000
SPLITTERS = 63
#: Different values that one task orders.
CELL = 10_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], cell: int = CELL) -> DataFrame:
    """Quantiles per group by linear interpolation, exactly: one row per group, one column per name in ``qs``.

    Equal values meet in a partial aggregate first. Then the stretch of values that holds a wanted rank is cut into cells again and
    again, by a sketch that only says where to cut: which cell holds the rank follows from exact counts. A stretch of at most ``cell``
    different values is ordered. Small groups need no cuts and go the same way. Null values do not count; a group without values has no row.
    """
    names = list(qs)
    ranks = ", ".join(f"named_struct('name', '{n}', 'place', (_n - 1) * {float(qs[n])!r}D)" for n in names)
    values = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c")))
    groups = values.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_size"))
    state = groups.selectExpr(*keys, "_lo", "_hi", "0L AS _below", "_size", f"inline(array({ranks}))")
    state = cut_lineage(state.selectExpr("*", "CAST(floor(place + 1e-9) AS BIGINT) AS _rank"))
    stretch = [*keys, "name"]
    while state.filter(F.col("_size") > cell).limit(1).count():
        wide = state.filter(F.col("_size") > cell)
        inside = cut_lineage(values.join(wide, list(keys)).filter("_v >= _lo AND _v <= _hi"))
        splits = [i / (SPLITTERS + 1) for i in range(1, SPLITTERS + 1)]
        fences = inside.groupBy(*stretch).agg(F.percentile_approx("_v", splits, ACCURACY).alias("_fences"))
        cells = inside.join(fences, stretch).groupBy(
            *stretch, "place", "_rank", "_below", F.expr("size(filter(_fences, f -> f < _v))").alias("_cell")
        ).agg(F.sum("_c").alias("_c"), F.count("*").alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*stretch).orderBy("_cell"))  # over at most 64 cells
        cells = cells.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_c"))
        hold = cells.filter("_upto > _rank AND _from <= _rank + 1").groupBy(*stretch, "place", "_rank").agg(
            F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min("_from").alias("_below"), F.sum("_size").alias("_size")
        )
        state = cut_lineage(state.filter(F.col("_size") <= cell).unionByName(hold.select(*state.columns)))
    left = values.join(state, list(keys)).filter("_v >= _lo AND _v <= _hi")
    order = Window.partitionBy(*stretch).orderBy("_v")
    ranked = left.withColumn("_upto", F.col("_below") + F.sum("_c").over(order)).withColumn("_from", F.col("_upto") - F.col("_c"))
    low = "max(CASE WHEN _from <= _rank AND _rank < _upto THEN _v END)"
    high = "max(CASE WHEN _from <= _rank + 1 AND _rank + 1 < _upto THEN _v END)"
    picked = ranked.groupBy(*stretch).agg(
        F.expr(f"{low} + CASE WHEN max(place - _rank) > 0 AND {high} > {low} THEN ({high} - {low}) * max(place - _rank) ELSE 0D END").alias("_quantile")
    )
    found = F.coalesce("_quantile", F.raise_error(F.lit("a rank was not found in its stretch")).cast("double"))
    columns = [F.max(F.when(F.col("name") == n, found)).alias(n) for n in names]
    return picked.groupBy(*keys).agg(*columns)


def mark_smallest(df: DataFrame, keys: Sequence[str], order: str, keep: DataFrame) -> DataFrame:
    """Add ``chosen``: true on the ``keep`` rows of each group with the smallest ``order``.

    ``order`` is a hex digest; its first three digits are spread evenly, so a histogram of 4096 buckets per
    group shows the bucket where the count is reached, and only the rows of that bucket are ranked.
    ``keep`` has one row per group: the keys and ``keep``. So has the table of cuts, and both are broadcast by name: rows made from
    few stored ones by an explode look small to the planner, which would send them to the driver instead.
    """
    rows = df.withColumn("_bucket", F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_bucket")
    cut = (
        counts.withColumn("_upto", F.sum("_c").over(upto))
        .join(F.broadcast(keep), list(keys))
        .filter("_upto - _c < keep")
        .groupBy(*keys)
        .agg(F.max("_bucket").alias("_cut"), F.max_by(F.col("keep") - F.col("_upto") + F.col("_c"), "_bucket").alias("_need"))
    )
    cutted = rows.join(F.broadcast(cut), list(keys), "left")
    sure = cutted.filter("coalesce(_bucket <> _cut, true)").withColumn("chosen", F.expr("coalesce(_bucket < _cut, false)"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    edge = cutted.filter("_bucket = _cut").withColumn("_place", place).withColumn("chosen", F.expr("_place <= _need")).drop("_place")
    return sure.unionByName(edge).drop("_bucket", "_cut", "_need")


def in_ranges(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows with the number ``part`` of the range of their feature's ``splits`` that holds their value, dealt over tasks by feature and
    range. The splits, at most 63 numbers a feature, are broadcast."""
    part = F.expr("size(filter(splits, s -> s < value))").alias("part")
    return place(rows.join(F.broadcast(splits), "feature").select(*rows.columns, part), "feature", "part")


def class_ranks(rows: DataFrame, splits: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Distinct values per (keys, feature) with class counts and the class counts of all smaller values.

    Input: the keys, ``feature, value, label`` and, per feature, an array ``splits`` of values that cut it into
    ranges. Equal values meet in a partial aggregate, ranges are summed up over at most 64 rows, and ordering
    happens within a range only. Output: keys, ``feature, value, n0, n1, below0, below1``.
    """
    group = [*keys, "feature"]
    return ranks_in_ranges(in_ranges(_class_counts(rows, [*group, "value"]), splits), keys)


def packed_ranks(rows: DataFrame, splits: DataFrame, key: str = "model_id", packed: str = "models") -> DataFrame:
    """The same for rows that carry the array ``packed`` of all their keys. They are dealt once per row, not once per key, and
    unfolded where their range is; what follows finds them in place."""
    placed = in_ranges(rows, splits).select(F.explode(packed).alias(key), "feature", "part", "value", "label")
    return ranks_in_ranges(_class_counts(placed, [key, "feature", "part", "value"]), [key])


def _class_counts(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    return rows.groupBy(*group).agg(F.count_if(F.col("label") <= 0).alias("n0"), F.count_if(F.col("label") > 0).alias("n1"))


def ranks_in_ranges(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class counts ``n0, n1`` of values dealt by ``in_ranges``, with those of all smaller values. Only the sums of ranges move."""
    group = [*keys, "feature"]
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*group, "part")
        .agg(F.sum("n0").alias("p0"), F.sum("n1").alias("p1"))
        .select(
            *group,
            "part",
            F.coalesce(F.sum("p0").over(before), F.lit(0)).alias("o0"),
            F.coalesce(F.sum("p1").over(before), F.lit(0)).alias("o1"),
        )
    )
    inner = Window.partitionBy(*group, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(place(offsets, "feature", "part").hint("merge"), [*group, "part"]).select(
        *group,
        "value",
        "n0",
        "n1",
        (F.col("o0") + F.coalesce(F.sum("n0").over(inner), F.lit(0))).alias("below0"),
        (F.col("o1") + F.coalesce(F.sum("n1").over(inner), F.lit(0))).alias("below1"),
    )


def value_splits(features: DataFrame) -> DataFrame:
    """Per feature, values that cut it into about equal ranges; from a sketch, 63 numbers a feature."""
    shares = [i / (SPLITTERS + 1) for i in range(1, SPLITTERS + 1)]
    return features.groupBy("feature").agg(F.array_distinct(F.percentile_approx("value", shares, 1000)).alias("splits"))
