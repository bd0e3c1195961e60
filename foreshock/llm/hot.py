"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.sources.tables import cut_lineage

#: Keys that hold more than this part of all rows are hot; so there are fewer hot keys than this.
HOT_KEYS = 10_000
#: Rows of a few numbers each up to which a table is sent to every task (a few megabytes).
SMALL_ROWS = 100_000


def lookup(rows: DataFrame, table: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` joined with ``table``, which has each value of ``key`` once and the number ``n`` of rows with it. Hot keys, fewer
    than ``HOT_KEYS``, are broadcast; no other key holds enough rows to matter to the task it falls to. ``n`` is dropped."""
    table = cut_lineage(table)
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT_KEYS > F.lit(total)
    few = F.broadcast(table.where(hot).drop(n))
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(table.where(~hot).drop(n), key)
    return rows.join(few, key).unionByName(rest)


def sized_broadcast(table: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A table of a few numbers a row with a broadcast hint if it has at most ``limit`` rows; else as it is, for Spark to
    shuffle. It is written first."""
    table = cut_lineage(table)
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table
