"""Chunks with a halo: ordered work on long series without one task per station."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreshock.config import CHUNK
from foreshock.functions.numbers import floor_div


def place(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle to ``spark.sql.shuffle.partitions`` tasks. It is the exchange the next window, join or aggregate
    on these keys needs anyway; naming the number keeps small inputs of heavy steps from being merged into
    one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_halo(
    df: DataFrame, before: int = 0, after: int = 0, size: int = CHUNK, key: str = "idx"
) -> DataFrame:
    """Give each row its chunk, and copies of it to the chunks that look at it from a distance.

    A row at ``idx`` is needed by the chunks of ``idx - after .. idx + before``. The added column ``own`` is
    true on the one copy that belongs to the chunk.
    """
    idx = F.col(key)
    copies = df.select(
        "*",
        F.explode(F.sequence(floor_div(idx - after, size), floor_div(idx + before, size))).alias("chunk"),
    ).withColumn("own", F.col("chunk") == floor_div(idx, size))
    return place(copies, "station", "chunk")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("own").drop("chunk", "own")


def chunk_order(*extra: str, key: str = "idx") -> Window:
    return Window.partitionBy("station", "chunk", *extra).orderBy(key)
