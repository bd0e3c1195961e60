"""Readers and writers. Stored tables are Parquet, partitioned so that reads prune by station and month."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.config import SIGNALS, STEP_SECONDS
from foreshock.functions.names import feature_line
from foreshock.functions.times import grid_index, index_time, on_grid, parse_time, to_seconds
from foreshock.operators.grid import dedup_last, interpolate_linear, midnight_smooth

SERIES_FIELDS = ", ".join(["station BIGINT", "idx BIGINT", "t0 BIGINT", "t1 BIGINT", *[f"{s} DOUBLE" for s in SIGNALS]])


def work_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the shared one that the cluster names in ``spark.checkpoint.dir``.
    Where none is named, a temporary folder serves a local master, which has one disk, until the process ends; on a
    cluster that is an error, since executors would write to disks that nobody else reads."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master is {master})")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="foreshock-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write and read back. Used where a result feeds several steps or a loop: it is computed once, plans stay
    short, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---- series ----------------------------------------------------------------------------------------------


def read_series_csv(spark: SparkSession, path: str, signals: Sequence[str] = SIGNALS, station: int = 0) -> DataFrame:
    """Readings from CSV whose first column is ``time``: ``station, ts, signals``."""
    schema = ", ".join(["time STRING", *[f"{s} DOUBLE" for s in signals]])
    raw = spark.read.schema(schema).csv(path, header=True)
    return raw.select(F.lit(station).cast("bigint").alias("station"), parse_time(F.col("time"), strict=True).alias("ts"), *signals)


def on_grid_rows(df: DataFrame, signals: Sequence[str] = SIGNALS, step: int = STEP_SECONDS) -> DataFrame:
    """Readings exactly on the grid, keyed by grid index; others are dropped."""
    return df.filter(on_grid(F.col("ts"), step)).select("station", grid_index(F.col("ts"), step).alias("idx"), *signals)


def write_series(df: DataFrame, path: str) -> None:
    """Replace the station-months that occur in ``df``; others stay."""
    stamped = df.withColumn("month", F.date_format(index_time(F.col("idx")), "yyyy-MM"))
    (
        stamped.repartition("station", "month")
        .sortWithinPartitions("station", "idx")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("station", "month")
        .parquet(path)
    )


def read_series(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    """The stored series, or the named months (``yyyy-MM``) of it: other files are not read."""
    stored = spark.read.schema(SERIES_FIELDS + ", month STRING").parquet(path)
    return (stored if months is None else stored.filter(F.col("month").isin(list(months)))).drop("month")


def write_series_csv(df: DataFrame, path: str, signals: Sequence[str] = SIGNALS) -> None:
    time = F.date_format(index_time(F.col("idx")), "yyyy-MM-dd HH:mm:ss").alias("time")
    df.select("station", time, *signals).write.mode("overwrite").csv(path, header=True)


def time_range(df: DataFrame, ti=None, tf=None, column: str = "idx") -> DataFrame:
    """Rows with ``ti <= t < tf``; the default range is each station's own, which leaves out its last sample."""
    low = F.col("t0") if ti is None else F.lit(to_seconds(ti) / STEP_SECONDS)
    high = F.col("t1") if tf is None else F.lit(to_seconds(tf) / STEP_SECONDS)
    return df.filter((F.col(column) >= low) & (F.col(column) < high))


# ---- event lists -----------------------------------------------------------------------------------------


def parse_event_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Event times from text lines: ``station, te_us``. An unreadable line is an error; blank ones are skipped."""
    return lines.filter(F.trim(text) != "").select(
        "station", F.unix_micros(parse_time(F.col(text), strict=True)).alias("te_us")
    )


def read_event_list(spark: SparkSession, path: str, station: int = 0) -> DataFrame:
    lines = spark.read.text(path).withColumn("station", F.lit(station).cast("bigint"))
    return parse_event_lines(lines)


# ---- ingest ----------------------------------------------------------------------------------------------


def with_fallback(primary: DataFrame, fallback: DataFrame, minimum: int, size: str = "samples") -> DataFrame:
    """Rows of the primary archive; for (station, day) pairs where it holds fewer than ``minimum`` samples,
    rows of the second archive instead. ``size`` is the column with a row's number of samples."""
    held = (
        primary.groupBy("station", "day").agg(F.sum(size).alias("held")).filter(F.col("held") >= minimum).select("station", "day")
    )
    return (
        primary.join(held, ["station", "day"], "left_semi").withColumn("source", F.lit("primary"))
    ).unionByName(fallback.join(held, ["station", "day"], "left_anti").withColumn("source", F.lit("fallback")))


def refetch_from(stored: DataFrame) -> DataFrame:
    """Per station the day to fetch again from: the one that holds the last stored sample."""
    day = F.date_trunc("DAY", index_time(F.max("idx")))
    return stored.groupBy("station").agg(day.alias("from_day"))


def ingest_merge(stored: DataFrame, fetched: DataFrame, signals: Sequence[str] = SIGNALS, smooth: str | None = "dsar") -> DataFrame:
    """Stored and newly fetched rows (``station, idx, signals``) as one gap-free series; refetched rows win."""
    both = stored.select("station", "idx", *signals, F.lit(0).alias("load_seq")).unionByName(
        fetched.select("station", "idx", *signals, F.lit(1).alias("load_seq"))
    )
    latest = dedup_last(both, ("station", "idx")).drop("load_seq")
    filled = interpolate_linear(latest, signals)
    return midnight_smooth(filled, smooth) if smooth else filled


# ---- model side tables -----------------------------------------------------------------------------------


def write_feature_lists(selected: DataFrame, path: str) -> None:
    """Per-model feature lists ``model_id, rank, feature, p_value``."""
    selected.select("model_id", "rank", "feature", "p_value").write.mode("overwrite").parquet(path)


def read_feature_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model_id BIGINT, rank INT, feature STRING, p_value DOUBLE").parquet(path)


def read_feature_list_text(spark: SparkSession, path: str) -> DataFrame:
    """Feature lists kept as text, one ``p-value name`` line per feature, one ``NNNN.fts`` file per model."""
    lines = spark.read.text(path, pathGlobFilter="[0-9]*.fts")
    p_value, feature = feature_line(F.col("value"))
    number = F.regexp_extract(F.input_file_name(), r"(\d+)\.fts$", 1).cast("bigint")
    return lines.select(number.alias("model_id"), p_value.alias("p_value"), feature.alias("feature")).filter("feature <> ''")


def write_feature_frequency(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Votes ``model_id, station, win_end, pred``, appended."""
    df.write.mode("append").partitionBy("station").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model_id BIGINT, win_end BIGINT, pred DOUBLE, station BIGINT").parquet(path)


def write_consensus(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("station").parquet(path)


def write_scores(df: DataFrame, path: str) -> None:
    """Score table, as CSV like the table it stands for; 101 rows a station."""
    df.write.mode("overwrite").csv(path, header=True)


def append_alert_flag(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
