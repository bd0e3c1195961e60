"""Waveform blocks to 10-minute signals: band-pass, rectify, block mean, band ratio.

Input rows: ``station, start_s`` (epoch seconds of the first sample), ``samples ARRAY<FLOAT>`` in time order.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreshock.functions.times import nearest_grid
from foreshock.sources.tables import cut_lineage

# Pass bands in Hz, filter order, scale to nanometres.
BANDS = {"rsam": (2.0, 5.0), "mf": (4.5, 8.0), "hf": (8.0, 16.0)}
CORNERS = 4
NANO = 1e9


def correct_sensitivity(waveforms: DataFrame, stations: DataFrame) -> DataFrame:
    """Samples in ground units: divided by the ``sensitivity`` of their station."""
    return waveforms.join(stations.select("station", "sensitivity"), "station").withColumn(
        "samples", F.transform("samples", lambda v: v / F.col("sensitivity"))
    ).drop("sensitivity")


def block_means(samples: Column, block: int) -> Column:
    """Mean size of the samples of each whole block, scaled; array work inside the row, no shuffle."""
    count = F.floor(F.size(samples) / block).cast("int")
    one = lambda b: F.aggregate(
        F.slice(samples, b * block + 1, block), F.lit(0.0), lambda acc, v: acc + F.abs(v.cast("double"))
    )
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: one(b) / block * NANO)).otherwise(
        F.array().cast("array<double>")
    )


def band_pass_sections(low: float, high: float, rate: float, corners: int = CORNERS) -> tuple[float, list[tuple[float, float]], float]:
    """Gain, recursions of second order (``y = x - x[-2] - a1 y[-1] - a2 y[-2]``) and size of the slowest pole of a one-pass
    Butterworth band-pass.

    Poles of the analogue prototype are moved to the band and mapped by the bilinear transform; each conjugate
    pair gives one recursion.
    """
    edges = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    centre, width = math.sqrt(edges[0] * edges[1]), edges[1] - edges[0]
    proto = np.exp(1j * np.pi * (2 * np.arange(1, corners + 1) + corners - 1) / (2 * corners))
    half = proto * width / 2
    root = np.sqrt(half**2 - centre**2)
    analogue = np.concatenate([half + root, half - root])
    poles = (2 * rate + analogue) / (2 * rate - analogue)
    # Zeros: as many at +1 as at -1. The gain follows from |H| = 1 at the band centre.
    at = np.exp(2j * math.atan(centre / (2 * rate)))
    gain = abs(np.prod(at - poles) / ((at - 1) ** corners * (at + 1) ** corners))
    sections = [(-2 * float(p.real), float(abs(p) ** 2)) for p in poles[poles.imag > 0]]
    return float(gain), sections, float(np.max(np.abs(poles)))


@lru_cache(maxsize=32)
def band_pass_response(low: float, high: float, rate: float, corners: int = CORNERS) -> np.ndarray:
    """Impulse response of the band-pass, cut where it has died out below 1e-18."""
    gain, sections, slowest = band_pass_sections(low, high, rate, corners)
    length = int(math.ceil(math.log(1e-18) / math.log(slowest))) + 2 * corners
    h = np.zeros(length)
    h[0] = gain
    for a1, a2 in sections:
        x = np.concatenate([[0.0, 0.0], h])
        y = np.zeros(length + 2)
        for i in range(2, length + 2):
            y[i] = x[i] - x[i - 2] - a1 * y[i - 1] - a2 * y[i - 2]
        h = y[2:]
    return h


def convolved(data: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Filter from rest, as overlap-add products with the impulse response."""
    size = 1 << max(14, int(math.ceil(math.log2(4 * len(h)))))
    step = size - len(h) + 1
    spectrum = np.fft.rfft(h, size)
    out = np.zeros(len(data) + size)
    for begin in range(0, len(data), step):
        part = np.fft.irfft(np.fft.rfft(data[begin : begin + step], size) * spectrum, size)
        out[begin : begin + size] += part
    return out[: len(data)]


def band_pass(data: np.ndarray, low: float, high: float, rate: float) -> np.ndarray:
    return convolved(data, band_pass_response(low, high, rate))


def memory(rate: float) -> int:
    """Samples before a stretch that its filtered values still depend on."""
    return max(len(band_pass_response(*band, rate)) for band in BANDS.values()) - 1


def islands(waveforms: DataFrame, rate: float) -> DataFrame:
    """Rows of samples with the island that they lie in: ``station, day, start_s, n, island`` (the time of its first sample) and
    ``offset`` (samples of the island before the row). An island ends at a gap, at an overlap and with the day. Of rows that
    begin at one time the longest holds. Only times and sizes are ordered, not samples."""
    rows = waveforms.select("station", "start_s", F.size("samples").cast("bigint").alias("n")).filter("n > 0")
    rows = rows.groupBy("station", "start_s").agg(F.max("n").alias("n")).withColumn("day", F.floor(F.col("start_s") / 86400))
    order = Window.partitionBy("station", "day").orderBy("start_s")
    until = F.lag(F.col("start_s") + F.col("n") / rate).over(order)
    begins = F.when(until.isNull() | (F.abs(F.col("start_s") - until) > 0.5 / rate), F.col("start_s"))
    rows = rows.withColumn("begins", begins).withColumn("island", F.last("begins", ignorenulls=True).over(order))
    before = Window.partitionBy("station", "day", "island").orderBy("start_s").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("begins")


_STRETCH = "station BIGINT, island DOUBLE, part BIGINT, first BIGINT, x ARRAY<DOUBLE>, grown DOUBLE, total DOUBLE, n BIGINT"


def stretches(waveforms: DataFrame, rate: float, length: int) -> DataFrame:
    """Islands in stretches of ``length`` samples, each with the samples before it that filters remember: ``station, island, part,
    first`` (number of remembered samples) and ``x``. ``grown`` is what the running integral gains over the stretch, ``total`` the
    sum of that integral from the stretch's begin, ``n`` its samples. A stretch is one task's group, whatever the length of rows."""
    back = memory(rate)
    if back > length:
        raise ValueError(f"a stretch of {length} samples is shorter than the filters' memory of {back}")
    placed = waveforms.join(islands(waveforms, rate).select("station", "start_s", "n", "island", "offset"), ["station", "start_s"])
    placed = placed.filter(F.size("samples") == F.col("n")).dropDuplicates(["station", "start_s"])
    low, high = F.floor(F.col("offset") / length), F.floor((F.col("offset") + F.col("n") - 1 + back) / length)
    cut = placed.withColumn("part", F.explode(F.sequence(low, high)))
    begin = F.greatest(F.col("part") * length - back - F.col("offset"), F.lit(0))
    end = F.least((F.col("part") + 1) * length - F.col("offset"), F.col("n"))
    cut = cut.withColumns({"begin": begin, "size": end - begin}).filter("size > 0")
    cut = cut.select(
        "station", F.col("island").cast("double").alias("island"), "part", (F.col("offset") + F.col("begin")).alias("at"),
        F.slice("samples", (F.col("begin") + 1).cast("int"), F.col("size").cast("int")).alias("samples"),
    )

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        x = np.concatenate([np.asarray(s, dtype=float) for s in rows["samples"]])
        first = int(key[2] * length - rows["at"].iloc[0])
        if len(x) <= first:  # nothing but the memory of a stretch that the island does not reach
            return pd.DataFrame(columns=["station", "island", "part", "first", "x", "grown", "total", "n"])
        area = _area(x, rate)[first:] - (_area(x, rate)[first - 1] if first else 0.0)
        return pd.DataFrame([{
            "station": key[0], "island": key[1], "part": key[2], "first": first, "x": x,
            "grown": area[-1], "total": area.sum(), "n": len(area),
        }])

    return cut.groupBy("station", "island", "part").applyInPandas(gather, _STRETCH)


def _area(x: np.ndarray, rate: float) -> np.ndarray:
    """Integral from the first sample by trapezes."""
    return np.concatenate([[0.0], np.cumsum((x[1:] + x[:-1]) / (2 * rate))])


def stretch_signals(x: np.ndarray, first: int, before: float, mean: float, rate: float, block: int) -> dict[str, np.ndarray]:
    """Block means of every band, and the ratio of displacement bands, of one stretch. ``before`` is the integral up to the stretch,
    ``mean`` that of the island."""
    whole = block * ((len(x) - first) // block)

    def sizes(data: np.ndarray, low: float, high: float) -> np.ndarray:
        return np.abs(band_pass(data, low, high, rate)[first : first + whole]).reshape(-1, block).mean(axis=1)

    out = {name: sizes(x, *band) * NANO for name, band in BANDS.items()}
    area = _area(x, rate)
    area += before - (area[first - 1] if first else 0.0) - mean
    out["dsar"] = sizes(area, *BANDS["mf"]) / sizes(area, *BANDS["hf"])
    return out


def reduce_days(waveforms: DataFrame, rate: float = 100.0, block_seconds: int = 600, blocks: int = 6) -> DataFrame:
    """10-minute signals of each station: ``station, idx, rsam, mf, hf, dsar``.

    Filters start at rest and the displacement's mean is taken anew in each island of samples without a gap, which a day's end ends
    too; an island's first block lies on the grid step nearest to its begin. Islands are worked on in stretches of ``blocks`` blocks with the
    samples before that filters remember, so no task holds a day. Blocks that islands leave incomplete are dropped; of two islands
    at one grid step the earlier holds.
    """
    block = int(block_seconds * rate)
    columns = ["rsam", "mf", "hf", "dsar"]
    parts = cut_lineage(stretches(waveforms, rate, block * max(blocks, -(-memory(rate) // block))))
    order = Window.partitionBy("station", "island").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("station", "island")  # a row per stretch, without samples
    numbers = parts.select("station", "island", "part", "grown", "total", "n").withColumn("before", F.coalesce(F.sum("grown").over(order), F.lit(0.0)))
    mean = F.sum(F.col("total") + F.col("n") * F.col("before")).over(whole) / F.sum("n").over(whole)
    numbers = numbers.select("station", "island", "part", "before", mean.alias("mean"))
    length = block * max(blocks, -(-memory(rate) // block))

    def signals(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                out = stretch_signals(np.asarray(r.x, dtype=float), r.first, r.before, r.mean, rate, block)
                pos = r.part * (length // block) + np.arange(len(out["rsam"]))
                yield pd.DataFrame({"station": r.station, "island": r.island, "pos": pos} | out)

    schema = "station BIGINT, island DOUBLE, pos BIGINT, " + ", ".join(f"{c} DOUBLE" for c in columns)
    rows = parts.select("station", "island", "part", "first", "x").join(numbers, ["station", "island", "part"]).mapInPandas(signals, schema)
    begin = nearest_grid(F.col("island"), block_seconds)
    placed = rows.withColumn("idx", (F.floor(begin / block_seconds) + F.col("pos")).cast("bigint"))
    first = placed.groupBy("station", "idx").agg(F.min_by(F.struct(*columns), "island").alias("s"))
    return first.select("station", "idx", "s.*")


def band_ratio(df: DataFrame, steps: int, top: str = "mf", bottom: str = "hf") -> DataFrame:
    """Ratio of the mean sizes of two bands per block of grid steps."""
    return (
        df.groupBy("station", F.floor(F.col("idx") / steps).alias("block"))
        .agg(F.avg(F.abs(top)).alias("a"), F.avg(F.abs(bottom)).alias("b"))
        .select("station", "block", F.try_divide("a", "b").alias("ratio"))
    )


def waveform_files(spark, path: str) -> DataFrame:
    """Archive of decoded waveform rows in Parquet, one file tree per channel."""
    schema = "station BIGINT, channel STRING, start_s BIGINT, samples ARRAY<FLOAT>"
    return spark.read.schema(schema).parquet(path).withColumn("day", F.floor(F.col("start_s") / 86400)).withColumn(
        "n_samples", F.size("samples").cast("bigint")
    )
