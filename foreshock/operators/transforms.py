"""Elementwise and spectral transforms of gridded series: ``inv_X``, ``diff_X``, ``log_X``, ``stft_X``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.config import CHUNK, SIGNALS, TRANSFORMS
from foreshock.functions.numbers import inverse, log10_signed
from foreshock.operators.chunks import chunk_order, drop_halo, with_halo

SEGMENT = 72
BINS = (16, 17)
# Nuttall window terms.
NUTTALL = (0.3635819, 0.4891775, 0.1365995, 0.0106411)


def stft_weights() -> dict[tuple[int, str], list[float]]:
    """Window times cosine and sine of each kept bin, scaled so that the window sums to one."""
    phase = [2 * math.pi * q / SEGMENT for q in range(SEGMENT)]
    window = [sum((-1) ** m * a * math.cos(m * p) for m, a in enumerate(NUTTALL)) for p in phase]
    total = sum(window)
    return {
        (b, part): [w / total * fn(b * p) for w, p in zip(window, phase)]
        for b in BINS
        for part, fn in (("c", math.cos), ("s", math.sin))
    }


def split_stream(name: str) -> tuple[str | None, str]:
    """Transform (or None) and base signal of a stream name."""
    head, _, base = name.partition("_")
    if base and head in TRANSFORMS:
        return head, base
    return None, name


def check_streams(streams: Sequence[str], signals: Sequence[str] = SIGNALS) -> None:
    bad = [s for s in streams if split_stream(s)[1] not in signals]
    if bad:
        allowed = [*signals, *[f"{t}_{s}" for s in signals for t in TRANSFORMS]]
        raise ValueError(f"unknown streams {bad}; there are {allowed}")


def add_inverse(df: DataFrame, signals: Sequence[str] = SIGNALS) -> DataFrame:
    return df.withColumns({f"inv_{s}": inverse(F.col(s)) for s in signals})


def add_log(df: DataFrame, signals: Sequence[str] = SIGNALS) -> DataFrame:
    return df.withColumns({f"log_{s}": log10_signed(F.col(s)) for s in signals})


def add_diff(df: DataFrame, signals: Sequence[str] = SIGNALS, size: int = CHUNK) -> DataFrame:
    """First difference, 0 on the first row of a series."""
    order = chunk_order()
    halo = with_halo(df, before=1, size=size)
    step = {
        f"diff_{s}": F.when(F.col("idx") == F.col("t0"), 0.0).otherwise(F.col(s) - F.lag(s).over(order))
        for s in signals
    }
    return drop_halo(halo.withColumns(step))


def add_stft(df: DataFrame, signals: Sequence[str] = SIGNALS) -> DataFrame:
    """Mean magnitude at 40-45 minutes of a 72-sample segment ending at each sample.

    Every sample adds its weighted share to the 72 outputs that see it, and sums are associative: partial
    sums form before the shuffle (neighbours in time sit in one partition after gridding), there is no ordered
    window, and the zeros in front of a series are simply shares that never arrive.
    """
    weights = stft_weights()
    others = [c for c in df.columns if c not in ("station", "idx", "t0", "t1")]
    shares = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT - 1))).alias("ahead")).filter(
        "idx + ahead <= t1"
    )
    place = F.lit(SEGMENT - 1) - F.col("ahead")
    sums = [
        F.sum(F.col(s) * F.get(F.array(*[F.lit(v) for v in w]), place)).alias(f"{part}{b}_{s}")
        for s in signals
        for (b, part), w in weights.items()
    ]
    own = [F.max(F.when(F.col("ahead") == 0, F.col(c))).alias(c) for c in others]
    summed = shares.groupBy("station", "t0", "t1", (F.col("idx") + F.col("ahead")).alias("idx")).agg(*own, *sums)
    magnitude = {
        s: sum(F.hypot(f"c{b}_{s}", f"s{b}_{s}") for b in BINS) / len(BINS) for s in signals
    }
    return summed.select(
        "station", "idx", "t0", "t1", *others, *[magnitude[s].alias(f"stft_{s}") for s in signals]
    )


_ADDERS = {"inv": add_inverse, "diff": add_diff, "log": add_log, "stft": add_stft}


def with_streams(df: DataFrame, streams: Sequence[str], signals: Sequence[str] = SIGNALS) -> DataFrame:
    """Project the wanted streams, deriving only the transforms they name."""
    check_streams(streams, signals)
    bases = list(dict.fromkeys(split_stream(s)[1] for s in streams))
    out = df.select("station", "idx", "t0", "t1", *bases)
    for kind in ("stft", "diff", "inv", "log"):
        wanted = [base for t, base in map(split_stream, streams) if t == kind]
        if wanted:
            out = _ADDERS[kind](out, wanted)
    return out.select("station", "idx", "t0", "t1", *streams)
