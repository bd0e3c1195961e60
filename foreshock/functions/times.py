"""Time parsing, grid arithmetic and display zones. Stored times are UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from foreshock.config import STEP_SECONDS

# The accepted time layouts, tried in this order.
TIME_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy MM dd HH mm ss")
PYTHON_LAYOUTS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y %m %d %H %M %S")
DISPLAY_ZONE = "Pacific/Auckland"


def parse_time(text: Column, strict: bool = False) -> Column:
    """Timestamp from text in any accepted layout; null, or an error when strict, if none fits."""
    trimmed = F.trim(text)
    parsed = F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(layout)) for layout in TIME_LAYOUTS])
    if not strict:
        return parsed
    message = F.concat(F.lit("cannot read '"), trimmed, F.lit("' as a time"))
    return F.coalesce(parsed, F.when(text.isNotNull(), F.raise_error(message).cast("timestamp")))


def to_seconds(value: str | datetime | int | float) -> float:
    """Epoch seconds of a scalar argument (text, datetime or seconds)."""
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, datetime):
        moment = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return moment.timestamp()
    for layout in PYTHON_LAYOUTS:
        try:
            return datetime.strptime(value, layout).replace(tzinfo=timezone.utc).timestamp()
        except ValueError:
            continue
    raise ValueError(f"cannot read {value!r} as a time")


def grid_index(ts: Column, step: int = STEP_SECONDS) -> Column:
    """Number of the grid step that holds a timestamp."""
    return F.floor(F.unix_seconds(ts) / step)


def on_grid(ts: Column, step: int = STEP_SECONDS) -> Column:
    return F.unix_micros(ts) % (step * 1_000_000) == 0


def index_time(idx: Column, step: int = STEP_SECONDS) -> Column:
    return F.timestamp_seconds(idx * step)


def nearest_grid(seconds: Column, step: int = STEP_SECONDS) -> Column:
    """Start time moved to the nearest grid step of its day, halves to the even step."""
    day = F.floor(seconds / 86400) * 86400
    return day + (F.bround((seconds - day) / step) * step).cast("bigint")


def local_time(ts: Column, zone: str = DISPLAY_ZONE) -> Column:
    """Wall-clock time in a display zone."""
    return F.from_utc_timestamp(ts, zone)


def tick_label(ts: Column, pattern: str = "HH:mm dd MMM") -> Column:
    return F.date_format(ts, pattern)


def floor_hours(ts: Column, hours: int = 2) -> Column:
    """Timestamp cut down to a multiple of some hours of its day."""
    return F.date_trunc("DAY", ts) + F.make_dt_interval(
        F.lit(0), (F.floor(F.hour(ts) / hours) * hours).cast("int")
    )
