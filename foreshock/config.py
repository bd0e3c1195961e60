"""Fixed names and the window geometry shared by every operator."""

from __future__ import annotations

import math
from dataclasses import dataclass

STEP_SECONDS = 600
SAMPLES_PER_DAY = 86400 // STEP_SECONDS
SIGNALS = ("rsam", "mf", "hf", "dsar")
TRANSFORMS = ("inv", "diff", "log", "stft")

# Rows of one chunk of a series. Ordered operators work per (station, chunk) plus a short halo, so no task
# ever holds a whole station.
CHUNK = 1440

MONTH_DAYS = 365.25 / 12


@dataclass(frozen=True)
class Geometry:
    """Window length, overlap (share of a window) and look-forward, the first and last in days."""

    window: float = 2.0
    overlap: float = 0.75
    look_forward: float = 2.0

    @property
    def iw(self) -> int:
        """Samples per window."""
        return int(self.window * SAMPLES_PER_DAY)

    @property
    def io(self) -> int:
        """Samples shared by neighbouring windows; one less than a window at full overlap."""
        shared = int(self.overlap * self.iw)
        return shared - 1 if shared == self.iw else shared

    @property
    def hop(self) -> int:
        return self.iw - self.io

    @property
    def hop_seconds(self) -> int:
        return self.hop * STEP_SECONDS

    @property
    def window_seconds(self) -> int:
        return self.iw * STEP_SECONDS

    @property
    def look_micros(self) -> int:
        return round(self.look_forward * 86400 * 1_000_000)

    @property
    def alert_span(self) -> float:
        """Windows an alert stays open after its last exceedance (rounded: 288.000000000001 is 288)."""
        return round(self.look_forward * SAMPLES_PER_DAY / self.hop, 6)

    @property
    def alert_reach(self) -> int:
        """Largest whole number of windows that still joins two exceedances."""
        return math.floor(self.alert_span)

    def at_data_rate(self) -> "Geometry":
        """The same window, moved one sample at a time."""
        return Geometry(self.window, 1.0, self.look_forward)
