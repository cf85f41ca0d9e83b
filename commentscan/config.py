"""Settings of a scan, with their bounds."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Defaults and bounds of the settings, and sizes of the capped tables.
THRESHOLD, THRESHOLD_MIN, THRESHOLD_MAX = 0.8, 0.5, 0.95
BAND = 0.2
PER_URL, PER_URL_MIN, PER_URL_MAX = 200, 50, 5000
MONITORED_PER_URL = 200
INTERVAL, INTERVAL_MIN, INTERVAL_MAX = 30, 15, 120
BATCH = 50
PAGE = 50
CAPS = {"flagged": 500, "hidden": 500, "last_comments": 500, "queue": 200, "history": 200, "urls": 100, "phrases": 1000, "logs": 1000, "id_map": 1000}


@dataclass(frozen=True)
class ScanConfig:
    """What a scan reads at its start. Values outside their bounds are moved to the nearest bound."""

    threshold: float = THRESHOLD
    max_per_url: int = PER_URL
    interval_minutes: int = INTERVAL
    use_model: bool = False
    use_opinion: bool = False
    sources: tuple[str, ...] = ()

    def clamped(self) -> ScanConfig:
        within = lambda low, x, high: max(low, min(high, x))
        return replace(
            self,
            threshold=within(THRESHOLD_MIN, self.threshold, THRESHOLD_MAX),
            max_per_url=within(PER_URL_MIN, self.max_per_url, PER_URL_MAX),
            interval_minutes=within(INTERVAL_MIN, self.interval_minutes, INTERVAL_MAX),
        )
