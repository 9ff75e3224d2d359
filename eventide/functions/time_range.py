"""Time ranges as users write them: now, now-<n>m, now-<n>h, now-<n>d, or an ISO time."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

UNITS = {"m": "minutes", "h": "hours", "d": "days"}
QUICK_RANGES = ("now-5m", "now-15m", "now-30m", "now-1h", "now-3h", "now-6h", "now-12h", "now-24h", "now-3d", "now-7d", "now-30d")
DEFAULT = ("now-30m", "now")


@dataclass(frozen=True)
class TimeRange:
    """The ends as written, and the instants they stand for."""

    raw_from: str
    raw_to: str
    start: datetime
    end: datetime

    def formatted(self) -> tuple[str, str]:
        return tuple(t.isoformat(timespec="seconds") for t in (self.start, self.end))

    def refreshed(self, now: datetime) -> TimeRange:
        """Relative ends move with now; a range without any stays as it is."""
        relative = self.raw_from.startswith("now") or self.raw_to.startswith("now")
        return parse_range(self.raw_from, self.raw_to, now) if relative else self


def parse_time(text: str, now: datetime) -> datetime:
    """Raises ValueError for what is no time. A time without zone is UTC."""
    if text == "now":
        return now
    if found := re.fullmatch(r"now-(\d+)([mhd])", text):
        return now - timedelta(**{UNITS[found[2]]: int(found[1])})
    parsed = datetime.fromisoformat(text)
    return parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)


def parse_range(start: str = DEFAULT[0], end: str = DEFAULT[1], now: datetime | None = None) -> TimeRange:
    now = now or datetime.now(timezone.utc)
    return TimeRange(start, end, parse_time(start, now), parse_time(end, now))
