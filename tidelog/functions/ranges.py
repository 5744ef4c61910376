"""The time range of a search, from what its author wrote."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from tidelog.plans.errors import SearchError

_S = {"s": 1, "m": 60, "h": 3600}


def resolve(text: str | None, now: float, zone: str = "UTC", *, is_earliest: bool = False) -> float | None:
    """Epoch seconds of ``now``, ``-N[smhd]``, ``@d``, ``-Nd@d``, RFC 3339, or 0 for the very beginning (only as the
    earliest). None stays None. Days are calendar days of the zone; hours, minutes and seconds are elapsed ones."""
    if text is None:
        return None
    text = text.strip()
    if text == "0" and is_earliest:
        return 0.0
    if text == "now":
        return float(now)
    tz = ZoneInfo(zone)
    here = dt.datetime.fromtimestamp(now, tz)
    if m := re.fullmatch(r"-(\d+)([smh])", text):
        return now - int(m[1]) * _S[m[2]]
    if m := re.fullmatch(r"(?:-(\d+)d)?(@d)?", text):
        if m[1] or m[2]:
            wall = here.replace(tzinfo=None) - dt.timedelta(days=int(m[1] or 0))
            if m[2]:
                wall = wall.replace(hour=0, minute=0, second=0, microsecond=0)
            return wall.replace(tzinfo=tz).timestamp()
    if re.fullmatch(r"\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)", text):
        return dt.datetime.fromisoformat(text.upper().replace("Z", "+00:00")).timestamp()
    raise SearchError("SPL_INVALID_TIME_RANGE", f"{text!r} isn't a time", 0, len(text))


def resolve_range(earliest: str | None, latest: str | None, now: float, zone: str = "UTC") -> tuple[float | None, float | None]:
    """Both ends from one clock reading; the range holds its earliest and not its latest moment."""
    lo, hi = resolve(earliest, now, zone, is_earliest=True), resolve(latest, now, zone)
    if lo is not None and hi is not None and lo >= hi:
        raise SearchError("SPL_INVALID_TIME_RANGE", "the earliest time isn't before the latest")
    return lo, hi
