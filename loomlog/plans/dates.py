"""Days, presets and clock times that a user picks, as what a Request takes."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

#: preset -> days back of its first and last day
TRAILING = {"today": (0, 0), "yesterday": (1, 1), "last3": (2, 0), "last7": (6, 0), "last14": (13, 0), "last30": (29, 0)}


def preset(name: str, today: dt.date) -> tuple[dt.date, dt.date]:
    if name == "thisMonth":
        return today.replace(day=1), today
    first, last = TRAILING[name]
    return today - dt.timedelta(days=first), today - dt.timedelta(days=last)


def zone_label(offset_minutes: int) -> str:
    hours, minutes = divmod(abs(offset_minutes), 60)
    if not offset_minutes:
        return "UTC"
    return f"UTC{'+' if offset_minutes > 0 else '-'}{hours}" + (f":{minutes:02}" if minutes else "")


def picked_to_utc(picked: dt.datetime, zone: str = "UTC", end: bool = False) -> dt.datetime:
    """A picked minute as naive UTC; as an end it takes in the whole minute (to Spark's microsecond)."""
    if end:
        picked = picked.replace(second=59, microsecond=999_999)
    return picked.replace(tzinfo=ZoneInfo(zone)).astimezone(dt.UTC).replace(tzinfo=None)


def time_window(days: tuple[dt.date, dt.date], time_from: dt.datetime | None, time_to: dt.datetime | None, zone: str = "UTC") -> tuple[dt.datetime, dt.datetime]:
    """The picked window, cut to the days; naive UTC. ValueError says which way a window is empty."""
    if time_from and time_to and time_from > time_to:
        raise ValueError("the window ends before it begins")
    low, high = dt.datetime.combine(days[0], dt.time.min), dt.datetime.combine(days[1], dt.time(23, 59))
    low, high = max(low, time_from or low), min(high, time_to or high)
    if low > high:
        raise ValueError("the window lies outside the chosen days")
    return picked_to_utc(low, zone), picked_to_utc(high, zone, True)
