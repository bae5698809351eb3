"""Date math of search requests: ``now-7d/d``, ``2026-09-24||+1M/M``, bare dates and epoch milliseconds."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta, timezone

_ISO = re.compile(r"(\d{4})(?:-(\d\d?)(?:-(\d\d?)(?:T(\d\d?)(?::(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?)?(Z|[+-]\d\d(?::?\d\d)?)?)?)?)?")
_STEP = re.compile(r"([+-])(\d*)([yMwdhHms])|/([yMwdhHms])")


class DateError(ValueError):
    pass


def _months(at: datetime, n: int) -> datetime:
    month = at.year * 12 + at.month - 1 + n
    year, month = divmod(month, 12)
    return at.replace(year=year, month=month + 1, day=min(at.day, calendar.monthrange(year, month + 1)[1]))


def add(at: datetime, n: int, unit: str) -> datetime:
    if unit == "y":
        return _months(at, 12 * n)
    if unit == "M":
        return _months(at, n)
    return at + n * {"w": timedelta(weeks=1), "d": timedelta(days=1), "h": timedelta(hours=1), "H": timedelta(hours=1), "m": timedelta(minutes=1), "s": timedelta(seconds=1)}[unit]


def floor(at: datetime, unit: str) -> datetime:
    at = at.replace(microsecond=0)
    if unit == "s":
        return at
    at = at.replace(second=0)
    if unit == "m":
        return at
    at = at.replace(minute=0)
    if unit in "hH":
        return at
    at = at.replace(hour=0)
    if unit == "w":
        return at - timedelta(days=at.weekday())
    if unit == "d":
        return at
    at = at.replace(day=1)
    return at if unit == "M" else at.replace(month=1)


def parse_date(text: str, up: bool = False) -> datetime:
    """A date as UTC without zone; missing parts are the first; rounding up, those of the time of day are the last that
    fit, to the millisecond, and a missing month or day still the first."""
    m = _ISO.fullmatch(text.strip())
    if m:
        year, month, day, hour, minute, second, fraction, zone = m.groups()
        parts = [int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0)]
        try:
            at = datetime(*parts, int((fraction or "0").ljust(9, "0")[:6]))
            if up and fraction is None:
                unit = "s" if second else "m" if minute else "h" if hour else "d"
                at = add(at, 1, unit) - timedelta(milliseconds=1)
        except (ValueError, OverflowError) as e:
            raise DateError(f"not a date: {text}") from e
        if zone and zone != "Z":
            digits = zone[1:].replace(":", "").ljust(4, "0")
            shift = timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
            at = at - shift if zone[0] == "+" else at + shift
        return at
    if re.fullmatch(r"[+-]?\d+(\.\d+)?", text.strip()):
        return datetime(1970, 1, 1) + timedelta(microseconds=round(float(text) * 1000))
    raise DateError(f"not a date: {text}")


def parse(text: str, now: datetime | None = None, up: bool = False) -> datetime:
    """A date expression. ``up`` (for bounds that exclude what is below, or include what is up to) rounds to the last
    millisecond of a unit, otherwise to its first."""
    if text.startswith("now"):
        at, rest = now or datetime.now(timezone.utc).replace(tzinfo=None), text[3:]
    elif "||" in text:
        date, _, rest = text.partition("||")
        at = parse_date(date)
    else:
        return parse_date(text, up)
    pos = 0
    while pos < len(rest):
        m = _STEP.match(rest, pos)
        if not m:
            raise DateError(f"bad date math: {text}")
        pos = m.end()
        sign, count, unit, cut = m.groups()
        if unit:
            at = add(at, (1 if sign == "+" else -1) * int(count or 1), unit)
        else:
            at = floor(at, cut)
            if up:
                at = add(at, 1, cut) - timedelta(milliseconds=1)
    return at


def range_bounds(body: dict, now: datetime | None = None) -> dict[str, datetime]:
    """Bounds of a date range: ``gt`` and ``lte`` round up, ``gte`` and ``lt`` down."""
    return {k: parse(str(body[k]), now, up=k in ("gt", "lte")) for k in ("gt", "gte", "lt", "lte") if body.get(k) is not None}
