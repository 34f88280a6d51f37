"""Time stamps of exports, as a column and for parsers that run per file."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_TIME = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[ T](\d{1,2}):(\d{2})(?::(\d{2}))?"
CJK_DATE_TIME = r"(\d{4})年(\d{1,2})月(\d{1,2})日\s*(\d{1,2}):(\d{2})(?::(\d{2}))?"
NO_YEAR = r"(\d{1,2})[-/.](\d{1,2})[ T](\d{1,2}):(\d{2})"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}$|^\d{8}$"
MOST_SECONDS = 253_402_300_800_000  # the year 10000, in milliseconds
PREFIXES = (DATE_TIME, CJK_DATE_TIME, NO_YEAR)


def _made(text: Column, pattern: str, default_year: int | Column) -> Column:
    p = f"^{pattern}"
    part = lambda k: F.regexp_extract(text, p, k)
    number = lambda k: F.when(part(k) == "", 0).otherwise(part(k).cast("int"))
    if pattern == NO_YEAR:
        y, rest = default_year if isinstance(default_year, Column) else F.lit(default_year), [number(k) for k in range(1, 5)] + [F.lit(0)]
    else:
        y, rest = number(1), [number(k) for k in range(2, 7)]
    month, day, hour, minute, second = rest
    ts = F.try_make_timestamp_ntz(y, month, day, hour, F.least(minute, F.lit(59)), F.least(second, F.lit(59)).cast("decimal(8,6)"))
    return F.when(text.rlike(p) & y.between(1970, 2100), ts)


def prefix_time(text: Column, default_year: int) -> tuple[Column, Column]:
    """The time that a text begins with (null if none), and the text after it, without blanks before it."""
    times = [_made(text, p, default_year) for p in PREFIXES]
    rest = [F.when(t.isNotNull(), F.regexp_replace(text, f"^{p}", "")) for t, p in zip(times, PREFIXES, strict=True)]
    return F.coalesce(*times), F.ltrim(F.coalesce(*rest, text))


def bracketed_time(line: Column, default_year: int) -> tuple[Column, Column]:
    """Like prefix_time, for a time that may stand in brackets of at most 32 characters."""
    inner = F.trim(F.regexp_extract(line, r"^\[([^\]]{0,31})\]", 1))
    after = F.regexp_extract(line, r"(?s)^\[[^\]]{0,31}\]\s*(.*)$", 1)
    ts, _ = prefix_time(inner, default_year)
    plain, rest = prefix_time(line, default_year)
    return F.coalesce(ts, plain), F.when(ts.isNotNull(), after).otherwise(rest)


def parsed(text: Column, number: Column, default_year: int | None = None) -> Column:
    """A time as a column: from text (a known beginning, or an ISO 8601 date), else from seconds or milliseconds since 1970 in UTC."""
    t = F.trim(text)
    year = F.year(F.current_date()) if default_year is None else F.lit(default_year)
    known = [_made(t, p, year) for p in PREFIXES]
    day = F.regexp_extract(t, ISO_DAY, 0)
    seconds = F.when((number > 0) & (number < MOST_SECONDS), F.when(number > 1e11, number / 1000).otherwise(number))
    stamp = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(seconds, 6).cast("decimal(18,6)"))
    return F.coalesce(*known, F.try_to_timestamp(F.when(day != "", F.regexp_replace(day, "-", "")), F.lit("yyyyMMdd")).cast("timestamp_ntz"), stamp)


def parse(value, default_year: int | None = None) -> datetime | None:
    """A time from seconds or milliseconds since 1970 (in UTC) or from text; null where it is neither."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        try:
            return datetime.fromtimestamp(value / (1000 if value > 1e11 else 1), UTC).replace(tzinfo=None) if value > 0 else None
        except (OverflowError, OSError, ValueError):
            return None
    text = value.strip() if isinstance(value, str) else ""
    if not text:
        return None
    for p in PREFIXES:
        if m := re.match(p, text):
            n = [int(x or 0) for x in m.groups()]
            y, (month, day, hour, minute, *second) = (default_year or datetime.now().year, n) if p == NO_YEAR else (n[0], n[1:])
            try:
                if 1970 <= y <= 2100:
                    return datetime(y, month, day, hour, min(minute, 59), min(second[0] if second else 0, 59))
            except ValueError:
                pass
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
    except ValueError:
        return None
