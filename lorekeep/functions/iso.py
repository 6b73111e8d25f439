"""ISO dates, timestamps and numbers from text: null when the text is not one.

``try_cast`` alone is too lenient (it takes ``2026`` or ``2026-9-1`` as dates), so a pattern gates
what may reach it.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings.
DATE = r"^(?!0000)\d{4}-\d{2}-\d{2}$"
COMPACT_DATE = r"^(?!0000)\d{8}$"
WEEK_DATE = r"^(?!0000)(\d{4})(-?)W(\d{2})(?:\2(\d))?$"
_FRACTION = r"(?:[.,]\d+)?"
_CLOCK = rf"\d{{2}}(?::\d{{2}}(?::\d{{2}}{_FRACTION})?)?|\d{{4}}(?:\d{{2}}{_FRACTION})?"
_OFFSET = rf"Z|[+-](?:\d{{2}}(?::\d{{2}}(?::\d{{2}}{_FRACTION})?)?|\d{{4}}(?:\d{{2}}{_FRACTION})?)"
TIMESTAMP = rf"(?s)^(\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}-?W\d{{2}}(?:-?\d(?!\d))?|\d{{8}})(?:.({_CLOCK})({_OFFSET})?)?$"
# The spelling most feeds use, which a cast reads as it is; year 0000 is left to the pattern above.
PLAIN_TIMESTAMP = r"^(?!0000)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z?\z"
INTEGER = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _week_date(text: Column) -> Column:
    """``2026-W05-3``: the Monday of week 1 holds 4 January; week 53 must exist in that year."""
    year = F.regexp_extract(text, WEEK_DATE, 1).try_cast("int")
    week = F.regexp_extract(text, WEEK_DATE, 3).try_cast("int")
    day = F.coalesce(F.nullif(F.regexp_extract(text, WEEK_DATE, 4), F.lit("")), F.lit("1")).try_cast("int")
    # try_cast of built text: year 0000 gives null where make_date would raise.
    jan4 = F.concat(F.regexp_extract(text, WEEK_DATE, 1), F.lit("-01-04")).try_cast("date")
    monday = F.date_sub(jan4, F.weekday(jan4))
    found = F.date_add(monday, (week - 1) * 7 + day - 1)
    return F.when(
        week.between(1, 53) & day.between(1, 7) & (F.extract(F.lit("YEAROFWEEK"), found) == year),
        found,
    )


def iso_date(text: Column) -> Column:
    text = text.cast("string")  # native dates print as ISO, so they pass unchanged
    return (
        F.when(text.rlike(DATE), text.try_cast("date"))
        .when(text.rlike(COMPACT_DATE), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("date"))
        .when(text.rlike(WEEK_DATE), _week_date(text))
    )


def iso_timestamp(text: Column) -> Column:
    """Extended and basic forms, week dates, any separator before the time, hours alone, fractions of
    any length (cut to microseconds) after a dot or comma, offsets down to seconds.  A time without
    an offset is in the session's zone.

    Taking a text apart costs some forty pattern matches, so the plain spelling is cast at once."""
    part = lambda i: F.regexp_extract(text, TIMESTAMP, i)
    digits = lambda t: F.rpad(F.regexp_replace(F.regexp_extract(t, r"^[+-]?([\d:]*)", 1), ":", ""), 6, "0")
    two = lambda t, at: F.substring(digits(t), at, 2)
    clock, offset = part(2), part(3)
    fraction = F.rpad(F.substring(F.regexp_extract(clock, r"[.,](\d+)$", 1), 1, 6), 6, "0")
    stamp = F.concat(
        iso_date(part(1)).cast("string"), F.lit(" "), two(clock, 1), F.lit(":"), two(clock, 3), F.lit(":"), two(clock, 5),
        F.lit("."), fraction, F.when(offset != "", F.lit("Z")).otherwise(F.lit(""))).try_cast("timestamp")
    hours, minutes, seconds = (two(offset, i).try_cast("int") for i in (1, 3, 5))
    ahead = F.when(offset.startswith("-"), F.lit(-1)).otherwise(F.lit(1)) * F.coalesce(hours * 3600 + minutes * 60 + seconds, F.lit(0))
    sane = F.coalesce((hours < 24) & (minutes < 60) & (seconds < 60), F.lit(True))
    moved = F.timestamp_add("SECOND", -ahead, stamp)
    return F.when(text.rlike(PLAIN_TIMESTAMP), text.try_cast("timestamp")).when(text.rlike(TIMESTAMP) & sane, moved)


def integer(text: Column) -> Column:
    return F.when(text.rlike(INTEGER), F.trim(text).try_cast("bigint"))


def number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
