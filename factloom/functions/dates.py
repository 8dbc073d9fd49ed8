"""Lenient dates, displayed ages and UTC periods."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factloom.functions import let

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

# Accepted spellings of a date behind its weekday, tried in order after ISO 8601.
DATE_FORMATS = (
    "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss",
    "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/MM/dd",
)

# Length of the units of a displayed age, in milliseconds.
AGE_UNITS = (
    ("second", 1_000), ("minute", 60_000), ("hour", 3_600_000), ("day", 86_400_000),
    ("week", 7 * 86_400_000), ("month", 30 * 86_400_000), ("year", 365 * 86_400_000),
)


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)


def parse_date(c: Column) -> Column:
    """Timestamp of an ISO, RSS or written date, else null."""
    text = F.regexp_replace(F.regexp_replace(F.trim(c), r"\b(GMT|UT|UTC)$", "+0000"), r"^[A-Za-z]{3,9},\s*", "")
    iso_like = lambda t: F.when(t.rlike(r"^\d{4}(-\d{2}){0,2}([T ]|$)"), t.try_cast("timestamp"))
    return let(text, lambda t: F.coalesce(iso_like(t), *[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]))


# Seconds of a valid time are below this.
LAST_SECOND = 8.64e12


def from_epoch_seconds(c: Column) -> Column:
    """Timestamp of finite epoch seconds."""
    valid = lambda s: ~F.isnan(s) & (F.abs(s) < LAST_SECOND)
    return let(c.try_cast("double"), lambda s: F.when(valid(s), F.timestamp_micros((s * 1_000_000).cast("long"))))


def page_date(c: Column, url_path: Column, as_of: Column) -> Column:
    """A published date is dropped on a site root and when more than a day ahead."""
    return F.when(url_path != "/", modified_date(c, as_of))


def modified_date(c: Column, as_of: Column) -> Column:
    return let(parse_date(c), lambda ts: F.when(ts <= as_of + F.expr("INTERVAL 1 DAY"), ts))


def displayed_age_ms(c: Column) -> Column:
    """Milliseconds of a label such as `3 weeks ago`; null when it is no age."""
    label = F.trim(F.regexp_replace(F.lower(c), ",", ""))
    pattern = r"(\d+(?:\.\d+)?)\s+(second|minute|hour|day|week|month|year)s?\s+ago\b"
    amount = F.regexp_extract(label, pattern, 1).try_cast("double")
    unit = F.regexp_extract(label, pattern, 2)
    length = F.lit(None).cast("long")
    for name, ms in AGE_UNITS:
        length = F.when(unit == name, F.lit(ms)).otherwise(length)
    return (
        F.when(label.rlike(r"\bjust now\b"), F.lit(0.0))
        .when(label.rlike(r"\btoday\b"), F.lit(43_200_000.0))
        .when(label.rlike(r"\byesterday\b"), F.lit(86_400_000.0))
        .otherwise(amount * length)
    )


def absolute_display_date(c: Column) -> Column:
    """Date of a label unless it is a relative age."""
    relative = c.rlike(r"(?i)\b(?:ago|yesterday|today|hour|minute|week|month)\b")
    return F.when(~relative, parse_date(c))


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def funding_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
