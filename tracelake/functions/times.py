"""Column functions on times: mixed encodings, phrases, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT_SECONDS = {"h": 3600, "m": 60, "d": 86400, "w": 604800, "mo": 2592000, "y": 31536000}


def normalize_ts(value: Column, mode: str = "jsonl") -> Column:
    """Instant of an ISO string or number.  `jsonl` reads numbers under 2e9 as seconds, `search` those over 1e12 as milliseconds."""
    text = value.cast("string")
    number = F.when(text.rlike(r"^\s*-?[0-9]+(\.[0-9]+)?\s*$"), F.expr("0D") + F.trim(text).try_cast("double"))
    millis = F.when(number < 2e9, number * 1000).otherwise(number) if mode == "jsonl" else F.when(number > 1e12, number).otherwise(number * 1000)
    return F.coalesce(F.timestamp_millis(millis.cast("long")), F.when(number.isNull(), F.try_to_timestamp(text)))


def resolve_time(phrase: Column, as_of: Column) -> Column:
    """Start of what a time phrase names, in the session's time zone; null where it isn't understood."""
    norm = F.trim(F.regexp_replace(F.lower(phrase), r"\s+", " "))
    day, week, month = (F.date_trunc(u, as_of) for u in ("day", "week", "month"))
    hours = lambda n: F.make_dt_interval(hours=F.lit(n))
    days = lambda n: F.make_dt_interval(days=F.lit(n))
    amount = F.regexp_extract(phrase, r"^(\d+)(?:mo|[dhmwy])$", 1).try_cast("long")
    unit = F.regexp_extract(phrase, r"^\d+(mo|[dhmwy])$", 1)
    seconds = sum((F.when(unit == u, amount * s).otherwise(0) for u, s in UNIT_SECONDS.items()), F.lit(0))
    back = F.when(amount.isNotNull(), F.timestamp_millis(F.unix_millis(as_of) - seconds * 1000))
    dated = F.when(phrase.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(phrase))
    return (
        F.when(norm.isin("today", "this day"), day)
        .when(norm.isin("yesterday", "last night"), day - days(1))
        .when(norm == "this morning", day + hours(6))
        .when(norm == "this afternoon", day + hours(12))
        .when(norm == "this evening", day + hours(18))
        .when(norm == "tonight", day + hours(21))
        .when(norm == "this hour", F.date_trunc("hour", as_of))
        .when(norm == "this week", week)
        .when(norm == "last week", week - days(7))
        .when(norm == "this month", month)
        .when(norm == "last month", F.date_trunc("month", month - days(1)))
        .otherwise(F.coalesce(back, dated))
    )


def time_window(events: DataFrame, since: Column | None = None, before: Column | None = None, ts: str = "ts") -> DataFrame:
    """Events from `since` to `before`, both included; a row without a time goes if there is a bound."""
    if since is not None:
        events = events.where(F.col(ts) >= since)
    return events if before is None else events.where(F.col(ts) <= before)
