"""Times in UTC: text of reports, its parsing, days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed format of times in timelines and reports.
FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def time_text(time: Column) -> Column:
    """A timestamp, or whole seconds since 1970, as text."""
    return F.date_format(time, FORMAT)


def seconds_text(seconds: Column) -> Column:
    return time_text(F.timestamp_seconds(seconds))


def text_time(text: Column) -> Column:
    """The time of such a text; null for others."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def on_day(time: Column, day: Column) -> Column:
    """Does a timestamp fall on a (UTC) day?"""
    return F.to_date(time) == day.cast("date")
