"""Gates on daily inputs: completeness, order, missing days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds before midnight by which a complete day has its last record.
NEAR_END = 300


def completeness(rows: DataFrame, by: list[str], day: Column, time: str = "time", near: int = NEAR_END) -> DataFrame:
    """by, day, first, last, rows, complete: does the last record lie within ``near`` seconds of midnight?"""
    out = rows.groupBy(*by, day.alias("day")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("rows"))
    gap = F.unix_timestamp(F.date_add("day", 1).cast("timestamp")) - F.unix_timestamp("last")
    return out.withColumn("complete", gap <= near)


def disorder(rows: DataFrame, by: list[str], seq: str, time: str) -> DataFrame:
    """by, rows, back: how often a record's time is before the one that precedes it."""
    order = Window.partitionBy(*by).orderBy(seq)
    return rows.withColumn("before", F.lag(time).over(order)).groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.col("before") > F.col(time)).alias("back"))


def missing_days(existing: DataFrame, day: str, first: Column, last: Column, by: list[str] | None = None) -> DataFrame:
    """Days from ``first`` to ``last`` that are not among the existing ones, for each value of ``by`` if given."""
    by = by or []
    keys = existing.select(*by).distinct() if by else existing.sparkSession.range(1)
    calendar = keys.select(*by, F.explode(F.sequence(first.cast("date"), last.cast("date"))).alias(day))
    return calendar.join(existing.select(*by, F.col(day).cast("date").alias(day)).distinct(), [*by, day], "left_anti")


def newest_missing(existing: DataFrame, day: str, first: Column, last: Column) -> DataFrame:
    return missing_days(existing, day, first, last).agg(F.max(day).alias(day))
