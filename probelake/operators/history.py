"""Histories of rewritten answers: the last time of each, with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_DAYS = 10


def last_seen(rows: DataFrame, key: list[str], time: str = "dt") -> DataFrame:
    return rows.groupBy(*key).agg(F.max(time).alias(time))


def rewrites(timeline: DataFrame, asns: DataFrame) -> dict[str, DataFrame]:
    """by_probe, by_asn, ips_by_asn: last times of rewrite addresses. ``timeline``: dt, prb_id, resolver, hijacked; ``asns``: ip, asn."""
    each = timeline.select("dt", "prb_id", "resolver", F.explode(F.array_sort(F.array_distinct("hijacked"))).alias("ip")).join(asns, "ip").filter("asn <> 0")
    return {
        "by_probe": last_seen(each, ["prb_id", "resolver", "asn"]),
        "by_asn": last_seen(each, ["asn", "prb_id", "resolver"]),
        "ips_by_asn": last_seen(each, ["asn", "ip"]),
    }


def fold(history: DataFrame | None, new: DataFrame, key: list[str], day: Column, keep_days: int = KEEP_DAYS, time: str = "dt") -> DataFrame:
    """An earlier history and new rows, without what is older than ``keep_days`` before ``day``."""
    both = new.select(*key, time) if history is None else history.select(*key, time).unionByName(new.select(*key, time))
    return last_seen(both, key, time).filter(F.col(time) >= F.date_sub(day, keep_days).cast("timestamp"))
