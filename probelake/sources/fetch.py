"""Fetching of measurement days over HTTP: a Python data source, in batch and as a stream; needs a network.

Each fetch of a measurement's day is a task. A fetch that fails is a row with its status,
and the others go on; a load of which nothing came is an error.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from http.client import HTTPException

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from probelake.sources.json_scan import OBJECT_BYTES, _Cutter

#: The status of a fetch that did not end: no answer, or an answer that was cut.
BROKEN = 0
CHUNK = 1 << 20


class MeasurementDays(DataSource):
    """``spark.read`` or ``readStream`` with ``format("measurement_days")``.

    Options: url (a template with {msm_id}, {start}, {stop}), msm_ids, and first and until
    (days, the second not included; until today if not given); a batch may have pairs
    ('msm_id:day', by commas) instead. For each fetch there is one row without an object
    that has its status, after the objects (``nth`` numbers them as they came); those of a
    fetch whose status is not 200 do not count.
    """

    @classmethod
    def name(cls) -> str:
        return "measurement_days"

    def schema(self) -> str:
        return "msm_id int, day date, status int, nth long, object string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def _days(first: date, until: date) -> list[date]:
    return [first + timedelta(n) for n in range((until - first).days)]


def objects(chunks: Iterator[bytes]) -> Iterator[str]:
    """The objects of an array that comes in chunks; none is held longer than until its end."""
    cutter, rest = _Cutter(OBJECT_BYTES), b""
    cutter.begin("", 0, False, 0, 0)
    for chunk in chunks:
        *pieces, rest = (rest + chunk).split(b"}")
        for piece in pieces:
            cutter.add(piece.decode("utf-8", "replace"), True)
        yield from (o["text"] for o in cutter.out)
        cutter.out = []
    cutter.add(rest.decode("utf-8", "replace"), False)
    cutter.give(False)
    yield from (o["text"] for o in cutter.out)


def _fetch(url: str, msm_id: int, day: date) -> Iterator[tuple]:
    start = int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp())
    status = BROKEN
    try:
        with urllib.request.urlopen(url.format(msm_id=msm_id, start=start, stop=start + 86_400), timeout=300) as got:
            for nth, text in enumerate(objects(iter(lambda: got.read(CHUNK), b""))):
                yield msm_id, day, 200, nth, text.lstrip(" \t\r\n,[")
            if got.status != 200 or not got.length:  # bytes that were promised and did not come
                status = got.status
    except urllib.error.HTTPError as e:
        status = e.code
    except (OSError, HTTPException):
        status = BROKEN
    yield msm_id, day, status, None, None


class _Options:
    def __init__(self, options: dict):
        self.url = options["url"]
        self.msm_ids = [int(x) for x in options.get("msm_ids", "").split(",") if x]
        self.first = date.fromisoformat(options["first"]) if "first" in options else None
        self.fixed = date.fromisoformat(options["until"]) if "until" in options else None
        pairs = [x.split(":") for x in options.get("pairs", "").split(",") if x]
        self.pairs = [(int(m), date.fromisoformat(d)) for m, d in pairs]

    def until(self) -> date:
        return self.fixed or datetime.now(timezone.utc).date()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _fetch(self.url, *partition.value)


class _Reader(_Options, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.pairs or [(m, d) for d in _days(self.first, self.until()) for m in self.msm_ids]]


class _StreamReader(_Options, DataSourceStreamReader):
    """Offsets are the next day of each measurement, so one that is added later starts at the first day."""

    def initialOffset(self) -> dict:
        return {str(m): str(self.first) for m in self.msm_ids}

    def latestOffset(self) -> dict:
        return {str(m): str(self.until()) for m in self.msm_ids}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((int(m), d)) for m, last in end.items() for d in _days(date.fromisoformat(start.get(m, str(self.first))), date.fromisoformat(last))]

    def commit(self, end: dict) -> None:
        pass


class NothingFetched(Exception):
    """Not one fetch of a load had the status 200."""


def store(fetched: DataFrame, raw: str, statuses: str) -> None:
    """Appends a load: its objects by measurement and day, where the day is whole, and a status for each fetch.

    A load that is stored again replaces the objects of its days. Raises if nothing came.
    """
    held = fetched.persist()
    try:
        status = held.filter("object IS NULL").select("msm_id", "day", "status")
        whole = status.filter("status = 200").select("msm_id", "day")
        if whole.isEmpty() and not status.isEmpty():
            raise NothingFetched(", ".join(f"{r.msm_id} {r.day}: {r.status}" for r in status.limit(20).collect()))
        days = held.filter("object IS NOT NULL").join(whole, ["msm_id", "day"])
        days.select("msm_id", "day", "nth", "object").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("msm_id", "day").parquet(raw)
        status.write.mode("append").parquet(statuses)
    finally:
        held.unpersist()


def missing(spark: SparkSession, statuses: str, msm_ids: list[int], first: date, until: date) -> DataFrame:
    """msm_id, day: what has not been fetched whole."""
    days = spark.createDataFrame([(m, d) for d in _days(first, until) for m in msm_ids], "msm_id int, day date")
    done = spark.read.schema("msm_id int, day date, status int").parquet(statuses).filter("status = 200").select("msm_id", "day").distinct()
    return days.join(done, ["msm_id", "day"], "left_anti").select("msm_id", "day")


def fetch_missing(spark: SparkSession, url: str, raw: str, statuses: str, msm_ids: list[int], first: date, until: date) -> int:
    """Fetches and stores what is missing; the number of fetches. The list has a row for each measurement and day."""
    pairs = missing(spark, statuses, msm_ids, first, until).collect()
    if pairs:
        spark.dataSource.register(MeasurementDays)
        store(spark.read.format("measurement_days").option("url", url).option("pairs", ",".join(f"{r.msm_id}:{r.day}" for r in pairs)).load(), raw, statuses)
    return len(pairs)


def follow(spark: SparkSession, url: str, raw: str, statuses: str, checkpoint: str, msm_ids: list[int], first: date, until: date | None = None):
    """Stores all new days up to ``until`` (today) as a stream; a broken load is fetched again, a whole one never."""
    spark.dataSource.register(MeasurementDays)
    read = spark.readStream.format("measurement_days").option("url", url).option("msm_ids", ",".join(map(str, msm_ids))).option("first", str(first))
    read = read if until is None else read.option("until", str(until))
    return read.load().writeStream.foreachBatch(lambda batch, _: store(batch, raw, statuses)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
