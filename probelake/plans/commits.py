"""Commit records of the daily chain: which steps of a day are whole.

A record is an empty file named by the day and its steps, made after all outputs of the
steps are written. A file is there or not, in any store, so no record is ever half written;
a day without one is open and is done again from its inputs.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, system = _at(spark, path)
    system.delete(p, True)


def _records(spark: SparkSession, log: str) -> list[tuple[date, list[str], str]]:
    p, system = _at(spark, f"{log}/*.*")
    names = [s.getPath().getName() for s in system.globStatus(p) or []]
    return [(date.fromisoformat(day), steps, name) for name in names for day, *steps in [name.split(".")] if day]


def committed(spark: SparkSession, log: str) -> dict[date, set[str]]:
    """The whole steps of each day that has any."""
    out: dict[date, set[str]] = {}
    for day, steps, _ in _records(spark, log):
        out.setdefault(day, set()).update(steps)
    return out


def commit(spark: SparkSession, log: str, day: date, steps: list[str]) -> None:
    """Says that all outputs of ``steps`` of the day are there."""
    p, system = _at(spark, f"{log}/{day}.{'.'.join(steps)}")
    system.create(p, True).close()


def revoke(spark: SparkSession, log: str, since: date) -> None:
    """Takes back the records of a day and all later ones, the last first: a break leaves no day committed after an open one."""
    for _, _, name in sorted((r for r in _records(spark, log) if r[0] >= since), reverse=True):
        remove(spark, f"{log}/{name}")
