"""The daily chain broken after each of its writes gives, started again, the tables of an unbroken run."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from probelake.operators import state
from probelake.plans import chain, commits
from probelake.sources import sinks
from tests.test_state import START, frame, observations

DAYS = [dt.date(2018, 8, 16), dt.date(2018, 8, 17)]
UNTIL = dt.date(2018, 8, 18)


class Broken(Exception):
    pass


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rnd, path = random.Random(41), str(tmp_path_factory.mktemp("observations"))
    for n, day in enumerate(DAYS):
        sinks.write_observations(frame(spark, [(r[0], day, *r[2:]) for r in observations(rnd, 60, START + 86_400 * n)]), path)
    return path


@pytest.fixture(scope="module")
def dimensions(spark):
    four = spark.createDataFrame([(0, 1, 8), (1 << 31, 1, 9)], "network long, masklen int, asn int")
    six = spark.createDataFrame([(b"\0" * 16, 0, 6)], "network binary, masklen int, asn int")
    return spark.createDataFrame([(1, 64500, -1), (2, 3333, 64500)], "prb_id long, asn_v4 int, asn_v6 int"), four, six


def run(spark, stored, at, dimensions, **more):
    return chain.run_days(spark, UNTIL, stored, f"{at}/snapshots", f"{at}/timelines", DAYS[0], dimensions=dimensions, histories=f"{at}/histories", **more)


def tables(spark, at):
    out = {}
    for name in ("snapshots", *[f"histories/{x}" for x in ("by_probe", "by_asn", "ips_by_asn")]):
        out[name] = sorted(map(str, spark.read.parquet(f"{at}/{name}").collect()))
    for day in DAYS:
        out[f"timeline {day}"] = sorted(map(str, spark.read.option("header", True).csv(f"{at}/timelines/day={day}").collect()))
    return out


def breaking(monkeypatch, after):
    """Fails after so many writes; returns how many there were."""
    count = [0]
    for kind in ("parquet", "csv"):
        def write(self, *args, own=getattr(DataFrameWriter, kind), **options):
            own(self, *args, **options)
            count[0] += 1
            if count[0] == after:
                raise Broken
        monkeypatch.setattr(DataFrameWriter, kind, write)
    return count


@pytest.fixture(scope="module")
def unbroken(spark, stored, dimensions, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("unbroken"))
    assert run(spark, stored, at, dimensions) == DAYS
    assert run(spark, stored, at, dimensions) == []
    got = tables(spark, at)
    assert all(got.values())
    return got


def test_a_break_after_each_write(spark, stored, dimensions, unbroken, tmp_path, monkeypatch):
    """Each of the writes of the second day, after a whole first one."""
    first = tmp_path / "first"
    args = (f"{first}/snapshots", f"{first}/timelines", DAYS[0])
    assert chain.run_days(spark, DAYS[1], stored, *args, dimensions=dimensions, histories=f"{first}/histories") == DAYS[:1]
    for after in range(1, 7):  # work, snapshot, timeline and three histories
        at = shutil.copytree(first, tmp_path / str(after))
        with monkeypatch.context() as patch:
            writes = breaking(patch, after)
            with pytest.raises(Broken):
                run(spark, stored, at, dimensions)
        assert writes[0] == after and set(commits.committed(spark, f"{at}/snapshots_commits")) == {DAYS[0]}
        assert run(spark, stored, at, dimensions) == [DAYS[1]]
        assert tables(spark, at) == unbroken, after


def test_a_break_before_the_record(spark, stored, dimensions, unbroken, tmp_path, monkeypatch):
    at = str(tmp_path)
    with monkeypatch.context() as patch:
        patch.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(Broken()))
        with pytest.raises(Broken):
            run(spark, stored, at, dimensions)
    assert run(spark, stored, at, dimensions) == DAYS and tables(spark, at) == unbroken


def test_records_and_open_days(spark, stored, dimensions, unbroken, tmp_path):
    """A day whose record is lost is done again with all later ones; a missing step alone is made up."""
    at, log = str(tmp_path), str(tmp_path / "snapshots_commits")
    chain.run_days(spark, UNTIL, stored, f"{at}/snapshots", f"{at}/timelines", DAYS[0])
    assert commits.committed(spark, log) == {d: {"state"} for d in DAYS}
    before = (tmp_path / "snapshots" / f"day={DAYS[0]}").stat().st_mtime_ns
    assert run(spark, stored, at, dimensions) == DAYS
    assert (tmp_path / "snapshots" / f"day={DAYS[0]}").stat().st_mtime_ns == before  # the state was not made again
    assert tables(spark, at) == unbroken
    commits.revoke(spark, log, DAYS[1])
    assert set(commits.committed(spark, log)) == {DAYS[0]} and run(spark, stored, at, dimensions) == [DAYS[1]]
    commits.revoke(spark, log, DAYS[0])
    commits.commit(spark, log, DAYS[1], ["state", "history"])
    assert run(spark, stored, at, dimensions) == DAYS and tables(spark, at) == unbroken


def test_a_repeated_day_leaves_nothing_of_the_first(spark, dimensions, tmp_path):
    """A report is broken, then the day's observations change: folders of selections that are no more are gone."""
    stored, at = str(tmp_path / "observations"), str(tmp_path)
    args = (f"{at}/snapshots", f"{at}/timelines", DAYS[0])
    rows = [(r[0], DAYS[0], *r[2:]) for r in observations(random.Random(3), 150)]
    sinks.write_observations(frame(spark, rows), stored)
    chain.run_days(spark, DAYS[1], stored, *args, reports=f"{at}/reports", dimensions=dimensions, depth=1, by=())
    wide = {p.name for p in (tmp_path / "reports/members" / f"day={DAYS[0]}").iterdir()}
    few = [r for r in rows if r[7]]  # errors only
    commits.remove(spark, stored)
    sinks.write_observations(frame(spark, few), stored)
    commits.revoke(spark, f"{at}/snapshots_commits", DAYS[0])
    chain.run_days(spark, DAYS[1], stored, *args, reports=f"{at}/reports", dimensions=dimensions, depth=1, by=())
    assert {p.name for p in (tmp_path / "reports/members" / f"day={DAYS[0]}").iterdir() if p.is_dir()} < wide
    assert spark.read.parquet(f"{at}/snapshots").count() == len({(r[5], r[6]) for r in few})


def test_a_day_without_rows_is_done(spark, stored, dimensions, tmp_path):
    """Days before and after the observations; histories start from the newest stored day."""
    at, last = str(tmp_path), dt.date(2018, 8, 20)
    days = [dt.date(2018, 8, 15) + dt.timedelta(n) for n in range(5)]
    assert chain.run_days(spark, last, stored, f"{at}/snapshots", f"{at}/timelines", days[0], dimensions=dimensions, histories=f"{at}/histories") == days
    snapshot = spark.read.parquet(f"{at}/snapshots")
    # An empty day carries the state on.
    assert snapshot.filter(F.col("day") == F.lit(days[-1])).count() == snapshot.filter(F.col("day") == F.lit(DAYS[1])).count() > 0
    assert spark.createDataFrame([], chain.snapshot_schema()).drop("day").schema.names == state.day_state(frame(spark, []))[0].schema.names
