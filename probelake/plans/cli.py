"""Command line: lookups of one address or probe, and the daily chain.

    python -m probelake.plans.cli asn PREFIXES ADDRESS
    python -m probelake.plans.cli probe PROBES ID
    python -m probelake.plans.cli fetch FIRST UNTIL URL RAW STATUSES CHECKPOINT OBSERVATIONS QUARANTINE
    python -m probelake.plans.cli days UNTIL OBSERVATIONS SNAPSHOTS TIMELINES [REPORTS PROBES PREFIXES4 PREFIXES6]
    python -m probelake.plans.cli report DAY SNAPSHOTS REPORTS PROBES PREFIXES4 PREFIXES6
"""

from __future__ import annotations

import sys
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from probelake.functions import schema as S
from probelake.operators import netjoin
from probelake.plans import chain
from probelake.sources import fetch, readers, sinks


def _dimensions(spark: SparkSession, probes: str, prefixes4: str, prefixes6: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return readers.read_probes(spark, probes), readers.read_prefixes(spark, prefixes4)[0], readers.read_prefixes(spark, prefixes6)[1]


def fetch_days(spark: SparkSession, msm_ids: list[int], first: date, until: date, url: str, raw: str, statuses: str, checkpoint: str, observations: str, quarantine: str) -> int:
    """Fetches new days and once more what is missing, and stores the observations of all days from ``first``; how much is still missing."""
    fetch.follow(spark, url, raw, statuses, checkpoint, msm_ids, first, until).awaitTermination()
    if not fetch.missing(spark, statuses, msm_ids, first, until).isEmpty():
        try:
            fetch.fetch_missing(spark, url, raw, statuses, msm_ids, first, until)
        except fetch.NothingFetched as e:
            print(e)
    for n in range((until - first).days):
        good, bad = readers.read_fetched(spark, raw, str(first + timedelta(n)))
        sinks.write_observations(good, observations)
        sinks.write_partitions(bad, quarantine, ["msm_id", "day"])
    return fetch.missing(spark, statuses, msm_ids, first, until).count()


def main(args: list[str]) -> int:
    if not args or (args[0], len(args)) not in {("asn", 3), ("probe", 3), ("days", 5), ("days", 9), ("report", 7), ("fetch", 9)}:
        print(__doc__)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args[0] == "asn":
        print(netjoin.lookup_address(spark, *readers.read_prefixes(spark, args[1]), args[2]))
    elif args[0] == "probe":
        found = readers.read_probes(spark, args[1]).filter(f"prb_id = {int(args[2])}").first()
        print(found.asDict() if found else "unknown")
    elif args[0] == "fetch":
        print(fetch_days(spark, S.KNOWN, date.fromisoformat(args[1]), date.fromisoformat(args[2]), *args[3:]))
    elif args[0] == "report":
        chain.run_report(spark, date.fromisoformat(args[1]), *args[2:4], *_dimensions(spark, *args[4:]))
    else:
        more = {"reports": args[5], "dimensions": _dimensions(spark, *args[6:])} if len(args) > 5 else {}
        for day in chain.run_days(spark, date.fromisoformat(args[1]), *args[2:5], **more):
            print(day)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
