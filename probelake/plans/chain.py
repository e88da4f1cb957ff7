"""The daily chain: state, report, history. Days depend on the day before and run in order.

A day counts as done when its commit record says so (commits), which is made after all its
outputs. A run that breaks anywhere is started again from the first day without a record.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.functions import classify
from probelake.functions import schema as S
from probelake.functions.addresses import v4_bytes, v4_number
from probelake.functions.dates import on_day, seconds_text
from probelake.operators import cube, history, netjoin, ranking, state
from probelake.plans import commits
from probelake.sources import readers, sinks

FIRST_DAY = date(2017, 4, 20)


def next_day(spark: SparkSession, snapshots: str, first: date = FIRST_DAY) -> date:
    """The day after the newest stored snapshot, else the first one; whether that day's other tables are there, the commit records tell."""
    newest = _newest(spark, snapshots)
    return first if newest is None else newest + timedelta(days=1)


def _newest(spark: SparkSession, path: str, before: date | None = None) -> date | None:
    """The newest stored day of a table, before a day."""
    if not _has(spark, path):
        return None
    days = spark.read.parquet(path)
    return (days if before is None else days.filter(F.col("day") < F.lit(before))).agg(F.max("day").alias("d")).first().d


def _before(spark: SparkSession, path: str, day: date) -> DataFrame | None:
    """The rows of the newest stored day before a day; a day that left no rows is not stored."""
    newest = _newest(spark, path, day)
    return None if newest is None else spark.read.parquet(path).filter(F.col("day") == F.lit(newest)).drop("day")


def snapshot_schema() -> str:
    """Of the stored snapshots, also where no day left any rows."""
    kinds = {"whoami_g": "binary", "whoami_a": "binary", "whoami_6": "binary", "hijacked": "array<binary>"}
    return ", ".join(["prb_id long", "addr binary", *[f"{c} {kinds.get(c, 'int')}" for c in state.SNAPSHOT_STATES], "updated long", "logged long", "day date"])


def run_day(spark: SparkSession, day: date, observations: str, snapshots: str, timelines: str) -> None:
    """The state of a day from its observations and the newest snapshot before it; messages are decoded once."""
    rows = readers.read_observations(spark, observations, str(day), str(day + timedelta(days=1)))
    previous = _before(spark, snapshots, day)
    commits.remove(spark, f"{snapshots}/day={day}")  # a repetition may have no rows to replace it with
    work = f"{timelines}_work/day={day}"
    snapshot, timeline = state.day_state(rows, previous, F.lit(str(day)), hold=lambda df: sinks.staged(df, work))
    sinks.write_snapshot(snapshot, snapshots, str(day))
    sinks.write_timeline(timeline, f"{timelines}/day={day}")
    commits.remove(spark, work)


def _has(spark: SparkSession, path: str) -> bool:
    """Has a table any day? A folder to which only empty days were written has none, nor a schema."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day=*")
    return len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []) > 0


def today(snapshot: DataFrame, day: date) -> DataFrame:
    """Entities updated on the day; a snapshot holds ten days of them."""
    return snapshot.filter(on_day(F.timestamp_seconds("updated"), F.lit(day)))


def enriched(snapshot: DataFrame, day: date, probes: DataFrame, prefixes4: DataFrame, prefixes6: DataFrame) -> DataFrame:
    """Entities of the day with their ASNs, their class, and the reported values that they hold."""
    rows = netjoin.enrich(today(snapshot, day), probes, prefixes4, prefixes6)
    asn = [F.col(c) for c in ("prb_4", "prb_6", "res", "auth_g", "auth_a", "auth_6")]
    rows = rows.withColumn("origin", classify.origin_class(*asn)).withColumns({f"{k}_asn": v for k, v in classify.attributed(*asn).items()})
    return rows.withColumn("held_values", cube.held_values(classify.capability_values(F.col("origin")), dict(S.CAPABILITIES)))


#: Dimensions of a report: the ASN that a row counts for, and whether it counts.
DIMENSIONS = {"probe": ("probe_asn", None), "resolver": ("resolver_asn", None), "auth": ("auth_asn", None), "nxhj": ("nxhj", F.col)}


#: Families of masks by their columns.
MASKS = {"ECS mask": "ecs_mask", "ECS mask6": "ecs_mask6"}


def report_tables(rows: DataFrame, day: date, depth: int, extra: list[str] | None = None, flags: DataFrame | None = None) -> dict[str, DataFrame]:
    """base, values, masks and bands of the enriched ``rows`` by selection, for each group of ``extra`` columns; all long, with the day."""
    extra, held = extra or [], F.col("held_values")
    by = [*extra, "selection"]
    counted = {dim: (F.col(column), positive(column) > 0 if positive else None) for dim, (column, positive) in DIMENSIONS.items()}
    bands = ranking.bands(cube.histograms(rows, counted, held, depth, extra).withColumnRenamed("family", "dim"), [*by, "dim"], "value", few_groups=not extra)
    families = {family: (F.col(column), F.col(column) != 0) for family, column in MASKS.items()}
    masks = ranking.top_n(cube.histograms(rows, families, held, depth, extra), [*by, "family"], "value", "n", ranking.TOP_MASKS).withColumnRenamed("value", "mask")
    base = cube.cube(rows, held, "prb_id", depth, updated="updated", extra=extra).withColumn("datetime", seconds_text(F.col("updated")))
    values = cube.value_counts(rows, held, "prb_id", depth, extra, flags)
    return {n: t.withColumn("day", F.lit(day)) for n, t in (("base", base), ("values", values), ("masks", masks), ("bands", bands))}


def wide(tables: dict[str, DataFrame], extra: list[str] | None = None) -> DataFrame:
    return sinks.wide_report(tables["base"], tables["values"], tables["masks"], tables["bands"], ["day", *(extra or []), "selection"])


def report(snapshot: DataFrame, day: date, probes: DataFrame, prefixes4: DataFrame, prefixes6: DataFrame, depth: int = 2) -> dict[str, DataFrame]:
    """The tables of a day's report, with ``enriched``, their common input, and the members of all selections.

    ``enriched`` is read by each; run_report() writes it first.
    """
    return tables_of(enriched(snapshot, day, probes, prefixes4, prefixes6), day, depth)


def tables_of(rows: DataFrame, day: date, depth: int = 2) -> dict[str, DataFrame]:
    members = cube.members(rows, F.col("held_values"), "prb_id", F.col("addr"), depth).withColumn("day", F.lit(day))
    return {"enriched": rows, "members": members, **report_tables(rows, day, depth)}


def dimension_rows(rows: DataFrame, prefix: str) -> DataFrame:
    """The enriched rows that count for each of the top 100 ASNs (column ``asn``) of a dimension: 'prb', 'res' or 'auth'."""
    counted, candidates, within = {
        "prb": ("probe_asn", F.array(F.when(F.col("prb_4") > 0, F.col("prb_4")), F.when(F.col("prb_6") > 0, F.col("prb_6"))), None),
        "res": ("resolver_asn", F.array("res"), None),
        "auth": ("auth_asn", F.array("auth_g", "auth_a", "auth_6"), 0),
    }[prefix]
    counts = rows.groupBy(F.col(counted).alias("asn")).agg(F.count("*").alias("n"))
    return ranking.top_semi_join(rows, candidates, ranking.ranked_top(counts, "asn", "n", ranking.TOP_ASNS), "asn", within).drop("rank", "n")


def dimension_reports(rows: DataFrame, prefix: str, day: date) -> tuple[DataFrame, DataFrame]:
    """(wide reports, members) of depth 1 for each of the top ASNs of a dimension; probes' flags are those of all their rows."""
    own = dimension_rows(rows, prefix)
    tables = report_tables(own, day, 1, ["asn"], cube.probe_flags(rows, F.col("held_values"), "prb_id"))
    held = F.col("held_values")
    members = own.select("asn", F.explode(cube.selections(held, 1)).alias("selection"), F.col("prb_id").alias("probe"), F.col("addr").alias("address")).withColumn("day", F.lit(day))
    return wide(tables, ["asn"]), members


def probe_reports(rows: DataFrame, day: date) -> DataFrame:
    """The wide report of each probe over its own resolvers; a single probe has no counts of probes."""
    tables = report_tables(rows.withColumn("item", F.col("prb_id")), day, 0, ["item"])
    tables["base"] = tables["base"].withColumn("n_probes", F.lit(0))
    tables["values"] = tables["values"].withColumn("n_prbs", F.lit(0))
    return wide(tables, ["item"])


def run_report(spark: SparkSession, day: date, snapshots: str, reports: str, probes: DataFrame, prefixes4: DataFrame, prefixes6: DataFrame, depth: int = 2, by: tuple[str, ...] = ("prb", "res", "auth")) -> None:
    """The whole report of a day from its stored snapshot; a repeated day replaces what it wrote.

    Under ``reports``: base, values, masks and bands (long, by day), report (wide CSV of all
    selections), probes (a wide report for each), dimensions (wide reports of the top ASNs'
    selections, for the dimensions ``by``), members and dimension_members (a folder for each
    selection or ASN).
    """
    snapshot = spark.read.schema(snapshot_schema()).parquet(snapshots).filter(F.col("day") == F.lit(day)).drop("day")
    for name in ("base", "values", "masks", "bands", "report", "members", "probes", "dimensions", "dimension_members"):
        commits.remove(spark, f"{reports}/{name}/day={day}")  # folders of selections or items that a repetition has no more
    work = f"{reports}_work/day={day}"
    rows = sinks.staged(enriched(snapshot, day, probes, prefixes4, prefixes6), work)
    tables = tables_of(rows, day, depth)
    for name in ("base", "values", "masks", "bands"):
        sinks.write_report(tables[name], f"{reports}/{name}")
        tables[name] = spark.read.schema(tables[name].schema).parquet(f"{reports}/{name}").filter(F.col("day") == F.lit(day))
    sinks.write_report_csv(wide(tables), f"{reports}/report")
    sinks.write_selections(tables["members"], f"{reports}/members")
    sinks.write_report(probe_reports(rows, day), f"{reports}/probes")
    for dim in by:
        own, members = dimension_reports(rows, dim, day)
        sinks.write_dimension(own, f"{reports}/dimensions", dim, "asn")
        sinks.write_dimension(members, f"{reports}/dimension_members", dim, "asn")
    commits.remove(spark, work)


def run_history(spark: SparkSession, day: date, timelines: str, histories: str, prefixes4: DataFrame) -> None:
    """The three histories of rewritten answers after a day: the newest before it, and the day's timeline, without what has expired."""
    rows = readers.read_timeline(spark, f"{timelines}/day={day}")
    ips = rows.select(F.explode("hijacked").alias("ip")).distinct().withColumn("n", v4_number(v4_bytes(F.col("ip"))))
    order = "nth" if "nth" in prefixes4.columns else None
    asns = ips.join(netjoin.lpm_v4(ips.filter("n is not null"), prefixes4, "n", order), "n").select("ip", "asn")
    keys = {"by_probe": ["prb_id", "resolver", "asn"], "by_asn": ["asn", "prb_id", "resolver"], "ips_by_asn": ["asn", "ip"]}
    for name, new in history.rewrites(rows, asns).items():
        path = f"{histories}/{name}"
        old = _before(spark, path, day)
        commits.remove(spark, f"{path}/day={day}")
        sinks.write_partitions(history.fold(old, new, keys[name], F.lit(day)).withColumn("day", F.lit(day)), path, ["day"])


def run_days(
    spark: SparkSession, until: date, observations: str, snapshots: str, timelines: str, first: date = FIRST_DAY, reports: str | None = None,
    dimensions: tuple[DataFrame, DataFrame, DataFrame] | None = None, depth: int = 2, histories: str | None = None, log: str | None = None, by: tuple[str, ...] = ("prb", "res", "auth"),
) -> list[date]:
    """Every open day from ``first`` to before ``until``, in order; the days on which something was done.

    With ``dimensions`` (probes, IPv4 and IPv6 prefixes), ``reports`` and ``histories`` (a
    folder of the reports if not given) say what is made besides the state. A day is open
    until the ``log`` (beside the snapshots) has a record of all its steps. If a day's state
    is made, all later days are opened too, since they rest on it.
    """
    log = log or f"{snapshots}_commits"
    histories = histories or (f"{reports}/histories" if reports else None)
    work = {"state": lambda day: run_day(spark, day, observations, snapshots, timelines)}
    if reports:
        work["report"] = lambda day: run_report(spark, day, snapshots, reports, *dimensions, depth=depth, by=by)
    if histories:
        work["history"] = lambda day: run_history(spark, day, timelines, histories, dimensions[1])
    done, whole, day = [], commits.committed(spark, log), first
    while day < until:
        missing = [step for step in work if step not in whole.get(day, ())]
        if "state" in missing:
            commits.revoke(spark, log, day)
            whole, missing = {}, list(work)
        for step in missing:
            work[step](day)
        if missing:
            commits.commit(spark, log, day, missing)
            done.append(day)
        day += timedelta(days=1)
    return done
