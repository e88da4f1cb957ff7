"""Sinks: partitioned Parquet for all intermediate tables, CSV for the timeline and the wide report."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.functions import schema as S
from probelake.functions.addresses import address_text, given, v4_text
from probelake.functions.dates import seconds_text


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that ``df`` has, so running a day again gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_observations(rows: DataFrame, path: str) -> None:
    """Sorted by time within files; files of a measurement and day hold ranges of its time, so a large one is many tasks."""
    write_partitions(rows.repartitionByRange("msm_id", "day", "time", "seq").sortWithinPartitions("msm_id", "day", "time", "seq"), path, ["msm_id", "day"])


def write_snapshot(snapshot: DataFrame, path: str, day: str) -> None:
    write_partitions(snapshot.withColumn("day", F.lit(day).cast("date")), path, ["day"])


def staged(df: DataFrame, path: str) -> DataFrame:
    """``df`` written and read back; a repetition replaces it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder that the session names and read back; only a local session may go without one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def write_report(report: DataFrame, path: str) -> None:
    """A long table of the report, partitioned by day, so that a repeated day does not double."""
    write_partitions(report, path, ["day"])


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of one folder in few files: dealt by folder, a large one over several tasks by a salt."""
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in by]), F.lit(SALT))
    return rows.withColumn("salt", salt).repartition(*by, "salt").drop("salt")


#: Files of a folder, at most.
SALT = 8


def write_selections(members: DataFrame, path: str) -> None:
    """A folder for each day and selection: sel1, sel2 ('-' where there is none)."""
    parts = F.split("selection", "/")
    named = members.withColumns({"sel1": F.when(F.col("selection") == "", "-").otherwise(parts[0]), "sel2": F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("-"))}).drop("selection")
    by = [*(["day"] if "day" in members.columns else []), "sel1", "sel2"]
    write_partitions(_dealt(named, *by), path, by)


def write_dimension(rows: DataFrame, path: str, dim: str, item: str) -> None:
    """Reports of one dimension's items ('prb', 'res', 'auth' or 'probe'): a folder for each day and item."""
    by = [*(["day"] if "day" in rows.columns else []), "dim", item]
    write_partitions(_dealt(rows.withColumn("dim", F.lit(dim)), *by), path, by)


def write_report_csv(wide: DataFrame, path: str) -> None:
    """The wide report with a header, a folder for each day; a repeated day is replaced."""
    wide.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).option("escape", '"').partitionBy("day").csv(path)


def timeline_columns() -> list[tuple[str, Column]]:
    """The 67 columns of the timeline, by name."""
    one = lambda column, value: F.when(F.col(column) == value, 1).otherwise(0)
    out = [
        ("datetime", seconds_text(F.col("updated"))), ("probe ID", F.col("prb_id")), ("probe resolver", address_text(F.col("addr"))),
        # Names of the questions whose answers these are.
        ("o-o.myaddr.l.google.com TXT", v4_text(given(F.col("whoami_g")))), ("whoami.akamai.net A", v4_text(given(F.col("whoami_a")))), ("whoami AAAA", address_text(given(F.col("whoami_6")))),
        ("can_ipv6", F.when(given(F.col("whoami_6")).isNotNull(), 1).otherwise(0)), ("can_tcp", F.col("tcp_ipv4")), ("can_tcp6", F.col("tcp_ipv6")), ("ecs_mask", F.col("ecs_mask")), ("ecs_mask6", F.col("ecs_mask6")),
        ("does_ecs", F.when((F.col("ecs_mask") != 0) | (F.col("ecs_mask6") != 0), 1).otherwise(0)), ("does_flagday", one("does_flagday", S.CAN)),
        ("does_qnamemin", one("qnamemin", S.CAN)), ("doesnt_qnamemin", one("qnamemin", S.CANNOT)),
        *[(f"hijacked #{k}", v4_text(given(F.try_element_at(F.col("hijacked"), F.lit(k + 1))))) for k in range(4)],
        ("does_nxdomain", one("nxdomain", S.CAN)), ("doesnt_nxdomain", one("nxdomain", S.CANNOT)),
    ]
    for anchor in ("ta_19036", "ta_20326"):
        out += [(f"has_{anchor}", one(f"has_{anchor}", S.CAN)), (f"hasnt_{anchor}", one(f"has_{anchor}", S.CANNOT))]
    for pair in S.PAIRS:
        name = pair.split("_", 1)[1]
        out += [(f"{verb}_{name}", one(f"{pair}_result", k)) for k, verb in ((S.CAN, "can"), (S.CANNOT, "cannot"), (S.BROKEN, "broken"))]
    return out


def timeline_rows(timeline: DataFrame) -> DataFrame:
    return timeline.select(*[c.alias(n) for n, c in timeline_columns()])


def write_timeline(timeline: DataFrame, path: str) -> None:
    timeline_rows(timeline).write.mode("overwrite").option("header", True).option("nullValue", "NULL").csv(path)


def report_columns() -> list[str]:
    """Names of the wide report, in order; what the long form gives is pivoted onto them last."""
    out = ["datetime", "# probes", "# resolvers"]
    for _, names in S.CAPABILITIES:
        out += [*names, *[f"{n}_prbs" for n in names]]
    for mask in ("ECS mask", "ECS mask6"):
        for k in range(1, 11):
            out += [f"{mask} #{k}", f"{mask} #{k} count"]
        out.append(f"Remaining {mask} count")
    for dim in ("probe", "resolver", "auth", "nxhj"):
        for k in range(1, 101):
            out += [f"{dim} #{k} total", f"{dim} #{k} ASNs"]
        out.append(f"Remaining {dim} ASNs count")
    return out


def wide_report(base: DataFrame, values: DataFrame, masks: DataFrame, bands: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row for each ``key`` (day and selection) with all columns of the report.

    ``base``: datetime, n_probes, n_resolvers. ``values``: value, n, n_prbs. ``masks``: family
    ('ECS mask' or 'ECS mask6'), rank (null: remaining), mask, n. ``bands``: dim, band (null:
    remaining), total, label. All with the key. Cells are made long first and gathered by one
    aggregation into a map, so no pivot of hundreds of columns is planned.
    """
    key = key or ["day", "selection"]
    cell = lambda name, value: F.struct(name.alias("k"), value.cast("string").alias("v"))
    value_cells = F.array(cell(F.col("value"), F.col("n")), cell(F.concat("value", F.lit("_prbs")), F.col("n_prbs")))
    number = F.concat(F.col("family"), F.lit(" #"), F.col("rank"))
    mask_cells = F.when(F.col("rank").isNull(), F.array(cell(F.concat(F.lit("Remaining "), F.col("family"), F.lit(" count")), F.col("n")))).otherwise(F.array(cell(number, F.col("mask")), cell(F.concat(number, F.lit(" count")), F.col("n"))))
    number = F.concat(F.col("dim"), F.lit(" #"), F.col("band"))
    band_cells = F.when(F.col("band").isNull(), F.array(cell(F.concat(F.lit("Remaining "), F.col("dim"), F.lit(" ASNs count")), F.col("total")))).otherwise(F.array(cell(F.concat(number, F.lit(" total")), F.col("total")), cell(F.concat(number, F.lit(" ASNs")), F.col("label"))))
    long = values.select(*key, F.explode(value_cells).alias("c")).unionByName(masks.select(*key, F.explode(mask_cells).alias("c"))).unionByName(bands.select(*key, F.explode(band_cells).alias("c")))
    cells = long.groupBy(*key).agg(F.map_from_entries(F.collect_list("c")).alias("cells"))  # at most 962 cells
    names = report_columns()[3:]
    zero = lambda n: F.lit("") if n.endswith(" ASNs") else F.lit("0")
    return base.join(cells, key, "left").select(*key, "datetime", F.col("n_probes").alias("# probes"), F.col("n_resolvers").alias("# resolvers"), *[F.coalesce(F.try_element_at(F.col("cells"), F.lit(n)), zero(n)).alias(n) for n in names])
