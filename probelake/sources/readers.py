"""Readers: measurement JSON, prefix tables, probe archives, ASN names, timelines and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.functions import schema as S
from probelake.functions.addresses import address_bytes, base64_bytes, v4_bytes, v4_number
from probelake.sources import json_scan


#: Attempts of an object that a position has room for.
_ATTEMPTS = 1 << 24


def observations(raw: DataFrame, msm_id, day, order: str | None = None) -> DataFrame:
    """Objects of ``RAW_SCHEMA`` to observations: one row per attempt with an address and an answer or an error.

    The address is ``dst_addr``, else a ``dst_name`` that is an address literal. An answer
    beats an error. ``seq`` is the attempt's position: by ``order`` (a column that numbers
    the objects as their file has them), then by its place in the object, so equal times
    are no open ties. ``msm_id`` and ``day`` are values, or columns of ``raw``.
    """
    first = F.col(order).cast("long") * _ATTEMPTS if order else F.lit(0)
    each = raw.select("prb_id", F.lit(msm_id).cast("int").alias("msm_id"), F.lit(day).cast("date").alias("day"), first.alias("first"), F.posexplode("resultset").alias("nth", "r")).filter("prb_id is not null")
    answer = base64_bytes(F.col("r.result.abuf"))
    # An address that is there but is no literal is not replaced by the name.
    addr = F.when(F.col("r.dst_addr").isNotNull(), address_bytes(F.col("r.dst_addr"))).otherwise(address_bytes(F.col("r.dst_name")))
    return (
        each.select(
            "msm_id", "day", (F.col("first") + F.col("nth")).alias("seq"),
            F.timestamp_seconds(F.coalesce("r.time", F.lit(0))).alias("time"), F.when(F.col("r.result.rt") >= 0, F.col("r.result.rt")).cast("float").alias("rt"),
            "prb_id", addr.alias("addr"), answer.isNull().alias("is_error"), F.coalesce(answer, F.encode(F.col("r.error"), "utf-8")).alias("msg"),
        )
        .filter("addr is not null and msg is not null")
    )


def read_measurements(spark: SparkSession, path: str, msm_id: int, day: str) -> tuple[DataFrame, DataFrame]:
    """(observations, quarantined objects) of JSON files that hold an array of objects each; a file is as many tasks as it has splits.

    Only the columns of ``RAW_SCHEMA`` are parsed. What is no JSON object is kept as text
    with its file and number, never deleted.
    """
    return parse_lines(json_scan.scan_objects(spark, path), "text", msm_id, day, "number")


def read_fetched(spark: SparkSession, path: str, day: str) -> tuple[DataFrame, DataFrame]:
    """(observations, quarantined objects) of a day as ``fetch.store`` has it, all measurements."""
    rows = spark.read.schema("nth long, object string, msm_id int, day date").parquet(path).filter(F.col("day") == F.lit(day).cast("date"))
    return parse_lines(rows, "object", F.col("msm_id"), F.col("day"), "nth")


def parse_lines(lines: DataFrame, column: str, msm_id, day, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The same for a text column with one object in each row; ``order``: a column that numbers them. Quarantined rows are whole."""
    parsed = lines.withColumn("o", F.from_json(column, f"{S.RAW_SCHEMA}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("o").isNull() | F.col("o._corrupt_record").isNotNull()
    named = {"object_msm_id": F.lit(msm_id), "object_day": F.lit(day), **({"object_order": F.col(order)} if order else {})}
    kept = parsed.filter(~broken).select("o.prb_id", "o.resultset", *[c.alias(n) for n, c in named.items()])
    return observations(kept, F.col("object_msm_id"), F.col("object_day"), "object_order" if order else None), parsed.filter(broken & F.col(column).isNotNull()).drop("o")


def read_observations(spark: SparkSession, path: str, day: str | None = None, until: str | None = None, msm_ids: list[int] | None = None) -> DataFrame:
    """Stored observations of days in [day, until); both filters prune partitions."""
    rows = spark.read.schema(S.OBSERVATION_SCHEMA).parquet(path)
    if day is not None:
        rows = rows.filter(F.col("day") >= F.lit(day).cast("date"))
    if until is not None:
        rows = rows.filter(F.col("day") < F.lit(until).cast("date"))
    return rows if msm_ids is None else rows.filter(F.col("msm_id").isin(*msm_ids))


def prefixes(table: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(IPv4, IPv6) prefixes: network, masklen, asn[, nth] from text rows prefix, masklen, asn.

    The first of several origins counts. IPv6 prefixes of mapped addresses belong to IPv4.
    ``order``: a column with the rows' order, which becomes ``nth``; of equal prefixes the last counts.
    """
    asn = F.regexp_extract("asn", r"^\s*(\d+)", 1).try_cast("int")
    nth = [F.col(order).alias("nth")] if order else []
    own = ["masklen", "asn", *(["nth"] if order else [])]
    rows = table.select(F.trim("prefix").alias("prefix"), "masklen", asn.alias("asn"), *nth).filter("asn is not null")
    four = rows.filter(~F.col("prefix").contains(":")).select(v4_number(v4_bytes(F.col("prefix"))).alias("network"), *own)
    six = rows.filter(F.col("prefix").contains(":")).select(address_bytes(F.col("prefix")).alias("network"), *own)
    is_mapped = (F.hex(F.substring("network", 1, 12)) == "00000000000000000000FFFF") & (F.col("masklen") >= 96)
    inner = six.filter(is_mapped).withColumns({"network": v4_number(F.substring("network", 13, 4)), "masklen": F.col("masklen") - 96})
    return four.unionByName(inner).filter("network is not null"), six.filter(~is_mapped & F.col("network").isNotNull())


def read_prefixes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tables of one file, with the order of its lines."""
    rows = spark.read.schema(S.PREFIX_SCHEMA).option("sep", "\t").csv(path)
    return prefixes(rows.withColumn("line", F.monotonically_increasing_id()), "line")  # parts of a file are numbered in its order


def newest_prefix_file(log: DataFrame, column: str = "value") -> DataFrame:
    """One row, ``file``: the last word of the last line of a creation log (lines that begin with '#' and empty ones apart).

    ``log``: text lines in the order of ``nth`` (without it, of the file).
    """
    lines = log if "nth" in log.columns else log.withColumn("nth", F.monotonically_increasing_id())
    used = lines.filter((F.trim(column) != "") & ~F.col(column).startswith("#"))
    return used.agg(F.max_by(column, "nth").alias("line")).select(F.element_at(F.split(F.trim("line"), r"\s+"), -1).alias("file"))


def probes(table: DataFrame) -> DataFrame:
    """prb_id, asn_v4, asn_v6 (-1 unknown), latitude, longitude, country_code, without rows that know nothing; 0 and '' are unknown."""
    some = lambda c: F.when(F.col(c).cast("string").isin("", "0", "0.0", "-0.0"), None).otherwise(F.col(c))
    table = table.select("id", *[some(c).alias(c) for c in ("asn_v4", "asn_v6", "latitude", "longitude", "country_code")])
    known = F.coalesce(*[F.col(c).cast("string") for c in table.columns[1:]])
    return table.filter(known.isNotNull()).select(
        F.col("id").alias("prb_id"), F.coalesce("asn_v4", F.lit(-1)).alias("asn_v4"), F.coalesce("asn_v6", F.lit(-1)).alias("asn_v6"), "latitude", "longitude", "country_code"
    )


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Probes of an archive as published (one JSON document with ``objects``, packed or not); raises if it holds none."""
    archive = spark.read.schema(f"objects array<struct<{', '.join(x.replace(' ', ': ', 1) for x in S.PROBE_SCHEMA.split(', '))}>>").option("multiLine", True).json(path)
    out = probes(archive.select(F.explode("objects").alias("o")).select("o.*"))
    if out.isEmpty():
        raise ValueError(f"no probes in {path}")
    return out


def asn_names(pages: DataFrame, column: str) -> DataFrame:
    """asn, handle, name from pages whose ``<pre>`` holds lines 'AS1 HANDLE - Name' parted by ``<br />``."""
    line = F.explode(F.split(F.regexp_extract(column, r"(?s)<pre>(.*?)</pre>", 1), r"<br\s*/?>"))
    parts = pages.select(line.alias("raw")).select(F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("line"))
    pattern = r"^(AS\d+) (\S+)(?: (?:- )?(.*))?$"
    return parts.filter(F.col("line").rlike(pattern)).select(
        F.regexp_extract("line", pattern, 1).alias("asn"), F.regexp_extract("line", pattern, 2).alias("handle"), F.regexp_extract("line", pattern, 3).alias("name")
    )


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """dt, prb_id, resolver, hijacked (the addresses that are there) of timeline CSV files."""
    rows = spark.read.option("header", True).option("nullValue", "NULL").csv(path)
    slots = [F.col(f"`hijacked #{k}`") for k in range(4)]
    return rows.select(F.to_timestamp("datetime").alias("dt"), F.col("`probe ID`").cast("long").alias("prb_id"), F.col("`probe resolver`").alias("resolver"), F.array_compact(F.array(*slots)).alias("hijacked"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The stored wide report (sinks.write_report_csv) of whole numbers, the time as text and labels as they are."""
    rows = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    text = lambda c: c == "datetime" or c.endswith(" ASNs") or c in ("selection", "item", "dim", "kind")
    return rows.select(*[F.col(f"`{c}`") if text(c) else F.col(f"`{c}`").cast("date" if c == "day" else "long").alias(c) for c in rows.columns])


def tagged(column: str, tag: str) -> tuple[Column, Column]:
    """(text between the first pair of a tag, number of the tag's openings) of a column of pages."""
    return F.regexp_extract(column, f"(?s)<{tag}>(.*?)</{tag}>", 1), F.size(F.split(column, f"<{tag}>")) - 1
