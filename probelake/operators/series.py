"""Series for presentation: trimmed, with unknowns and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.schema import CAPABILITIES

def _properties() -> list[tuple[str, str, list[str]]]:
    """The 26 properties that are shown, in order: (name, kind, what makes it up)."""
    values = dict(CAPABILITIES)
    value = lambda key: (key, "values", values[key])
    algorithms = [key for key, names in CAPABILITIES if len(names) == 3 and key != "int_ext"]
    dnskeys, digests = algorithms[:-2][::-1], algorithms[-2:]
    return [
        value("int_ext"), *[(f"top_{d}", "bands", [d]) for d in ("auth", "resolver", "probe")], value("qnamemin"), value("flagday"), ("top_ecs_masks", "masks", ["ECS mask", "ECS mask6"]), ("top_nxhj", "bands", ["nxhj"]),
        ("trust_anchors", "values", [*values["ta_19036"], *values["ta_20326"]]), *map(value, dnskeys), *map(value, digests), *map(value, ("ipv6", "tcp", "tcp6")),
    ]


PROPERTIES = _properties()


def property_series(prop: tuple[str, str, list[str]], base: DataFrame, values: DataFrame, masks: DataFrame, bands: DataFrame) -> DataFrame:
    """Daily series of one property over the whole network: day, label, n, share (of the resolvers, in percent); without leading zeros.

    The tables are those of the report; rows of their root selection count. ``unknown`` is
    what the values of a property leave of all resolvers; trust anchors overlap and leave none.
    """
    name, kind, parts = prop
    root = lambda df: df.filter("selection = ''")
    totals = root(base).select("day", F.col("n_resolvers").alias("total"))
    if kind == "bands":
        rows = top_of_series(root(bands).filter(F.col("dim") == parts[0]), "day", "label", "total").select("day", F.col("asn").alias("label"), "n")
    elif kind == "masks":
        own = root(masks).filter(F.col("family").isin(parts))
        known = own.filter("rank is not null").select("day", F.col("mask").cast("int").alias("mask"), "n").groupBy("day", "mask").agg(F.sum("n").alias("n"))
        rest = own.filter("rank is null").select("day", F.lit("Remaining").alias("label"), "n")
        rows = top_masks(known, "day", "mask", "n").unionByName(rest).groupBy("day", "label").agg(F.sum("n").alias("n"))
    else:
        rows = root(values).filter(F.col("value").isin(parts)).select("day", F.col("value").alias("label"), "n")
        if name != "trust_anchors":
            left = totals.join(rows.groupBy("day").agg(F.sum("n").alias("known")), "day", "left")
            rows = rows.unionByName(left.select("day", F.lit("unknown").alias("label"), (F.col("total") - F.coalesce("known", F.lit(0))).alias("n")))
    return trim(rows, ["label"], "day", "n").join(totals, "day").select("day", "label", "n", F.round(share(F.col("n"), F.col("total")), 6).alias("share"))


def trim(series: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """Each property from its first day with a value other than zero; all-zero ones vanish."""
    first = F.min(F.when(F.col(value) != 0, F.col(day)))
    start = series.groupBy(*by).agg(first.alias("start"))
    return series.join(start, by).filter(F.col(day) >= F.col("start")).drop("start")


def with_unknown(series: DataFrame, by: list[str], total: str, value: str) -> DataFrame:
    """by, total, known, unknown: what the property's values leave of the total."""
    return series.groupBy(*by, total).agg(F.sum(value).alias("known")).withColumn("unknown", F.col(total) - F.col("known"))


def share(value, total):
    return F.when(total != 0, value * F.lit(100.0) / total)


def latest_share(series: DataFrame, by: list[str], day: str, value: str, total: str) -> DataFrame:
    """Percent shares on each property's last day."""
    last = series.groupBy(*by).agg(F.max(day).alias(day))
    return series.join(last, [*by, day]).withColumn("share", share(F.col(value), F.col(total)))


def top_of_series(bands: DataFrame, day: str, label: str, total: str, most: int = 9) -> DataFrame:
    """Daily series of the ``most`` greatest ASNs over all days, and 'Remaining'.

    A band's total is shared evenly (in whole numbers) among the ASNs of its label; 'AS-1'
    and bands that name no ASNs count as remaining. Ties go to the greater label.
    """
    named = bands.withColumn("asns", F.when(F.col(label).startswith("AS"), F.split(label, ",")))
    each = named.filter("asns is not null").select(day, F.explode("asns").alias("asn"), F.floor(F.col(total) / F.size("asns")).alias("n"))
    best = each.filter("asn <> 'AS-1'").groupBy("asn").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), F.desc("asn")).limit(most).select("asn")
    top = each.join(F.broadcast(best), "asn").groupBy(day, "asn").agg(F.sum("n").alias("n"))
    sums = bands.groupBy(day).agg(F.sum(total).alias("all")).join(top.groupBy(day).agg(F.sum("n").alias("named")), day, "left")
    return top.unionByName(sums.select(day, F.lit("Remaining").alias("asn"), (F.col("all") - F.coalesce("named", F.lit(0))).alias("n")))


def top_masks(masks: DataFrame, day: str, mask: str, n: str, most: int = 15) -> DataFrame:
    """Daily series of the ``most`` ECS masks (IPv4 and IPv6 together) with the greatest sums, and 'Remaining'."""
    used = masks.filter((F.col(mask) > 0) & (F.col(n) > 0))
    best = used.groupBy(mask).agg(F.sum(n).alias("all")).orderBy(F.desc("all"), mask).limit(most).select(mask, F.lit(True).alias("best"))
    labelled = used.join(F.broadcast(best), mask, "left").withColumn("label", F.when(F.col("best"), F.concat(F.lit("/"), F.col(mask).cast("string"))).otherwise("Remaining"))
    return labelled.groupBy(day, "label").agg(F.sum(n).alias("n"))


def pivot_report(long: DataFrame, day: str, value: str, n: str, names: list[str]) -> DataFrame:
    """The wide report, one row for each day: a column for each of the named values."""
    wide = long.groupBy(day).pivot(value, names).agg(F.first(n))
    return wide.fillna(0, names)


def with_labels(rows: DataFrame, names: DataFrame, asn: str = "asn") -> DataFrame:
    """``label``: the ASN's long name, else the ASN itself. ``names``: asn, handle, name."""
    return rows.join(names.select(F.col("asn").alias(asn), "name"), asn, "left").withColumn("label", F.coalesce("name", asn)).drop("name")


def month_starts(days: DataFrame, day: str, more_than: int = 270) -> DataFrame:
    """Ticks: all days, or the firsts of months where there are more than ``more_than``."""
    counted = days.select(day).distinct().withColumn("n", F.count("*").over(Window.partitionBy()))
    return counted.filter((F.col("n") <= more_than) | (F.dayofmonth(day) == 1)).select(day)
