"""Longest-prefix matches and range lookups, and the flattening of nested prefixes into disjoint ranges.

A direct range join would compare every address with every range. Instead each distinct
address is expanded to its network at each prefix length that the table has (at most 33
or 129), which makes an equi-join with the broadcast table; the longest match wins. A table
that is too large for that is sorted with the addresses in blocks of the address space.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.addresses import after_v6, given, is_mapped, mapped, network_v6, number_v4, prefix_end, v4_number

#: A prefix table up to this size, at a row's bytes in a hashed relation, is broadcast (two million rows: the whole routing table); beyond it the join shuffles.
BROADCAST_BYTES, ROW_BYTES = 128 << 20, 64


def _hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows * ROW_BYTES <= BROADCAST_BYTES else df


def network(number: Column, masklen: Column, width: int = 32) -> Column:
    """The network number of an address at a prefix length."""
    step = F.pow(F.lit(2.0), F.lit(width) - masklen).cast("long")
    return number - F.pmod(number, step)


def unique_prefixes(prefixes: DataFrame, order: str | None = None) -> DataFrame:
    """(network, masklen, asn): of equal prefixes the last one in ``order`` (without it, the greatest ASN) counts."""
    pick = F.max_by("asn", order) if order else F.max("asn")
    return prefixes.groupBy("network", "masklen").agg(pick.alias("asn"))


def _by_length(distinct: DataFrame, table: DataFrame, ip: str, lengths: list[int], rows: int, network_of: Callable) -> DataFrame:
    """ip, asn (null if none): each address is expanded to its networks at ``lengths``, and the longest that is there wins."""
    options = distinct.select(ip, F.explode(F.array(*map(F.lit, lengths))).alias("masklen")).withColumn("network", network_of(F.col(ip), F.col("masklen")))
    found = options.join(_hint(table, rows), ["masklen", "network"], "left")
    return found.groupBy(ip).agg(F.max_by("asn", F.when(F.col("asn").isNotNull(), F.col("masklen"))).alias("asn"))


def _by_order(distinct: DataFrame, table: DataFrame, ip: str, lengths: list[int], block_of: Callable, end_of: Callable) -> DataFrame:
    """ip, asn (null if none): addresses and prefixes sorted together, block by block.

    Prefixes of one length are disjoint, so the last that begins up to an address is the
    only one of its length that may hold it. No prefix is longer than its block, so none
    is copied, and nothing is expanded. IPv4 blocks (/16) have 65,536 addresses at most.
    """
    starts = table.select(F.col("network").alias("at"), F.lit(0).alias("kind"), "masklen", F.struct(end_of(F.col("network"), F.col("masklen")).alias("till"), "asn").alias("held"))
    both = distinct.select(F.col(ip).alias("at"), F.lit(1).alias("kind")).unionByName(starts, allowMissingColumns=True).withColumn("block", block_of(F.col("at")))
    order = Window.partitionBy("block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    open_at = both.withColumns({f"held_{n}": F.last(F.when(F.col("masklen") == n, F.col("held")), ignorenulls=True).over(order) for n in lengths}).filter("kind = 1")
    holds = lambda n: F.col(f"held_{n}").isNotNull() & (F.col(f"held_{n}.till").isNull() | (F.col(f"held_{n}.till") > F.col("at")))
    return open_at.select(F.col("at").alias(ip), F.coalesce(*[F.when(holds(n), F.col(f"held_{n}.asn")) for n in sorted(lengths, reverse=True)]).alias("asn"))


def _lpm(addresses: DataFrame, prefixes: DataFrame, ip: str, order: str | None, network_of: Callable, block_of: Callable, block_bits: int, end_of: Callable) -> DataFrame:
    """A table that may be broadcast is joined by length; of a larger one only the prefixes shorter than a block are, which are few, and the rest by order."""
    table = unique_prefixes(prefixes, order)
    shapes = {r.masklen: r["count"] for r in table.groupBy("masklen").count().collect()}  # at most 33 or 129 rows
    distinct = addresses.select(ip).distinct()
    if not shapes:
        return distinct.withColumn("asn", F.lit(0))
    small = sum(shapes.values()) * ROW_BYTES <= BROADCAST_BYTES
    long = [] if small else sorted(n for n in shapes if n >= block_bits)
    short = sorted(set(shapes) - set(long))
    parts = []
    if long:
        parts.append(_by_order(distinct, table.filter(F.col("masklen") >= block_bits), ip, long, block_of, end_of).withColumn("rank", F.lit(1)))
    if short:
        rows = sum(shapes[n] for n in short)
        parts.append(_by_length(distinct, table.filter(F.col("masklen").isin(short)) if long else table, ip, short, rows, network_of).withColumn("rank", F.lit(0)))
    best = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy(ip).agg(F.max_by("asn", F.when(F.col("asn").isNotNull(), F.col("rank"))).alias("asn"))
    return best.select(ip, F.coalesce("asn", F.lit(0)).alias("asn"))


def lpm_v4(addresses: DataFrame, prefixes: DataFrame, ip: str = "ip", order: str | None = None) -> DataFrame:
    """Distinct IPv4 numbers ``ip`` with their ASN by the longest matching prefix; 0 if none. Prefixes: network, masklen, asn."""
    return _lpm(addresses, prefixes, ip, order, network, lambda at: F.shiftright(at, 16), 16, prefix_end)


def lpm_v6(addresses: DataFrame, prefixes: DataFrame, ip: str = "ip", order: str | None = None) -> DataFrame:
    """The same over 16-byte addresses, in blocks of /32."""
    return _lpm(addresses, prefixes, ip, order, network_v6, lambda at: F.substring(at, 1, 4), 32, after_v6)


def crossing(prefixes: DataFrame) -> DataFrame:
    """The IPv4 prefixes that begin within an earlier range and end after it, with ``crossed``, the end they pass: these do not nest.

    Prefixes are taken as they are given, also where their network has bits beyond the
    length. By start (the longer range first), the running maximum of the ends shows the
    range that is still open. An address space block of /8 has all ranges that touch it, so
    a row is judged in the block where it begins and tasks take blocks apart.
    """
    size = 1 << 24
    till = prefix_end(F.col("network"), F.col("masklen"))
    rows = prefixes.withColumn("range_end", till)
    blocks = F.sequence(F.floor(F.col("network") / size), F.floor((F.col("range_end") - 1) / size))
    each = rows.withColumn("own_block", F.floor(F.col("network") / size)).withColumn("in_block", F.explode(blocks))
    earlier = Window.partitionBy("in_block").orderBy("network", F.desc("range_end")).rowsBetween(Window.unboundedPreceding, -1)
    open_end = each.withColumn("crossed", F.max("range_end").over(earlier)).filter("in_block = own_block")
    return open_end.filter((F.col("crossed") > F.col("network")) & (F.col("range_end") > F.col("crossed"))).select(*prefixes.columns, "crossed")


def nested(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes that nest or are disjoint, those that cross another): only the former may be flattened."""
    bad = crossing(prefixes)
    return prefixes.join(bad.select("network", "masklen").distinct(), ["network", "masklen"], "left_anti"), bad


def flatten_v4(prefixes: DataFrame, order: str | None = None) -> DataFrame:
    """Disjoint half-open ranges (from, till, asn) with the longest prefix's ASN; neighbours of one ASN are one range.

    Every prefix's two ends cut the number line; the ASN of each piece is the longest
    match of its first number, by the same equi-join. Prefixes nest or are disjoint, so
    pieces without a match are gaps and are left out. The line is cut at /8 borders into
    windows that tasks handle apart; ranges that meet at a border are joined at the end.
    """
    table = unique_prefixes(prefixes, order)
    ends = table.select("network", prefix_end(F.col("network"), F.col("masklen")).alias("till"))
    borders = prefixes.sparkSession.range(0, (1 << 32) + 1, 1 << 24).select(F.col("id").alias("at"))
    cuts = ends.select(F.explode(F.array("network", "till")).alias("at")).union(borders).distinct()
    block = (F.col("at") / (1 << 24)).cast("long")
    pieces = cuts.withColumn("block", block).withColumn("till", F.lead("at").over(Window.partitionBy("block").orderBy("at"))).withColumn("till", F.coalesce("till", (F.col("block") + 1) * (1 << 24)))
    pieces = pieces.filter(F.col("at") < (1 << 32)).select(F.col("at").alias("from"), "till", "block")
    found = pieces.join(lpm_v4(pieces.select(F.col("from").alias("ip")), prefixes, "ip", order), F.col("from") == F.col("ip")).drop("ip").filter("asn <> 0")
    merged = merge_ranges(found, ["block"]).drop("block")
    # At most two ranges of a window touch its borders, so few rows are left for one task.
    touches = (F.col("from") % (1 << 24) == 0) | (F.col("till") % (1 << 24) == 0)
    return merged.filter(~touches).unionByName(merge_ranges(merged.filter(touches), []))


def flatten_v6(prefixes: DataFrame, order: str | None = None) -> DataFrame:
    """The same for 16-byte networks: ``till`` is the first address after a range, null at the end of the address space.

    The space is cut at /16 borders into windows.
    """
    table = unique_prefixes(prefixes, order)
    ends = table.select("network", after_v6(F.col("network"), F.col("masklen")).alias("till"))
    rest = F.unhex(F.lit("00" * 14))
    borders = prefixes.sparkSession.range(0, 1 << 16).select(F.concat(F.unhex(F.lpad(F.hex("id"), 4, "0")), rest).alias("at"))
    cuts = ends.select(F.explode(F.array_compact(F.array("network", "till"))).alias("at")).union(borders).distinct().withColumn("block", F.substring("at", 1, 2))
    border = after_v6(F.concat("block", rest), F.lit(16))
    pieces = cuts.withColumn("till", F.coalesce(F.lead("at").over(Window.partitionBy("block").orderBy("at")), border)).select(F.col("at").alias("from"), "till", "block")
    found = pieces.join(lpm_v6(pieces.select(F.col("from").alias("ip")), prefixes, "ip", order), F.col("from") == F.col("ip")).drop("ip").filter("asn <> 0")
    merged = merge_ranges(found, ["block"])
    # At most two ranges of a window touch its borders, so few rows are left for one task.
    touches = (F.col("from") == F.concat("block", rest)) | F.col("till").eqNullSafe(border)
    return merged.filter(~touches).drop("block").unionByName(merge_ranges(merged.filter(touches).drop("block"), []))


def merge_ranges(ranges: DataFrame, within: list[str]) -> DataFrame:
    """Ranges that meet and have one ASN become one, within groups (none: over all; use it on few rows)."""
    order = Window.partitionBy(*within).orderBy("from") if within else Window.orderBy("from")
    starts = F.when((F.lag("till").over(order) == F.col("from")) & (F.lag("asn").over(order) == F.col("asn")), 0).otherwise(1)
    return (
        ranges.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order))
        .groupBy(*within, "island", "asn").agg(F.min("from").alias("from"), F.max_by("till", "from").alias("till")).select(*within, "from", "till", "asn")
    )


def range_lookup(addresses: DataFrame, ranges: DataFrame, ip: str = "ip", block_bits: int = 16) -> DataFrame:
    """Distinct numbers with the ASN of the half-open range that holds them, 0 if none.

    Ranges are cut at block borders, so that the join is on the block and a range meets
    only addresses of its own blocks.
    """
    size = 1 << block_bits
    cut = ranges.withColumn("block", F.explode(F.sequence((F.col("from") / size).cast("long"), ((F.col("till") - 1) / size).cast("long"))))
    own = addresses.select(ip).distinct().withColumn("block", (F.col(ip) / size).cast("long"))
    hit = own.join(cut, "block").filter((F.col("from") <= F.col(ip)) & (F.col(ip) < F.col("till"))).select(ip, F.col("asn").alias("hit"))
    return own.select(ip).join(hit, ip, "left").select(ip, F.coalesce("hit", F.lit(0)).alias("asn"))


#: Columns of an enriched snapshot that come from addresses, and what they are without one.
SLOTS = {"auth_g": -1, "auth_a": -1, "auth_6": -1, "res": 0, "nxhj": -1}


def enrich(snapshot: DataFrame, probes: DataFrame, prefixes4: DataFrame, prefixes6: DataFrame) -> DataFrame:
    """A snapshot with auth_g, auth_a, auth_6, prb_4, prb_6, res and nxhj: -1 without an address (or one of zeros), 0 if not routed.

    The addresses that are there become rows (entity, slot, ip), so nothing is joined on
    missing ones. Distinct addresses are looked up once; what is found is gathered by entity
    and joined to the snapshot in one go, so its wide rows move once. Prefix tables with a
    column ``nth`` count the last of equal prefixes.
    """
    key = ["prb_id", "addr"]
    wide = lambda c: F.when(F.length(given(c)) == 4, mapped(given(c))).otherwise(given(c))
    first = F.try_element_at(F.col("hijacked"), F.lit(1))
    ips = {"auth_g": wide(F.col("whoami_g")), "auth_a": wide(F.col("whoami_a")), "auth_6": given(F.col("whoami_6")), "res": F.col("addr"), "nxhj": wide(first)}
    slots = F.array(*[F.struct(F.lit(n).alias("slot"), c.alias("ip")) for n, c in ips.items()])
    each = snapshot.select(*key, F.explode(F.filter(slots, lambda s: F.length(s.ip) == 16)).alias("s")).select(*key, "s.slot", "s.ip")
    of = lambda df: "nth" if "nth" in df.columns else None
    distinct = each.select("ip").distinct()
    four = distinct.filter(is_mapped(F.col("ip"))).select(v4_number(F.substring("ip", 13, 4)).alias("n"))
    by4 = lpm_v4(four, prefixes4, "n", of(prefixes4)).select(mapped(number_v4(F.col("n"))).alias("ip"), "asn")
    by6 = lpm_v6(distinct.filter(~is_mapped(F.col("ip"))), prefixes6, "ip", of(prefixes6))
    named = each.join(by4.unionByName(by6), "ip")  # an address of very many entities is split by adaptive execution
    gathered = named.groupBy(*key).agg(*[F.max(F.when(F.col("slot") == n, F.col("asn"))).alias(n) for n in SLOTS])
    dim = probes.select(F.col("prb_id"), F.col("asn_v4").alias("prb_4"), F.col("asn_v6").alias("prb_6"))
    rows = snapshot.join(gathered, key, "left").join(dim, "prb_id", "left")
    return rows.select(*snapshot.columns, *[F.coalesce(n, F.lit(other)).alias(n) for n, other in SLOTS.items()], *[F.coalesce(n, F.lit(-1)).alias(n) for n in ("prb_4", "prb_6")])


def lookup_address(spark, prefixes4: DataFrame, prefixes6: DataFrame, text: str) -> int:
    """ASN of one address; of equal prefixes the last counts if the tables have their order (``nth``)."""
    ip = ipaddress.ip_address(text)
    four = ip if ip.version == 4 else ip.ipv4_mapped
    of = lambda df: "nth" if "nth" in df.columns else None
    if four is not None:
        return lpm_v4(spark.createDataFrame([(int(four),)], "ip long"), prefixes4, order=of(prefixes4)).first().asn
    return lpm_v6(spark.createDataFrame([(ip.packed,)], "ip binary"), prefixes6, order=of(prefixes6)).first().asn
