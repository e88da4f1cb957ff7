"""Ranks: bands of equal counts, top-N with the remainder, and semi-joins with the top N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS, LONG_BAND, TOP_MASKS, TOP_ASNS = 100, 20, 10, 100


def bands(counts: DataFrame, by: list[str], item: str = "asn", n: str = "n", most: int = BANDS, few_groups: bool = False) -> DataFrame:
    """by, band, count, items, total, label: items with equal counts share a band, the largest first.

    The label lists up to 20 items ('AS1,AS2'), more as 'in 21 ASNs (count)'. What lies
    beyond ``most`` bands is one row with band null, label 'Remaining' and its total.
    Ranks are over bands, which are far fewer than items; the items are first combined by count.
    ``few_groups``: the caller knows that ``by`` has some thousands of values at most, so the
    list of short bands (``most`` for each) is broadcast and the many items of long bands, most
    of them with a count of 1, are dropped where they are.
    """
    grouped = counts.groupBy(*by, n).agg(F.count("*").alias("items"))
    order = Window.partitionBy(*by).orderBy(F.desc(n)) if by else Window.orderBy(F.desc(n))
    ranked = grouped.withColumn("band", F.row_number().over(order))
    short = ranked.filter((F.col("band") <= most) & (F.col("items") <= LONG_BAND))
    wanted = short.select(*by, n)
    listed = counts.join(F.broadcast(wanted) if few_groups else wanted, [*by, n]).groupBy(*by, n).agg(F.array_sort(F.collect_list(item)).alias("names"))  # at most LONG_BAND names
    ranked = ranked.join(listed, [*by, n], "left")
    named = F.array_join(F.transform("names", lambda x: F.concat(F.lit("AS"), x)), ",")
    label = F.when(F.col("names").isNotNull(), named).otherwise(F.concat(F.lit("in "), F.col("items"), F.lit(" ASNs ("), F.col(n), F.lit(")")))
    top = ranked.filter(F.col("band") <= most).select(*by, "band", F.col(n).alias("count"), "items", (F.col(n) * F.col("items")).alias("total"), label.alias("label"))
    rest = ranked.filter(F.col("band") > most).groupBy(*by).agg(F.sum("items").alias("items"), F.sum(F.col(n) * F.col("items")).alias("total"))
    return top.unionByName(rest.select(*by, F.lit(None).cast("int").alias("band"), F.lit(None).cast("long").alias("count"), "items", "total", F.lit("Remaining").alias("label")))


def top_n(counts: DataFrame, by: list[str], item: str, n: str, most: int) -> DataFrame:
    """by, rank, item (as text), n: the ``most`` greatest, ties to the smaller item, and a row 'Remaining' with the rest."""
    if by:
        ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(n), item)))
        top = ranked.filter(F.col("rank") <= most)
        rest = ranked.filter(F.col("rank") > most).groupBy(*by).agg(F.sum(n).alias(n))
    else:
        top = ranked_top(counts, item, n, most)
        named = top.agg(F.coalesce(F.sum(n), F.lit(0)).alias("named"), F.count("*").alias("k"))
        whole = counts.agg(F.sum(n).alias("all"), F.count("*").alias("items"))
        rest = whole.crossJoin(F.broadcast(named)).filter(F.col("items") > F.col("k")).select((F.col("all") - F.col("named")).alias(n))  # one row each
    return top.select(*by, "rank", F.col(item).cast("string").alias(item), n).unionByName(rest.select(*by, F.lit(None).cast("int").alias("rank"), F.lit("Remaining").alias(item), n))


def ranked_top(counts: DataFrame, item: str, n: str, most: int) -> DataFrame:
    """The ``most`` greatest of the whole table with their ranks."""
    return global_top(counts, item, n, most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(n), item)))


def global_top(counts: DataFrame, item: str, n: str, most: int) -> DataFrame:
    """The ``most`` greatest over the whole table: a bounded heap in each task, no sort of all rows."""
    return counts.orderBy(F.desc(n), item).limit(most)


def top_semi_join(rows: DataFrame, candidates: Column, top: DataFrame, item: str, within: int | None = None) -> DataFrame:
    """Rows with each item of the bounded table ``top`` (item, rank) that is among their ``candidates``.

    ``within``: a row counts only for as many items, by rank, as it has different candidates
    other than ``within`` (a value that does not add to the number).
    """
    row = rows.withColumn("candidates", F.array_distinct(F.array_compact(candidates)))
    if within is None:
        return row.withColumn(item, F.explode("candidates")).drop("candidates").join(F.broadcast(top), item)
    # The bounded list of top items goes into every row as a literal, in rank order.
    listed = F.array(*[F.struct(F.lit(r["rank"]).alias("rank"), F.lit(r[item]).alias(item)) for r in sorted(top.select("rank", item).collect(), key=lambda r: r["rank"])])
    different = F.size(F.filter("candidates", lambda x: x != within))
    matched = F.slice(F.filter(listed, lambda t: F.array_contains(F.col("candidates"), t[item])), 1, F.greatest(different, F.lit(1)))
    return row.filter(different > 0).withColumn("m", F.explode(matched)).withColumns({item: F.col(f"m.{item}"), "rank": F.col("m.rank")}).drop("m", "candidates")
