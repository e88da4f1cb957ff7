"""The cube of capability selections: counts for every conjunction of up to ``depth`` capability values.

Each row is exploded into the selections that it meets (the root, its values, its pairs
of values in capability order), so one aggregation makes the whole cube. Grouping sets
over all pairs of columns would be an order slower and overflow generated methods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key of the root selection.
ROOT = ""


def held_values(values: dict[str, Column], names: dict[str, list[str]]) -> Column:
    """Array of the reported values that a row has, in capability order."""
    return F.array_compact(F.array(*[F.when(values[key] == k, F.lit(name)) for key, own in names.items() for k, name in enumerate(own, 1)]))


def selections(held: Column, depth: int) -> Column:
    """Array of selection paths that a row with these values meets: '', 'a', and 'a/b' for a before b."""
    if not 0 <= depth <= 2:
        raise ValueError("depth is 0, 1 or 2")
    out = F.array(F.lit(ROOT))
    if depth >= 1:
        out = F.concat(out, held)
    if depth == 2:
        pairs = F.flatten(F.transform(held, lambda a, i: F.transform(F.slice(held, i + 2, F.greatest(F.size(held), F.lit(1))), lambda b: F.concat_ws("/", a, b))))
        out = F.concat(out, pairs)
    return out


def cube(rows: DataFrame, held: Column, probe: str, depth: int, updated: str | None = None, extra: list[str] | None = None) -> DataFrame:
    """selection, n_resolvers, n_probes[, updated], for each group of ``extra`` columns.

    Distinct probes are counted by a first aggregation to (selection, probe), which also
    combines rows before the second shuffle.
    """
    extra = extra or []
    slim = rows.select(*extra, F.col(probe).alias("probe"), *([F.col(updated).alias("updated")] if updated else []), F.explode(selections(held, depth)).alias("selection"))
    latest = [F.max("updated").alias("updated")] if updated else []
    per_probe = slim.groupBy(*extra, "selection", "probe").agg(F.count("*").alias("n"), *latest)
    return per_probe.groupBy(*extra, "selection").agg(F.sum("n").alias("n_resolvers"), F.count("probe").alias("n_probes"), *latest)


def probe_bitmaps(rows: DataFrame, held: Column, probe: str, depth: int, extra: list[str] | None = None) -> DataFrame:
    """selection, bucket, probes (a bitmap), n_resolvers, for each group of ``extra`` columns: counters that add up exactly.

    Sums and distinct counts of any union of groups, such as the days of a month, come from
    their stored rows by ``merged``, without the rows they were made of. A bucket has 32,768
    probe numbers, so a selection has few, of 4 KB each.
    """
    extra = extra or []
    slim = rows.select(*extra, F.col(probe).cast("long").alias("probe"), F.explode(selections(held, depth)).alias("selection"))
    return slim.groupBy(*extra, "selection", F.bitmap_bucket_number("probe").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("probe")).alias("probes"), F.count("*").alias("n_resolvers"))


def merged(bitmaps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """selection, n_resolvers, n_probes (distinct), over all rows of ``probe_bitmaps`` or for each group of ``by``."""
    by = [*(by or []), "selection"]
    buckets = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("probes")).alias("n_probes"), F.sum("n_resolvers").alias("n_resolvers"))
    return buckets.groupBy(*by).agg(F.sum("n_resolvers").alias("n_resolvers"), F.sum("n_probes").alias("n_probes"))


def value_counts(rows: DataFrame, held: Column, probe: str, depth: int, extra: list[str] | None = None, flags: DataFrame | None = None) -> DataFrame:
    """selection, value, n (rows of the selection with the value), n_prbs, for each group of ``extra`` columns.

    ``n_prbs`` counts the distinct probes of the selection that have the value at any of
    their rows, inside the selection or not. ``flags``: probe_flags() of a larger table, where
    ``rows`` are a part of it.
    """
    extra = extra or []
    rows = rows.withColumn("held", held)
    members = rows.select(*extra, F.col(probe).alias("probe"), "held", F.explode(selections(F.col("held"), depth)).alias("selection"))
    counts = members.withColumn("value", F.explode("held")).groupBy(*extra, "selection", "value").agg(F.count("*").alias("n"))
    flags = rows.select(F.col(probe).alias("probe"), F.explode("held").alias("value")).distinct() if flags is None else flags.select("probe", "value")
    in_selection = members.select(*extra, "selection", "probe").distinct()
    probes = in_selection.join(flags, "probe").groupBy(*extra, "selection", "value").agg(F.count("*").alias("n_prbs"))
    return counts.join(probes, [*extra, "selection", "value"], "full").fillna(0, ["n", "n_prbs"])


def probe_flags(rows: DataFrame, held: Column, probe: str) -> DataFrame:
    """A row for each probe and value that any of its rows has: the binarised per-probe counters."""
    return rows.select(F.col(probe).alias("probe"), F.explode(held).alias("value")).groupBy("probe", "value").agg(F.count("*").alias("n_resolvers"))


def histogram(rows: DataFrame, value: Column, held: Column, depth: int, keep: Column | None = None, extra: list[str] | None = None) -> DataFrame:
    """selection, value, n: how often each value of a dimension occurs in each selection, for each group of ``extra`` columns."""
    extra = extra or []
    slim = rows.select(*extra, value.alias("value"), F.explode(selections(held, depth)).alias("selection"), *([keep.alias("keep")] if keep is not None else []))
    if keep is not None:
        slim = slim.filter("keep").drop("keep")
    return slim.groupBy(*extra, "selection", "value").agg(F.count("*").alias("n"))


def histograms(rows: DataFrame, values: dict[str, tuple[Column, Column | None]], held: Column, depth: int, extra: list[str] | None = None) -> DataFrame:
    """family, selection, value, n: the histograms of several dimensions, (value, whether it counts) by family, from one pass.

    A row becomes its selections once and these the row's few values, so a further dimension adds no scan.
    """
    extra = extra or []
    cells = F.array(*[F.when(F.lit(True) if keep is None else keep, F.struct(F.lit(name).alias("family"), value.cast("long").alias("value"))) for name, (value, keep) in values.items()])
    slim = rows.select(*extra, F.array_compact(cells).alias("cells"), F.explode(selections(held, depth)).alias("selection"))
    return slim.select(*extra, "selection", F.explode("cells").alias("c")).groupBy(*extra, "selection", "c.family", "c.value").agg(F.count("*").alias("n"))


def members(rows: DataFrame, held: Column, probe: str, address: Column, depth: int) -> DataFrame:
    """selection, probe, address: the members of each selection, one row each.

    They stay rows, to be written partitioned by selection; a list of all members of the
    root would be as large as the table.
    """
    return rows.select(F.explode(selections(held, depth)).alias("selection"), F.col(probe).alias("probe"), address.alias("address"))
