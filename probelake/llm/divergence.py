"""How far the sources of a language diverge: exact sums of absolute differences of smoothed term shares.

Documents are counted into (language, source, term) inside the tasks that read them. Terms
that many groups have are heavy: their counts become dense numpy tiles of groups by terms,
and a tile gives the differences of all its pairs. Terms that few groups have are light: a
pair's sum over them is a base that supposes both groups without any term, a correction
of each group alone against the other's share of an absent term, and a correction for each
term that both have, from the posting list of that term. All sums are whole numbers, so
the parts add up exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.llm.common import ROWS, stage

#: Documents of its language that a term must be in; what is added to each count; shares are parts of ``UNIT``.
LEAST_DOCS, PRIOR, UNIT = 30, 5, 1_000_000_000
#: A term in more groups than this is heavy; groups and (on average) terms of a tile; ranks of the terms.
LIGHT, TILE_GROUPS, TILE_TERMS, TOP_TERMS = 8, 128, 256, 50
#: Distinct terms that a worker counts before it passes the counts on; bytes of a text that are split at once.
HELD, PIECE = 200_000, 1 << 20

_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text: runs of letters A-Z, a-z and of all characters beyond ASCII, A-Z lower-cased; by pieces that end between terms."""
    data = text.encode().translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = [None, *(t.decode() for t in n)]  # the first row says that the group is there
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()), pa.array([0, *n.values()]), pa.array([0, *(d[t] for t in n)])], schema=schema)
        held.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS).to_pydict()
            for lang, source, text in zip(part["lang"], part["source"], part["text"], strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for found in _terms(text):
                    n.update(found)
                    seen.update(found)
                d.update(seen)
                size += len(n) - before
                if size > HELD:
                    yield from flush()
                    size = 0
    yield from flush()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, in_lang (occurrences in the language), spread (groups that have it), is_first: terms in at least ``least`` documents of the language; and a row with a null term for each group.

    Counts of a task are merged by (language, term), whose rows are at most groups times tasks.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    read = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    partial = read.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    # A group's marker is dealt by its source, so that all markers of a language are no hot key.
    dealt = partial.withColumn("deal", F.when(F.col("term").isNull(), F.xxhash64("source"))).repartition("lang", "term", "deal")
    counts = dealt.groupBy("lang", "term", "deal", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term", "deal")
    wide = counts.select(
        "lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("in_lang"), F.count("*").over(term).alias("spread"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("is_first"),
    )
    return wide.filter((F.col("docs") >= least) | F.col("term").isNull()).drop("docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), exact: the product may need more than 64 bits."""
    top = (count + PRIOR).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", top, (total + PRIOR * terms).cast("decimal(20,0)")) + 1


def _heavy_tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of absolute differences of the pairs of a tile: groups of block ``a`` with those of block ``b`` over its terms."""
    lang, a, b, _ = key
    term, terms = pd.factorize(rows["term"])
    one = {}
    for block in {a, b}:
        mine = (rows["block"] == block).to_numpy()
        # Every group of the block is there, with the share of an absent term where it lacks one.
        sid, own = np.unique(rows["sid"].to_numpy()[mine], return_inverse=True)
        base = np.zeros(len(sid), np.int64)
        base[own] = rows["p0"].to_numpy()[mine]
        tile = np.repeat(base[:, None], len(terms), axis=1)
        there = rows["p"].notna().to_numpy()[mine]
        tile[own[there], term[mine][there]] = rows["p"].to_numpy()[mine][there].astype(np.int64)
        one[block] = (sid, base, tile)
    (ids_a, base_a, x), (ids_b, base_b, y) = one[a], one[b]
    absent = int(rows["n_terms"].max()) - len(terms)  # terms that none of these groups has
    out = []
    for k, i in enumerate(ids_a):
        f = np.abs(y - x[k]).sum(axis=1) + absent * np.abs(base_b - base_a[k])
        keep = ids_b > i if a == b else slice(None)
        out.append(pd.DataFrame({"lang": lang, "a": i, "b": ids_b[keep], "f": f[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "f": []})


def _alone(key: tuple, own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """What a group's light terms add against each other group, as if that had none of them, less the base for these terms."""
    own = own.sort_values("p")
    p, m = own["p"].to_numpy(np.int64), own["m"].to_numpy(np.int64)
    count, total = np.concatenate([[0], np.cumsum(m)]), np.concatenate([[0], np.cumsum(p * m)])
    x, mine = others["p0_other"].to_numpy(np.int64), others["p0"].to_numpy(np.int64)
    below = np.searchsorted(p, x)
    f = x * count[below] - total[below] + (total[-1] - total[below]) - x * (count[-1] - count[below])
    f = f - count[-1] * np.abs(mine - x)
    return pd.DataFrame({"lang": key[0], "a": np.minimum(key[1], others["other"]), "b": np.maximum(key[1], others["other"]), "f": f})


_SUMS = "lang string, a int, b int, f bigint"


def pair_sums(postings: DataFrame, groups: DataFrame, light: int = LIGHT) -> DataFrame:
    """lang, a, b, f: the sum of absolute differences over all kept terms for each two groups (by number) of a language.

    ``postings``: lang, term, sid, p, p0, spread, is_first (once for each term). ``groups``: lang, sid, p0, n_light, n_heavy (terms of the language).
    """
    few = postings.filter(F.col("spread") <= light)
    two = groups.select("lang", "sid", "p0", "n_light").join(groups.select("lang", F.col("sid").alias("other"), F.col("p0").alias("p0_other")), "lang").filter("sid <> other")
    base = two.filter("sid < other").select("lang", F.col("sid").alias("a"), F.col("other").alias("b"), (F.abs(F.col("p0") - F.col("p0_other")) * F.col("n_light")).alias("f"))
    spectrum = few.groupBy("lang", "sid", "p").agg(F.count("*").alias("m"))
    alone = spectrum.groupBy("lang", "sid").cogroup(two.toDF("l", "s", "p0", "n_light", "other", "p0_other").groupBy("l", "s")).applyInPandas(_alone, _SUMS)
    # A light term's posting list has ``light`` groups at most, so its pairs are bounded.
    listed = few.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("sid", "p", "p0"))).alias("g"))
    both = listed.select("lang", F.posexplode("g").alias("k", "x"), "g").select("lang", "x", F.explode(F.slice("g", F.col("k") + 2, F.lit(light))).alias("y"))
    fix = F.abs(F.col("x.p") - F.col("y.p")) - F.abs(F.col("x.p") - F.col("y.p0")) - F.abs(F.col("x.p0") - F.col("y.p")) + F.abs(F.col("x.p0") - F.col("y.p0"))
    shared = both.groupBy("lang", F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).agg(F.sum(fix).alias("f"))

    block = F.floor(F.col("sid") / TILE_GROUPS).cast("int").alias("block")
    size = groups.groupBy("lang").agg(F.max(block).alias("last"), F.max("n_heavy").alias("n_heavy"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_heavy") / TILE_TERMS)).cast("int")
    # Each block meets itself and every other: one copy of its rows for each.
    meets = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("with")
    tile = [F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b")]
    many = postings.filter(F.col("spread") > light).join(size, "lang").select("lang", "sid", "term", "p", "p0", "is_first", block, "last", F.pmod(F.xxhash64("term"), parts).cast("int").alias("part"))
    # Every group is in each tile, also if it has none of its terms; it says how many terms the part has.
    every = groups.select("lang", "sid", "p0", block).join(many.filter("is_first").groupBy("lang", "part", "last").agg(F.count("*").alias("n_terms")), "lang")
    tiles = many.drop("is_first").unionByName(every, allowMissingColumns=True).select("*", meets).select("lang", *tile, "part", "sid", "term", "p", "p0", "block", "n_terms")
    heavy = tiles.groupBy("lang", "a", "b", "part").applyInPandas(_heavy_tile, _SUMS)
    return base.unionByName(alone).unionByName(shared).unionByName(heavy).groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, light: int = LIGHT, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: other sources by distance, and the terms that set a source apart.

    A pair's value is the sum over the kept terms of the language of the absolute
    differences of both shares, 0 if it keeps none. A term's value is by how much its share
    in the source exceeds that in the language; the first ``top`` are returned. Null text, language or source are ''; repeated rows count as often as
    they occur; ties in value go by the item's bytes; an empty table gives no rows. A very
    long text is counted piece by piece.
    """
    counts = stage(term_counts(docs, text_col, lang_col, source_col, least), "terms")
    kept = counts.filter("term is not null")
    is_light = F.col("spread") <= light
    langs = kept.groupBy("lang").agg(F.sum("n").alias("in_lang_total"), F.count_if("is_first").alias("terms"), F.count_if(F.col("is_first") & is_light).alias("n_light"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    some = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "in_lang_total", "terms", "n_light"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    base = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)
    # Written once: what follows reads both several times, and must not be dealt by language alone, as these windows are.
    groups = stage(some.withColumns({"sid": number, "p0": base, "n_heavy": F.col("terms") - F.col("n_light")}), "groups")
    postings = kept.join(groups.drop("n_light", "n_heavy"), ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("in_lang"), F.col("in_lang_total"), F.col("terms"))})
    postings = stage(postings.select("lang", "source", "term", "sid", "p", "p0", "q", "spread", "is_first"), "postings")

    sums = pair_sums(postings, groups, light)
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("sid"), F.col("b").alias("other")), F.struct(F.col("b").alias("sid"), F.col("a").alias("other")))).alias("x"), "f").select("lang", "x.*", "f")
    name = groups.select("lang", "sid", "source")
    pairs = both.join(name, ["lang", "sid"]).join(name.select("lang", F.col("sid").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("f").alias("value"))
    apart = postings.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    # The rank of terms is cut where it is made, so that each task sends ``top`` rows of a source at most.
    return pairs.withColumn("rank", rank).unionByName(apart.withColumn("rank", rank).filter(F.col("rank") <= top))
