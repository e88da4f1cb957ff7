"""URL filters: host-suffix and path-prefix expressions joined to rules by short hash prefixes.

Every URL is expanded only into the (number of host labels, path length) shapes that
the rules have, so a long host or path costs no more than the rules ask for. The join
is on the first 32 bits of SHA-256; the full digest then confirms, and the longest
fitting rule wins (at equal length ``block`` before ``allow``, then the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast (some 100 bytes each); beyond it the join shuffles.
BROADCAST_RULES = 100_000
#: Different (labels, path length) shapes that one rule set may have.
MAX_SHAPES = 4096

#: The rules of the query: (host, path, action).
QUERY_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """A row for each row of ``pages``: id, host, path, rule, verdict.

    ``rules``: host, path, action ('allow' or 'block'); as in URLs, only A-Z are lowered. A null URL or one without ``://``
    has an empty host and path and gets ``default`` with a null rule. Rules with a null
    part are ignored; of equal rules with different actions ``block`` counts. Ids may be
    null or repeated; other columns of ``pages`` are not read. Raises ValueError if the
    rules have more than ``MAX_SHAPES`` shapes.
    """
    rules = (
        rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action"))
        .dropna()
        .filter("r_host <> ''")
        .groupBy("r_host", "r_path")
        .agg(F.max("r_action").alias("r_action"))
        .withColumn("rule", F.concat("r_host", "r_path"))
        .withColumn("labels", F.size(F.split("r_host", r"\.")))
        .withColumn("length", F.length("r_path"))
        .withColumn("r_digest", F.sha2("rule", 256))
        .withColumn("short", _short(F.col("r_digest")))
    )
    shapes = rules.groupBy("labels", "length").agg(F.count("*").alias("n")).limit(MAX_SHAPES + 1).collect()
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} rule shapes")
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not shapes:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    depth = F.size(F.split("host", r"\."))
    wide = F.length("path")
    fits = [
        F.when((depth >= s.labels) & (wide >= s.length), F.concat(F.substring_index("host", ".", -s.labels), F.substring("path", 1, s.length)))
        for s in shapes
    ]
    expressions = (
        urls.filter("host <> ''").select("host", "path").distinct()
        .withColumn("expression", F.explode(F.array_compact(F.array(*fits))))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("short", _short(F.col("digest")))
    )
    known = rules.select("short", "r_digest", "rule", "r_action")
    if sum(s.n for s in shapes) <= BROADCAST_RULES:
        known = F.broadcast(known)
    best = (
        expressions.join(known, "short")
        .filter("digest = r_digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.col("r_action"), F.col("rule"))).alias("best"))
    )
    # URLs that can't fit a rule stay out of the join back: pages without a URL would all meet in one task.
    # A single URL of very many pages is left to the adaptive split of skewed joins.
    named = urls.filter("host <> ''").join(best, ["host", "path"], "left")
    rest = urls.filter("host = ''").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    return named.unionByName(rest).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_action", F.lit(default)).alias("verdict"))


def query_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERY_RULES, "host string, path string, action string")
