"""How document filters interact: what each removes at each place of every order, from the edges of the lattice of applied subsets.

A document matters only by the set of filters that it fails. Documents are counted by that
set, and each count goes to the edges (filters already applied, next filter) of the lattice:
80 for five filters. An order of filters is a path through the lattice, so the edges are
joined to the steps of all orders (600 rows for five filters), and no order is ever run.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What parts words, the marks of condition D, and the capitals of condition C.
SPACE, MARKS, CAPITALS = r"[\x20\x09-\x0D]+", "[#$%&*|]", "[A-Z]"
LEAST_WORDS = 200


def text_conditions(text: Column) -> dict[str, Column]:
    """Name to condition (true: the text fails), of a text that is not null; all but copies, which need other rows."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, CAPITALS, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(MARKS),
    }


COPIES = "E"


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, failed (bits of ABCDE in this order), good, toxic, n: documents counted by part, what they fail and their labels.

    A document fails E if its text is also that of a smaller id. Texts stay where they are
    read: only their SHA-256 moves. Copies are found by two sums, by (id, text) and by text
    (each summed in the tasks first), so a text that a third of all rows share is no hot
    task. A null text is empty and a null part ''; a null id is no smaller id, has no
    smaller one and no label; rows that repeat an id with one text are counted and are not
    each other's copies. Of several labels of an id any counts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((c.cast("int") * (1 << k) for k, c in enumerate(text_conditions(F.col("text")).values())), F.lit(0))
    slim = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
        .select("id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), bits.alias("bits"))
    )
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).filter("id is not null")
    # Rows without an id meet no label; dealt by their text, they do not meet each other either.
    place = lambda named, other: [F.coalesce("id", other).alias("place"), named.alias("named")]
    left = slim.select("*", *place(F.col("id").isNotNull(), F.xxhash64("digest", "part")))
    right = marks.select(*place(F.lit(True), F.lit(0)), "good", "toxic")
    known = left.join(right, ["place", "named"], "left").fillna(0, ["good", "toxic"])
    by_id = known.groupBy("place", "named", "id", "digest", "part", "bits", "good", "toxic").agg(F.count("*").alias("n"))
    kinds = by_id.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    )
    # A text now has a row for each part and label at most.
    is_first = F.col("first") == F.min("first").over(Window.partitionBy("digest"))
    kept = F.col("kept")
    kinds = kinds.withColumn("kept", F.col("n_null") + F.when(is_first, F.col("n_first")).otherwise(0))
    each = kinds.select("part", "bits", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("copy"), kept.alias("n")), F.struct(F.lit(1).alias("copy"), (F.col("n") - kept).alias("n")))).alias("x"))
    return each.filter("x.n > 0").groupBy("part", (F.col("bits") + F.col("x.copy") * 16).alias("failed"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def edges(counted: DataFrame, names: str = "ABCDE") -> DataFrame:
    """part, applied (bits), filter (number) and the sums of each edge of the lattice, from ``failures``: 80 for each part."""
    n = len(names)
    each = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for f in range(n) for s in range(1 << n) if not s >> f & 1])
    rows = counted.select("*", F.explode(each).alias("e")).select("*", "e.*")
    fails = F.col("failed").bitwiseAND(F.expr("1 << filter")) != 0
    reached = F.col("failed").bitwiseAND(F.col("applied")) == 0
    only = F.col("failed") == F.expr("1 << filter")
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return rows.groupBy("part", "applied", "filter").agg(
        total(reached & ~fails).alias("kept"), total(reached & fails).alias("removed"), total(~reached & fails).alias("redundant"), total(only).alias("unique_fails"),
        total(reached & fails & (F.col("good") == 1)).alias("good_lost"), total(reached & fails & (F.col("toxic") == 1)).alias("toxic_lost"),
    )


def steps(spark, names: str = "ABCDE") -> DataFrame:
    """filter_order, step (from 1), applied, filter: every step of every order; n! times n rows."""
    rows = []
    for order in permutations(range(len(names))):
        applied = 0
        for step, f in enumerate(order):
            rows.append(("".join(names[x] for x in order), step + 1, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, filter.

    A row for each part that occurs, order and step, zeros included; an empty table gives
    none. ``shapley``: what the filter removes, summed over all orders; an edge lies on
    |applied|! (n - 1 - |applied|)! of them. Very long texts are scanned whole where they
    are read; columns other than those named are not read.
    """
    names = "ABCDE"
    lattice = edges(failures(docs, labels, id_col, text_col, part_col), names)
    paths = [factorial(k) * factorial(len(names) - 1 - k) for k in range(len(names))]
    weight = F.element_at(F.array(*map(F.lit, paths)), F.bit_count("applied") + 1)
    shapley = F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "filter"))  # 16 edges
    walked = lattice.withColumn("shapley", shapley).join(F.broadcast(steps(docs.sparkSession, names)), ["applied", "filter"])  # 600 rows
    return walked.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley", F.substring(F.lit(names), F.col("filter") + 1, F.lit(1)).alias("filter"))
