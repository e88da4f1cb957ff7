"""Quality by importance resampling.

Two hashed n-gram models (words and marks, one and two at a time, in ``BUCKETS``
buckets) are counted: over all texts (raw) and over labelled good ones (target). A
document's log importance weight is the log ratio of their likelihoods for ``PASSAGE``
n-grams: the mean over its own n-grams, with ``PRIOR`` more of ratio one, times ``PASSAGE``.
(The plain sum grows with the text to hundreds, and nothing random would be left of the
sample.) With a Gumbel variable added to each weight, the ``k`` greatest keys are a sample
without replacement in proportion to the weights.

``k`` is either given, or the number of documents that look like the target: those whose
weight passes the cut that best parts the labelled good documents from the labelled poor
ones. A sample of that size holds nearly all of them, and chance decides near the border; a
smaller ``k`` draws among the good ones. Every labelled row counts: half of the good ones
(by hashes of their ids) are the target, the other half and all poor ones, which the models
have not seen, fit the cut. The raw model and the keys cover all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.llm.common import ROWS, stage, text_hash

BUCKETS, SEED = 10_000, 17
#: N-grams for which a weight stands, and n-grams of ratio one that steady short texts.
PASSAGE, PRIOR = 40.0, 20.0
#: Share of the labelled that the cut may give up to lie lower, which keeps more of the good.
SLACK = 0.002
#: A bigram's bucket from the hashes of its parts.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Cached tokens of a worker, and the length from which a token is not cached.
_CACHE: dict[str, int] = {}
CACHE, LONG = 500_000, 64


def buckets(text: str | None, n: int = BUCKETS) -> np.ndarray:
    """Buckets of all words, marks and neighbouring pairs of a text; bucket 0 is for a word and the same word again."""
    global _CACHE
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int64)
    if len(_CACHE) > CACHE:
        _CACHE = {}
    found = list(map(_CACHE.get, tokens))
    if None in found:
        for i, t in enumerate(tokens):
            if found[i] is None:
                found[i] = zlib.crc32(t.encode("utf-8", "surrogatepass"))
                if len(t) < LONG:
                    _CACHE[t] = found[i]
    h = np.array(found, np.uint64)
    pairs = ((h[:-1] * _MIX + h[1:]) * _MIX >> np.uint64(20)) % np.uint64(n - 1) + np.uint64(1)
    pairs[h[:-1] == h[1:]] = 0
    return np.concatenate([h % np.uint64(n - 1) + np.uint64(1), pairs]).astype(np.int64)


def _other_half(id_col: str) -> Column:
    """Whether a good document is left for the cut."""
    return F.xxhash64(F.lit(SEED + 1), id_col) % 2 == 0


def labelled(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, label (the greatest of repeated ones), held (is it left for the cut?) of all labelled rows."""
    return (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).dropna()
        .groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("held", (F.col("label") != 1) | _other_half("doc_id"))
    )


#: Its name from when it took some of the rows.
labelled_sample = labelled


def _counts(n: int) -> tuple:
    schema = pa.schema([("target", pa.bool_()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS).to_pydict()
                for text, target in zip(part["text"], part["target"], strict=True):
                    total[int(target)] += np.bincount(buckets(text, n), minlength=n)
        for k in (0, 1):
            own = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array([k == 1] * len(own), pa.bool_()), pa.array(own.astype(np.int32)), pa.array(total[k][own])], schema=schema)

    return run, "target boolean, bucket int, n bigint"


def log_ratio(docs: DataFrame, target: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """Log of target over raw probability by bucket, with one added to each count. ``docs``: doc_id, text; ``target``: the doc_id of some, each once.

    The texts that can be the target's are dealt out by id to meet it, for it may be too large to broadcast.
    """
    run, kind = _counts(n)
    of = docs.filter(~_other_half("doc_id")).join(target.hint("merge"), "doc_id")
    texts = docs.select("text", F.lit(False).alias("target")).union(of.select("text", F.lit(True)))
    rows = texts.mapInArrow(run, kind).groupBy("target", "bucket").agg(F.sum("n").alias("n")).collect()  # 2 * n rows at most
    c = np.ones((2, n))
    for r in rows:
        c[int(r.target), r.bucket] += r.n
    p = np.log(c / c.sum(axis=1, keepdims=True))
    return p[1] - p[0]


def gumbel(*of: str, seed: int | Column = SEED) -> Column:
    """A Gumbel variable from the columns ``of``, the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_greatest(rows: DataFrame, key: str, k: int) -> float | None:
    """The ``k``-th greatest key, None if there are fewer. Nothing is sorted: histograms of 4,096 bins, each within the bin of the one before, end at one value."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return None
    above = 0
    while low < high:
        width = (high - low) / 4096
        inside = rows.filter((F.col(key) >= F.lit(low)) & (F.col(key) <= F.lit(high)))
        bins = inside.groupBy(F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(4095)).alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("most")).collect()
        for b in sorted(bins, key=lambda b: -b.b):
            if above + b.n >= k:
                low, high = b.least, b.most
                break
            above += b.n
        else:
            return None
    return low if above + rows.filter(F.col(key) == F.lit(low)).count() >= k else None


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The rows with the ``k`` greatest keys; those with a key equal to the k-th all belong."""
    if k <= 0:
        return rows.limit(0)
    least = kth_greatest(rows, key, k)
    return rows if least is None else rows.filter(F.col(key) >= F.lit(least))


def best_cut(weights: np.ndarray, labels: np.ndarray) -> float:
    """The weight from which on a row counts as good: the lowest whose true less false shares are within ``SLACK`` of the greatest."""
    good, poor = (labels == 1).sum(), (labels != 1).sum()
    if not good or not poor:
        return -np.inf
    order = np.argsort(-weights, kind="stable")
    w, y = weights[order], labels[order] == 1
    score = np.cumsum(y) / good - np.cumsum(~y) / poor
    last = np.append(w[1:] != w[:-1], True)
    at = np.flatnonzero(last & (score >= score[last].max() - SLACK))[-1]
    below = w[at + 1] if at + 1 < len(w) else w[at] - 1
    return float((w[at] + below) / 2)


def cut_of(known: DataFrame) -> float:
    """``best_cut`` of rows (log_weight, label) at any number of them.

    Equal weights are counted together and dealt out by ranges of the weights; the counts
    above a range, whose totals are a row each, and the sums within it give the shares.
    """
    each = known.groupBy("log_weight").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") != 1).alias("poor"))
    ranged = stage(each.repartitionByRange("log_weight").withColumn("part", F.spark_partition_id()), "cut")
    totals = ranged.groupBy("part").agg(F.sum("good").alias("good"), F.sum("poor").alias("poor"))
    good, poor = totals.agg(F.sum("good"), F.sum("poor")).first()
    if not good or not poor:
        return -np.inf
    higher = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    above = totals.select("part", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_above") for c in ("good", "poor")])
    within = Window.partitionBy("part").orderBy(F.desc("log_weight"))
    share = lambda c, n: (F.col(f"{c}_above") + F.sum(c).over(within)) / F.lit(n)
    scored = ranged.join(F.broadcast(above), "part").select("log_weight", (share("good", good) - share("poor", poor)).alias("score"))
    most = scored.agg(F.max("score")).first()[0]
    at = scored.filter(F.col("score") >= F.lit(most - SLACK)).agg(F.min("log_weight")).first()[0]
    below = ranged.filter(F.col("log_weight") < F.lit(at)).agg(F.max("log_weight")).first()[0]
    return (at + (at - 1 if below is None else below)) / 2


def log_weight(b: np.ndarray, ratio: np.ndarray) -> float:
    return float(ratio[b].sum()) / (len(b) + PRIOR) * PASSAGE


def weights(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, n_grams, log_weight, key: a row for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ratio = log_ratio(rows, labelled(labels, label_col).filter(~F.col("held")).select("doc_id"))
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [buckets(t, len(ratio)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array([len(b) for b in found], pa.int64()), pa.array([log_weight(b, ratio) for b in found], pa.float64())], schema=schema
                )

    slim = rows.select("doc_id", text_hash("text").alias("text_hash"), "text")
    scored = slim.mapInArrow(run, "doc_id bigint, text_hash bigint, n_grams bigint, log_weight double")
    return scored.withColumn("key", F.col("log_weight") + gumbel("doc_id", "text_hash", seed=seed))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, n_grams, log_weight, key of the sampled rows.

    A null or empty text has weight 0, so its key is its Gumbel variable. Without labelled
    rows of both kinds and without ``k`` every row is kept; an empty table gives no rows. The
    Gumbel variable comes from id and text: repeated rows have equal keys and stay or go
    together, so a sample can exceed ``k`` by repeated rows. Texts of any length count whole.
    Labels without a document, and null labels, count for nothing. Other columns are not read.
    """
    keys = stage(weights(docs, labels, label_col, id_col, text_col, seed), "quality")
    if k is None:
        held = labelled(labels, label_col).filter("held").select("doc_id", "label")
        cut = cut_of(keys.select("doc_id", "log_weight").join(held.hint("merge"), "doc_id"))
        k = keys.filter(F.col("log_weight") >= F.lit(cut)).count()
    return top_k(keys, "key", k).select("doc_id", "text_hash", "n_grams", "log_weight", "key")
