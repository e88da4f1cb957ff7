"""Toxicity by a classifier chain.

The categories are predicted in order by logistic regressions on the words of a text;
each later one also sees the probabilities of the earlier ones. In training those are
out-of-fold predictions, so a later model learns from what it will meet. Models are
fitted on at most ``MAX_LABELLED`` labelled rows (the smallest hashes of their ids) on
the driver and have at most ``FEATURES`` words each; every row is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import arrow_rows

MAX_LABELLED, FEATURES, FOLDS, SEED = 4000, 200, 5, 23
#: A word in fewer labelled texts is no feature; weight of the squared coefficients.
LEAST_TEXTS, RIDGE = 3, 1.0
#: Standard errors by which a word's share of a class must differ to be a feature.
LEAST_Z = 4.5
#: Words, and runs of marks.
_WORD = re.compile(r"\w+|[^\w\s]{2,}")


def word_set(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Linear:
    words: dict[str, float]
    earlier: list[float]
    bias: float

    def probability(self, words: set[str], earlier: list[float]) -> float:
        own = self.words
        z = self.bias + sum(own[w] for w in words & own.keys()) + sum(a * b for a, b in zip(self.earlier, earlier, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(texts: list[set[str]], y: np.ndarray, earlier: np.ndarray) -> Linear:
    """A logistic regression on the words that tell the classes apart best, and the earlier probabilities."""
    n, yes = len(y), int(y.sum())
    if not 0 < yes < n:
        return Linear({}, [0.0] * earlier.shape[1], 10.0 if n and yes else -10.0)
    all_, own = Counter(), Counter()
    for words, label in zip(texts, y, strict=True):
        all_.update(words)
        if label:
            own.update(words)
    words = [w for w, c in all_.items() if c >= LEAST_TEXTS]
    c, k = np.array([all_[w] for w in words], float), np.array([own[w] for w in words], float)
    p = c / n
    z = (k - yes * p) / np.sqrt(yes * (1 - yes / n) * p * (1 - p) + 1e-9)
    best = sorted((i for i in range(len(words)) if abs(z[i]) >= LEAST_Z), key=lambda i: (-abs(z[i]), words[i]))[:FEATURES]
    chosen = {words[i]: j for j, i in enumerate(best)}
    m = len(chosen)
    x = np.zeros((n, m + earlier.shape[1] + 1), np.float32)
    for i, words_ in enumerate(texts):
        for w in words_ & chosen.keys():
            x[i, chosen[w]] = 1
    x[:, m:-1], x[:, -1] = earlier, 1
    ridge = np.full(x.shape[1], RIDGE)
    ridge[m:] = 1e-2
    weight = np.where(y == 1, 0.5 / yes, 0.5 / (n - yes)) * n  # both classes count the same
    w = np.zeros(x.shape[1])
    for _ in range(12):  # Newton's method; the feature count bounds the system
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (q - y)) + ridge * w
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return Linear({word: float(w[j]) for word, j in chosen.items()}, [float(v) for v in w[m:-1]], float(w[-1]))


def fit_chain(texts: list[set[str]], labels: np.ndarray, folds: np.ndarray) -> tuple[list[Linear], list[float]]:
    """The chain's models and each category's threshold, from the out-of-fold probabilities."""
    n, categories = labels.shape
    out_of_fold = np.zeros((n, 0))
    models, cuts = [], []
    for c in range(categories):
        y = labels[:, c]
        p = np.zeros(n)
        for f in range(FOLDS):
            test = np.flatnonzero(folds == f)
            train = np.flatnonzero(folds != f)
            model = fit([texts[i] for i in train], y[train], out_of_fold[train])
            for i in test:
                p[i] = model.probability(texts[i], out_of_fold[i].tolist())
        models.append(fit(texts, y, out_of_fold))
        cuts.append(_cut(p, y))
        out_of_fold = np.column_stack([out_of_fold, p])
    return models, cuts


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the greatest F1, halfway to the next lower probability."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    below = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> tuple[list[Linear], list[float]]:
    """``labels``: id and a 0/1 column for each category; rows with a null are left out, of repeated ids the greatest labels count."""
    sample = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
        .groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most)
    )
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
        .dropDuplicates(["doc_id"]).select("doc_id", "text", *categories).toPandas().sort_values("doc_id")
    )
    texts = [word_set(t) for t in rows["text"]]
    return fit_chain(texts, rows[categories].to_numpy(np.int64).reshape(len(rows), len(categories)), np.arange(len(rows)) % FOLDS)


def classify(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, and for each category ``p_<category>`` and the verdict ``<category>``; a row for each row.

    A null text is an empty one; texts of any length count whole; an empty table gives no
    rows. Repeated rows are each returned, with equal results. A category without labels of both
    kinds gets the one label there is (without any: false). A probability equal to the
    threshold is a yes. Words that tell the classes apart equally well are taken in order of
    the alphabet. Other columns of ``docs`` are not read.
    """
    models, cuts = train(docs, labels, categories, id_col, text_col, most)
    schema = pa.schema([("doc_id", pa.int64()), *[(f"p_{c}", pa.float64()) for c in categories], *[(c, pa.bool_()) for c in categories]])

    def run(c: dict) -> dict:
        found = []
        for t in c["text"]:
            words, p = word_set(t), []
            for m in models:
                p.append(m.probability(words, p))
            found.append(p)
        out = {"doc_id": c["doc_id"]}
        for k, name in enumerate(categories):
            out[f"p_{name}"] = [p[k] for p in found]
            out[name] = [p[k] >= cuts[k] for p in found]
        return out

    kinds = ", ".join(["doc_id bigint", *[f"p_{c} double" for c in categories], *[f"{c} boolean" for c in categories]])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(arrow_rows(run, schema), kinds)
