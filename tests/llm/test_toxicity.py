"""The classifier chain against a plain one, and held-out labels."""

import math

import numpy as np
import pytest

from probelake.llm import toxicity
from tests.conftest import data
from tests.llm.test_ops import docs


@pytest.fixture(scope="module")
def tables(spark):
    documents, labels = (spark.read.parquet(f"{data('sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    return documents.select("doc_id", "text"), labels.selectExpr("doc_id", "1 - quality AS poor", "toxic")


def test_the_chain_equals_a_plain_one(tables):
    """The second model learns from out-of-fold probabilities of the first."""
    texts = {r.doc_id: r.text for r in tables[0].collect()}
    rows = sorted((r.doc_id, r.poor, r.toxic) for r in tables[1].collect())
    words, y, folds = [toxicity.word_set(texts[i]) for i, *_ in rows], np.array([r[1:] for r in rows]), np.arange(len(rows)) % toxicity.FOLDS
    none = np.zeros((len(rows), 0))
    first = np.zeros(len(rows))
    for f in range(toxicity.FOLDS):
        own = [i for i in range(len(rows)) if folds[i] != f]
        model = toxicity.fit([words[i] for i in own], y[own, 0], none[own])
        for i in set(range(len(rows))) - set(own):
            first[i] = 1 / (1 + math.exp(-(model.bias + sum(model.words.get(w, 0) for w in words[i]))))
    second = toxicity.fit(words, y[:, 1], first[:, None])
    models, _ = toxicity.fit_chain(words, y, folds)
    assert models[1].words == pytest.approx(second.words) and models[1].earlier == pytest.approx(second.earlier) and models[1].bias == pytest.approx(second.bias)


def test_classify_equals_the_models_and_holds_on_unseen_labels(spark, tables):
    """Trained on even ids; the limits are those that so few examples (16 toxic ones) allow."""
    documents, labels = tables
    even = labels.filter("doc_id % 2 = 0")
    got = {r.doc_id: r for r in toxicity.classify(documents, even, ["poor", "toxic"]).collect()}
    models, cuts = toxicity.train(documents, even, ["poor", "toxic"])
    for r in documents.collect():
        p = []
        for m in models:
            z = m.bias + sum(m.words.get(w, 0) for w in toxicity.word_set(r.text)) + sum(a * b for a, b in zip(m.earlier, p, strict=True))
            p.append(1 / (1 + math.exp(-max(min(z, 60), -60))))
        mine = got[r.doc_id]
        assert (mine.p_poor, mine.p_toxic) == pytest.approx(p, abs=1e-9) and (mine.poor, mine.toxic) == (p[0] >= cuts[0], p[1] >= cuts[1])
    truth = {r.doc_id: r.toxic for r in labels.filter("doc_id % 2 = 1").collect()}
    bad, clean = [i for i, t in truth.items() if t], [i for i, t in truth.items() if not t]
    assert sum(got[i].toxic for i in bad) >= 0.65 * len(bad) and sum(got[i].toxic for i in clean) <= 0.08 * len(clean)


def test_repeated_rows_ties_and_clashing_names(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    texts = docs(spark, ["vile words", "vile words", "kind words", None, "w " * 100_000], [1, 1, 2, None, 4]).selectExpr("doc_id", "text", "'x' AS toxic", "1 AS p_toxic")
    got = toxicity.classify(texts, labels, ["toxic"]).collect()
    assert len(got) == 5 and len({(r.p_toxic, r.toxic) for r in got if r.doc_id == 1}) == 1
