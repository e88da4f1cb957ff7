"""Cases in which the operators once did less than the whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelake.llm import decontaminate, licenses, quality


def leak_index(texts, total=10**9, df=10**7):
    """An index as a corpus of ``total`` documents would make it."""
    index = decontaminate.Index([(n, decontaminate.words(t), []) for n, t in enumerate(texts)])
    n = len(index.vocabulary)
    index.weigh(total, np.full(n, df))
    index.project(np.eye(n))
    return index


def test_verbatim_items_are_found_at_any_number_of_documents():
    item = "which of the rivers flows through the town"  # 8 words
    text = " ".join(f"other{i}" for i in range(60)) + f" {item} " + " ".join(f"more{i}" for i in range(60))
    assert [(k, share) for k, _, share, *_ in leak_index([item]).leaks(text)] == [(0, 1.0)]


def test_words_outside_the_benchmark_do_not_hide_changed_items():
    item = "which of the rivers flows through the old town".split()
    item[3] = "streams"  # no run of eight words is left
    text = " ".join(f"other{i}" for i in range(60)) + f" {' '.join(item)} " + " ".join(f"more{i}" for i in range(60))
    assert [k for k, *_ in leak_index(["which of the rivers flows through the old town"]).leaks(text)] == [0]


def test_a_whole_passage_is_found_after_a_neighbour_that_is_none():
    words = [f"w{i}" for i in range(200)]
    index = leak_index([" ".join(words)])
    held = words[16:48]
    held[5] = held[18] = held[22] = held[26] = "changed"  # 28 of 32, not the first eight
    text = " ".join(["x"] * 64 + held + ["y"] * 64)
    # The neighbour first: it lies in the same place of the item, and has little over a part.
    index.candidates = lambda ids: (np.array([48, 64]), np.array([0, 1]), np.array([0.9, 0.8], np.float32))
    assert [k for k, *_ in index.leaks(text)] == [0]


def test_notices_wrapped_over_comment_lines_are_found(spark):
    head = "# some tool\n#\n# This work is licensed under the GNU\n# General Public License,\n# version 3.\n#\n"
    rows = [("a/x.py", head + "plain words of a longer text\n" * 80), ("b/y.py", "plain words of a longer text\n" * 80)]
    table = spark.createDataFrame([(n, p, t) for n, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    assert {r.doc_id: (r.license, r.notices) for r in licenses.scan(table).collect()} == {0: ("GPL-3.0", "GPL-3.0"), 1: (None, "")}


def test_the_latent_space_keeps_the_whole_benchmark_whatever_the_documents_are(spark):
    """Passages of few items are kept whole, and other documents change neither the space nor the cosine of a copy."""
    rnd = np.random.default_rng(3)
    items = [(n, " ".join(f"w{x}" for x in rnd.integers(0, 300, 40))) for n in range(30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    # As many documents as items, each with words of the whole benchmark in an order of its own.
    noise = [(n, " ".join(f"w{x}" for x in rnd.permutation(300))) for n in range(30)]
    copies = [(1000 + n, f"before {t} after") for n, t in items]
    index, rows = decontaminate.build_index(spark.createDataFrame(noise + copies, "doc_id long, text string"), next(decontaminate.read_parts(benchmark)), [], write=True)
    whole = np.array([np.sqrt(((index.idf[w] * n) ** 2).sum()) for w, n in (np.unique(r, return_counts=True) for r in index.query_rows())])
    assert np.allclose(index.kept * index.whole, whole, rtol=1e-3)
    assert rows.count() == 60
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(noise + copies, "doc_id long, text string"), benchmark).collect()}
    assert found == {(1000 + n, n) for n in range(30)}


def test_frequencies_count_each_document_once(spark):
    vocabulary = {w: i for i, w in enumerate("abc")}
    docs = spark.createDataFrame([(1, "a a b x"), (2, ""), (3, None), (4, "b a b"), (5, "x y")], "doc_id long, text string")
    total, df = decontaminate.frequencies(decontaminate.numbered(docs, vocabulary, []), 3)
    assert (total, df.tolist()) == (5, [2, 2, 0])


def test_short_items_are_found_at_words(spark):
    """Numbers of 16 and 32 bits whose bytes could meet across words."""
    index = leak_index(["a b", *[f"w{i} x{i} y{i} z{i} p{i} q{i} r{i} s{i} t{i}" for i in range(70)]])
    assert [(k, place) for k, _, _, place, _ in index.leaks("b a x1 a b a b")] == [(0, 3)]
    assert index.leaks("a") == index.leaks("b a") == []


def test_every_labelled_row_fits_the_quality_model_and_its_cut(spark):
    """More than 20,000 of them: the target's counts and the cut are those of all rows."""
    n = 21_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7, F.lit(" x"), F.col("id") % 11, F.lit(" y"), F.col("id") % 13).alias("text"))
    labels = docs.select("doc_id", (F.xxhash64("doc_id") % 10 < F.col("doc_id") % 7).cast("int").alias("quality"))
    half = quality.SEED + 1
    rows = docs.join(labels, "doc_id").select("*", (F.xxhash64(F.lit(half), "doc_id") % 2 == 0).alias("held")).toPandas()
    c = np.ones((2, quality.BUCKETS))
    own = [quality.buckets(t) for t in rows["text"]]
    for b, good, held in zip(own, rows["quality"], rows["held"], strict=True):
        c[0] += (count := np.bincount(b, minlength=quality.BUCKETS))
        c[1] += count if good and not held else 0
    p = np.log(c / c.sum(1, keepdims=True))
    want = np.array([quality.log_weight(b, p[1] - p[0]) for b in own])
    got = quality.weights(docs, labels).toPandas().sort_values("doc_id")["log_weight"].to_numpy()
    assert np.allclose(got, want[np.argsort(rows["doc_id"])], atol=1e-9)
    seen = (rows["quality"] != 1) | rows["held"]
    cut = quality.best_cut(want[seen], rows["quality"].to_numpy()[seen])
    assert quality.resample(docs, labels).agg(F.countDistinct("doc_id")).first()[0] == (want >= cut).sum()


def test_the_cut_of_rows_on_spark_is_the_best_cut(spark):
    rnd = np.random.default_rng(5)
    for n, digits in ((2, 3), (40, 1), (3000, 2), (3000, 9)):
        y = rnd.integers(0, 2, n)
        y[:2] = 0, 1
        w = np.round(rnd.normal(y, 1), digits)
        rows = spark.createDataFrame(list(zip(w.tolist(), y.tolist(), strict=True)), "log_weight double, label int").repartition(3)
        assert quality.cut_of(rows) == pytest.approx(quality.best_cut(w, y), abs=1e-12)
    assert quality.cut_of(rows.filter("label = 1")) == quality.cut_of(rows.limit(0)) == -np.inf
