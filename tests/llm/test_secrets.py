"""The randomness battery of the secret scan: false-discovery control, recall by encoding, ordinary strings left alone."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from probelake.llm import secrets
from tests.conftest import data
from tests.llm.test_ops import docs, plain_spans

RND = random.Random(61)


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{data('sf0.01')}/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def nulls(spark, texts):
    return secrets.fit_nulls(docs(spark, texts))


def test_chi_squared_tail():
    for x, df in ((3.841459, 1), (5.991465, 2), (7.814728, 3), (18.307038, 10), (37.652484, 25), (79.081944, 60)):
        assert secrets.chi_squared_tail(x, df) == pytest.approx(0.05, abs=1e-6)
    assert secrets.chi_squared_tail(-1, 5) == secrets.chi_squared_tail(0, 4) == 1


def test_p_values_of_random_strings_are_even():
    for k in (10, 26, 64):
        ps = np.array([secrets.chance(np.array([RND.randrange(k) for _ in range(200)]), k) for _ in range(400)])
        assert all(abs((ps[:, j] < 0.1).mean() - 0.1) < 0.06 and abs((ps[:, j] < 0.5).mean() - 0.5) < 0.1 for j in range(3))
    up = np.array([i % 26 for i in range(52)])  # the alphabet in order: even, but serially correlated
    assert secrets.chance(up, 26)[0] > 0.9 and secrets.chance(up, 26)[2] < 1e-6


def plain_words(text, alphabet, shape):
    """A text's short words that the alphabet holds, joined, letter by letter."""
    return "".join(shape(w) for w in re.findall("[A-Za-z0-9+/_=-]+", text or "") if len(w) < 20 and set(shape(w)) <= set(alphabet))


@pytest.mark.parametrize(
    ("name", "whole", "shape"),
    [("base36", "0123456789abcdefghijklmnopqrstuvwxyz", str.lower), ("hex_upper", "0123456789abcdefghijklmnopqrstuvwxyz", str.lower), ("decimal", "0123456789abcdefghijklmnopqrstuvwxyz", str.lower), ("base64", secrets.ENCODINGS[-1][1], lambda w: w[0].upper() + w[1:])],
)
def test_nulls_equal_brute_force(texts, nulls, name, whole, shape):
    letters = next(x for n, x, _ in secrets.ENCODINGS if n == name)
    fold = letters if name == "base64" else letters.lower()
    pairs, numbers = Counter(), []
    for t in texts:
        own = plain_words(t, whole, shape)
        pairs.update(zip(own, own[1:], strict=False))
        numbers += [w for w in re.findall("[A-Za-z0-9+/_=-]+", t or "") if len(w) < 20 and w.isdigit()]
    k, into, outof = len(fold), Counter(), Counter()
    for (a, b), n in pairs.items():
        outof[a] += n
        into[b] += n if a in fold and b in fold else 0
    total = sum(into[c] for c in fold)
    share = {c: (into[c] + 1) / (total + k) for c in fold}
    ends = (len(numbers) + 1) / (sum(map(len, numbers)) + 4) if name == "decimal" else 0
    s = "".join(RND.choices(letters, k=20))
    v = [letters.index(c) for c in s]
    s = s if name == "base64" else s.lower()
    log = np.log(0.7 * k * share[s[0]] + 0.3)
    for a, b in zip(s, s[1:], strict=False):
        log += np.log(0.7 * k * (pairs[a, b] + 10 * share[b]) / (outof[a] + 10) + 0.3) + np.log(1 - ends)
    assert nulls[name].p_value(np.array(v)) == pytest.approx(min(1, np.exp(log)), rel=1e-6)


def test_no_size_of_the_table_is_treated_apart(spark):
    """Words in any number leave a pangram alone, and values after a name are found in each table."""
    pangram, key = "thequickbrownfoxjumpsoverthelazydog", "Zk3vQ9pL0tXb7YwR2mNc5HdJ8sGf1aVe"
    for name in ("sf0.001", "sf0.01", "sf0.1"):
        rows = [r.text for r in spark.read.parquet(f"{data(name)}/documents.parquet").select("text").collect()] + [f"x {pangram} y", f"x AWS_KEY={key}", f"?sig={key}&x=1", f"x {key}== y"]
        found = {r.doc_id - len(rows) + 4: r.spans for r in secrets.report(docs(spark, rows)).collect() if r.doc_id >= len(rows) - 4}
        assert found == {0: "", 1: "random:10:42", 2: "random:5:37", 3: "random:2:36"}


def plain_threshold(cases, rate):
    """Indices that weighted Benjamini-Hochberg accepts, by sorting."""
    mean = sum(n for n, _ in cases) / len(cases)
    order = sorted(range(len(cases)), key=lambda i: cases[i][1] * mean / cases[i][0])
    last = max((r for r, i in enumerate(order, 1) if cases[i][1] * mean / cases[i][0] <= rate * r / len(cases)), default=0)
    return set(order[:last])


def test_the_threshold_equals_a_sort(spark):
    for seed in range(6):
        rnd = random.Random(seed)
        cases = [(rnd.randint(20, 90), rnd.choice([rnd.random(), 10 ** -rnd.uniform(0, 6), 1.0, 0.004])) for _ in range(rnd.choice([1, 7, 60]))]
        rows = [(k, [(0, n, "lower", p) for n, p in cases[k::3]]) for k in range(3)]
        least = secrets.threshold(spark.createDataFrame(rows, "doc_id long, found array<struct<start:int,end:int,encoding:string,p:double>>"))
        assert {i for i, (n, p) in enumerate(cases) if p <= least * n} == plain_threshold(cases, secrets.RATE)
    assert secrets.threshold(spark.createDataFrame([(1, [])], "doc_id long, found array<struct<start:int,end:int,encoding:string,p:double>>")) == -1


def joined(words, least, how):
    own = []
    while sum(map(len, own)) < least:
        own.append(RND.choice(words))
    return how(own)


def test_recall_by_encoding_and_ordinary_strings(spark, texts):
    """Random strings of each encoding among identifiers, paths, dates and runs of words."""
    words = sorted({w for t in texts if t for w in t.split() if w.isalpha() and w.isascii()})
    shapes = ["".join, "_".join, "/".join, "-".join, lambda ws: "".join(w.title() for w in ws), lambda ws: "".join(ws).upper()]
    plain = [joined(words, RND.choice([20, 26, 40]), how) for how in shapes for _ in range(40)]
    plain += [f"20{RND.randint(10, 30)}-0{RND.randint(1, 9)}-1{RND.randint(0, 9)}_20{RND.randint(10, 30)}-12-2{RND.randint(0, 9)}" for _ in range(20)] + ["-" * 60, "=" * 40, "ab" * 30, "0123456789" * 3, secrets.ENCODINGS[4][1]]
    planted = [(name, n, "".join(RND.choices(letters, k=n))) for name, letters, _ in secrets.ENCODINGS for n in (32, 64) for _ in range(30)]
    planted = [(name, n, s) for name, n, s in planted if not plain_spans(s)]  # hex in lower case is a pattern's already
    rows = texts + [f"a {s} b" for s in plain] + [f"a {s} b" for _, _, s in planted]
    found = {r.doc_id for r in secrets.report(docs(spark, rows)).filter("spans like '%random%'").collect()}
    assert not [s for i, s in enumerate(plain, len(texts)) if i in found]
    hits, number = Counter(), Counter()
    for i, (name, n, _) in enumerate(planted, len(texts) + len(plain)):
        number[name, n] += 1
        hits[name, n] += i in found
    share = {k: hits[k] / number[k] for k in number}
    assert all(v >= 0.9 for v in share.values()), share


def test_battery_edges(spark, nulls):
    assert secrets.battery("=" * 30, nulls) == (None, 1.0) and secrets.battery("a=b" * 10, nulls) == (None, 1.0)
    assert secrets.battery("é" * 3, nulls) == (None, 1.0) and secrets.battery("z" * 100_000, nulls) == ("lower", 1.0)
    long = "".join(RND.choices(secrets.ENCODINGS[8][1], k=300_000))
    got = {r.doc_id: r.spans for r in secrets.report(docs(spark, [None, "", long, "words " * 100_000, long], [1, 1, 2, None, 2])).collect()}
    assert set(got) == {1, 2, None}
    for nothing in ([None, ""], []):  # nothing is known of ordinary text: nothing is found
        bare = secrets.fit_nulls(docs(spark, nothing))
        assert all(secrets.battery("".join(RND.choices(letters, k=64)), bare)[1] > 0.5 for _, letters, _ in secrets.ENCODINGS)
    clash = docs(spark, ["x password=hunter22"]).selectExpr("doc_id", "text", "1 AS spans", "2 AS base", "3 AS found")
    assert secrets.report(clash).first().spans == "assign:2:19"
