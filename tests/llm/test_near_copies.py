"""Near copies by the similarity of shingle sets, against all pairs."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from probelake.llm import simhash
from tests.llm.test_ops import docs, plain_components


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def plain_copies(texts, least=0.8):
    """The number of the first text of each component, by all pairs."""
    own, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] == own[j] or both and both >= least * len(own[i] | own[j]) - 1e-9:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(own))]


def edited(rnd, text, share):
    return " ".join("changed" + str(rnd.randrange(10**6)) if rnd.random() < share else w for w in text.split())


def make(seed, families=25, members=8):
    rnd = random.Random(seed)
    words = [f"w{n}" for n in range(3000)]
    passage = " ".join(rnd.choices(words, k=60))
    out = []
    for _ in range(families):
        base = " ".join(rnd.choices(words, k=rnd.choice([4, 30, 120, 400])))
        if rnd.random() < 0.5:
            base += " " + passage
        out += [base] + [edited(rnd, base, rnd.choice([0, 0.005, 0.02, 0.03, 0.06])) for _ in range(members)]
    rnd.shuffle(out)
    return out + [None, "", " \t ", "One two three", "one TWO three", "É a b c d e", "é a b c d e", "a b " * 40_000]


def found(rows, number):
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.component, r.doc_id)
    by = {r.doc_id: first[r.component] for r in rows}
    return [by[i] for i in range(number)]


def test_components_equal_all_pairs(spark):
    texts = make(1)
    got = found(simhash.near_copies(docs(spark, texts)).collect(), len(texts))
    assert got == plain_copies(texts)
    assert len(set(got)) < len(texts) - 60


def test_large_groups_are_cut_into_blocks(spark):
    rnd = random.Random(2)
    base = " ".join(f"w{rnd.randrange(5000)}" for _ in range(150))
    texts = [edited(rnd, base, rnd.choice([0.01, 0.03])) for _ in range(120)] + [edited(rnd, base, 0.3) for _ in range(5)]
    rows = simhash.stage(simhash.sets(docs(spark, texts)).withColumn("row", F.monotonically_increasing_id()), "test")
    own = {r.doc_id: r.cls for r in rows.collect()}
    cls = {c: i for i, c in sorted(own.items(), reverse=True)}  # the first text of a class
    links = [(cls[r.a], cls[r.b]) for r in simhash.copy_links(rows, most=3000).collect()]
    up = [cls[own[i]] for i in range(len(texts))]
    for a, b in links * len(cls):
        up[a] = up[b] = min(up[a], up[b])
    up = [up[cls[own[i]]] for i in range(len(texts))]
    assert up == plain_copies(texts) and len(links) < 120 * 60


def test_any_radius_by_counters():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**64, 4, dtype=np.uint64)
    fps = np.concatenate([base[rnd.integers(0, 4, 150)], rnd.integers(0, 2**64, 150, dtype=np.uint64)])
    for k in range(150):
        for b in rnd.integers(0, 64, rnd.integers(0, 24)):
            fps[k] ^= np.uint64(1) << np.uint64(b)
    for radius in (0, 1, 3, 7, 12, 20):
        pairs = set()
        for i, j in simhash.near(fps, np.full(300, 300), radius, simhash.Forest(300)):
            pairs |= set(zip(i.tolist(), j.tolist(), strict=True))
        assert pairs == {(i, j) for j in range(300) for i in range(j) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}


def test_edges_and_survivors(spark):
    texts = ["a b c d e f", "A b c d e f", None, "", "x", "x", "y"]
    ids = [3, 3, None, 7, None, None, 5]
    copies = simhash.near_copies(docs(spark, texts, ids).withColumn("component", F.lit(1)))
    assert copies.count() == len(texts)
    rows = docs(spark, texts, ids).withColumn("h", simhash.text_hash("text"))
    kept = simhash.survivors(copies)
    left = rows.join(kept, rows.doc_id.eqNullSafe(kept.doc_id) & (rows.h == kept.text_hash), "left_semi").dropDuplicates(["doc_id", "h"]).collect()
    assert len(left) == 4 and {(r.doc_id, r.text) for r in left} >= {(7, ""), (None, "x"), (5, "y")} and [r.doc_id for r in left].count(3) == 1
    assert simhash.near_copies(docs(spark, [])).count() == 0 and simhash.survivors(simhash.near_copies(docs(spark, []))).count() == 0
    assert plain_components([1, 2], [0, 7]) == [1, 1]
