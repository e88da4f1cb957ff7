"""Filter interaction and source divergence against plain versions on small tables with every odd case."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from probelake.llm import divergence, filter_audit, queries
from tests.compare import assert_same
from tests.conftest import data

DOCS = "doc_id long, text string, lang string, source string, part string, failed int, term string, n long"


def plain_filters(docs, labels):
    docs = [(i, t or "", p or "") for i, t, p, *_ in docs]
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = defaultdict(Counter)
    for i, t, part in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(ws) < 200:
            fails.add("A")
        if 100 * len(set(ws)) < 50 * len(ws):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        if i is not None and i > first[t]:
            fails.add("E")
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order):
                c, bad = out[part, "".join(order), step + 1], f in fails
                c["removed"] += bad and not gone
                c["redundant"] += bad and gone
                c["unique_fails"] += fails == {f}
                c["good_lost"] += bad and not gone and i in good
                c["toxic_lost"] += bad and not gone and i in toxic
                gone |= bad
                c["kept"] += not gone
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(*k, *(int(c[n]) for n in names), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def odd_documents():
    long = " ".join(f"word{k}" for k in range(300))
    rows = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, "de"), (None, long, "en"), (None, long, None), (0, long + " #", "de"), (4, None, "en"), (5, "", "en"), (6, "a a a a", None),
        (7, "SHOUT É İ", "fr"), (8, "x\x0by\x1cz w | & *", "fr"), (-9, "b " * 1000 + "%", "fr"), (10, "\U0001f600" * 30 + " A", ""), (11, long.upper(), "en"), (5, "", "de"), (12, "w" * 200_000, "fr"),
    ]
    return [(i, t, p, f"s{i}", "x", 1, "y", 2) for i, t, p in rows]


LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (None, 1, 1), (0, 1, None), (99, 1, 1)]


def test_filters_equal_every_order_run_by_hand(spark):
    docs = odd_documents()
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    found = [(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()]
    assert len(found) == 4 * 600
    assert set(found) == plain_filters(docs, LABELS)


def test_filters_of_nothing(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0


def test_lattice_has_80_edges_and_600_steps(spark):
    docs, labels = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.edges(filter_audit.failures(docs, labels)).count() == 80
    assert filter_audit.steps(spark).count() == 600


def plain_divergence(docs, least):
    docs = [(t or "", lang or "", s or "") for t, lang, s in docs]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [(lang, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(fold))) for t, lang, s in docs]
    in_docs = Counter((lang, w) for lang, _, ws in split for w in set(ws))
    out = set()
    for lang in {x[0] for x in split}:
        kept = sorted(w for (at, w), n in in_docs.items() if at == lang and n >= least)
        counts = {s: Counter() for at, s, _ in split if at == lang}
        for at, s, ws in split:
            if at == lang:
                counts[s].update(w for w in ws if w in set(kept))

        def shares(c, kept=kept):
            total = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in counts if o != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 50)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:top])}
    return out


@pytest.mark.parametrize("light", [0, 1, 3, 100])
def test_divergence_equals_dense_sums(spark, light, monkeypatch):
    import random

    rnd = random.Random(7)
    monkeypatch.setattr(divergence, "PIECE", 16)
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["Été", "日本", "İx", "Zed"]
    docs = [(" ".join(rnd.choices(words[: rnd.choice([5, 30, 94])], k=rnd.randint(0, 25))) + rnd.choice(["", "\n7_x9", "-Ab.ab"]), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s10", "ü", None, "s4"])) for _ in range(160)]
    docs += [(None, "en", "only"), ("", "xx", "s1"), ("one two", "xx", "s2"), ("lone", "yy", None)] + [("same text here", "en", "s1")] * 5
    frame = spark.createDataFrame([(k, t, lang, s, "x", 1, "y", 2) for k, (t, lang, s) in enumerate(docs)], DOCS).repartition(6)
    got = [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(frame, least=4, light=light).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_divergence(docs, 4)


def test_divergence_of_tiles(spark, monkeypatch):
    """More groups and terms than a tile has."""
    import random

    rnd = random.Random(3)
    monkeypatch.setattr(divergence, "TILE_GROUPS", 4)
    monkeypatch.setattr(divergence, "TILE_TERMS", 8)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    docs = [(" ".join(rnd.choices(words, k=12)), "en", f"s{rnd.randint(0, 10)}") for _ in range(120)]
    frame = spark.createDataFrame([(t, lang, s) for t, lang, s in docs], "text string, lang string, source string")
    got = {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(frame, least=2, light=2).collect()}
    assert got == plain_divergence(docs, 2)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_source_divergence"])
def test_audits_match_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, data()), queries.ORACLE_SQL[name], data())
