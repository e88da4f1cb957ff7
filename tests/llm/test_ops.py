import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import data
from probelake.llm import decontaminate, licenses, packing, quality, queries, secrets, simhash, token_counts, toxicity, transport_stream, url_filter
from tests.compare import assert_same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(n if ids is None else ids[n], t, "en", "s", len(t or "")) for n, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{data()}/documents.parquet")


# --- SQL ---------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, data()), queries.ORACLE_SQL[name], data())


# --- URL filter --------------------------------------------------------------


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), a, h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[2], max(fits)[1]) if fits else (None, "allow")))


def test_url_filter(spark):
    rnd = random.Random(1)
    urls = [None, "", "no scheme", "http://", "://x", "HTTP://WWW.Example.ORG", "http://example.org?q=/es/", "http://a.org/#/", "http://a.b.com/fr/x\ny://z", "http://notorg/", "http://example.org:80/en/1", "http://example.org/en/19", "http://u@example.org/es/a?b#c"]
    urls += ["http://" + ".".join(rnd.choices(["a", "example", "org", "com", "de"], k=rnd.randint(1, 5))) + rnd.choice(["", "/", "/en/1", "/en/12/x", "/es/", "/fr/", "/de/q", "/fr"]) for _ in range(300)]
    urls += ["http://" + "a." * 5000 + "org/" + "x" * 5000] * 2
    pages = spark.createDataFrame([(n if n % 7 else None, u, "x") for n, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.filter_urls(pages, url_filter.query_rules(spark)).collect()
    want = [(n if n % 7 else None, *plain_verdict(u, url_filter.QUERY_RULES)) for n, u in enumerate(urls)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert url_filter.filter_urls(pages.limit(0), url_filter.query_rules(spark)).count() == 0
    odd = spark.createDataFrame([("ÉCOLE.org", "/", "block"), ("A.Com", "/X", "block")], "host string, path string, action string")
    hosts = spark.createDataFrame([(1, "http://ÉCOLE.ORG/x"), (2, "http://école.org/"), (3, "HTTP://a.COM/X"), (4, "http://a.com/x")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(hosts, odd).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}
    assert url_filter.filter_urls(pages, url_filter.query_rules(spark).limit(0)).filter("verdict <> 'allow'").count() == 0


# --- SimHash -----------------------------------------------------------------


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    texts = [r.text for r in rows] + [None, "", " \t", "A", "a", "One two", "É É É x", rows[0].text, rows[0].text + " more", "a b " * 30000]
    ids = [r.doc_id for r in rows] + [None, 1000, 1001, None, 1003, 1004, 1005, 0, 1007, 1008]
    want = plain_components(ids, [plain_fingerprint(t) for t in texts])
    got = simhash.near_duplicates(docs(spark, texts, ids)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or -1)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, f"{plain_fingerprint(t):016x}", c) for i, t, c in zip(ids, texts, want, strict=True)), key=key)
    assert simhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_large_groups_are_cut_and_stay_exact(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for _ in range(600):
        f = rnd.choice(base)
        for _ in range(rnd.randint(1, 4)):
            f ^= 1 << rnd.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), large=8)).collect()
    of = {r.node: r.root for r in roots}
    groups = {}
    for n, s in enumerate(signed):
        groups.setdefault(of.get(s, s), set()).add(n)
    want = {}
    for n, c in enumerate(plain_components(list(range(len(fps))), fps)):
        want.setdefault(c, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_bit_slices_find_all_links_of_a_block():
    rnd = np.random.default_rng(3)
    fps = rnd.integers(0, 2**64, 5, dtype=np.uint64)[rnd.integers(0, 5, 300)]
    for k in range(300):
        for b in rnd.integers(0, 64, rnd.integers(0, 5)):
            fps[k] ^= np.uint64(1) << np.uint64(b)
    label = simhash.linked(fps, np.full(300, 300))
    want = plain_components(list(range(300)), [int(f) for f in fps])
    assert [int(x) for x in label] == want


# --- transport streams -------------------------------------------------------


def test_transport_stream_round_trip():
    rnd = random.Random(4)
    for n in [0, 1, 63, 64, 100, 170, 176, 184, 16_384, 16_385, 50_000, *[rnd.randint(0, 40_000) for _ in range(30)]]:
        payload = transport_stream.pad64(rnd.randbytes(n))
        media = transport_stream.mux(payload)
        s = transport_stream.demux(media)
        assert len(media) % 188 == 0 and b"".join(u.data for u in s.units) == payload
        assert (s.lost, s.repeated, s.bad_packets, s.bad_tables, s.programs, s.streams) == (0, 0, 0, 0, {1: 0x1000}, {256: 6})
        assert [u.pts for u in s.units] == [3600 * k for k in range(len(s.units))] and all(u.random_access and u.whole for u in s.units)


def test_transport_stream_damage():
    media = transport_stream.mux(bytes(range(256)) * 100)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    own = [i for i, p in enumerate(packets) if (p[1] & 31) << 8 | p[2] == 0x100]
    lost = transport_stream.demux(b"".join(packets[: own[5]] + packets[own[5] + 1 :]))
    assert lost.lost == 1 and not lost.units[0].whole and lost.units[1].whole
    twice = transport_stream.demux(b"".join(packets[: own[5] + 1] + packets[own[5] :]))
    assert (twice.lost, twice.repeated) == (0, 1) and b"".join(u.data for u in twice.units) == bytes(range(256)) * 100
    broken = bytearray(packets[1])
    broken[20] ^= 1
    assert transport_stream.demux(packets[0] + bytes(broken) + b"".join(packets[2:])).bad_tables == 1
    assert transport_stream.demux(b"").units == []


def test_media_query(spark):
    texts = [None, "", "é" * 33, "x" * 64, "same", "same", "long " * 30_000]
    got = sorted(transport_stream.read_media(transport_stream.write_media(docs(spark, texts))).collect())
    for r, t in zip(got, texts, strict=True):
        payload = transport_stream.pad64((t or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[4][1:] == got[5][1:] and got[0][1:] == got[1][1:]
    streams = {r.doc_id: r.media for r in transport_stream.write_media(docs(spark, texts)).collect()}
    for r in got:
        packets = [bytes(streams[r.doc_id])[i : i + 188] for i in range(0, len(streams[r.doc_id]), 188)]
        # Points that a plain look at the packets' flags finds; their PTS from the bytes of the PES header.
        want = [(i, 0x100, int.from_bytes(p[12 + 9 : 12 + 14], "big")) for i, p in enumerate(packets) if (p[1] & 31) << 8 | p[2] == 0x100 and p[3] & 0x20 and p[4] and p[5] & 0x40 and p[4] == 7]
        plain = lambda t: (t >> 33 & 7) << 30 | (t >> 17 & 0x7FFF) << 15 | t >> 1 & 0x7FFF
        points = [(x.packet, x.pid, x.pts) for x in r.entry_points]
        assert [p for p in points if packets[p[0]][4] == 7] == [(i, pid, plain(t)) for i, pid, t in want] and len(points) == max(1, -(-r.payload_bytes // 16384))
    other = transport_stream.read_media(transport_stream.write_media(docs(spark, ["abc", "abd", "abc"]))).select("feature").collect()
    assert other[0] == other[2] != other[1]
    media = transport_stream.write_media(docs(spark, texts))
    assert transport_stream.units(media).filter("doc_id = 6").count() == 10
    assert transport_stream.read_media(transport_stream.write_media(docs(spark, []))).count() == 0


# --- tokens and packing ------------------------------------------------------


def test_word_ids_equal_the_tokenizer(documents):
    from tokenizers import Tokenizer

    from probelake.llm.word_ids import WordIds

    path = queries.tokenizer_file("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), WordIds(path, cache=500)
    odd = ["a\vb\fc\td\re", "a\x1cb", "it's don't WE'LL 'S", "é́É", "word.' x", "“Q”...", "a.≠b", "ẞß İI ſK", "", "  ", "<|endoftext|> x <|ENDOFTEXT|>", "12ab34 ½²", "日本語 text,", "x.́y", "Σ ΑΣ ΑΣ."]
    for t in odd + [r.text for r in documents.select("text").collect()]:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:80]


def check_packing(rows, lengths, capacity=2048):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(x for own in places.values() for _, x in own) == sum(lengths)
    return len(places)


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = [r.text for r in documents.select("text").collect()] + [None, "", "word " * 5000, "again", "again"]
    rows = packing.pack(docs(spark, texts), path).collect()
    ids = [[*whole.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    n = check_packing(rows, [len(x) for x in ids])
    assert n <= -(-sum(map(len, ids)) // 2048) * 1.02 + 1
    assert len(rows) == sum(-(-len(x) // 2048) for x in ids)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * 2048 and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert packing.pack(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_tight(seed):
    rnd = random.Random(seed)
    kind = [lambda: rnd.randint(1, 2048), lambda: rnd.choice([683, 684, 700, 1025, 341, 20]), lambda: min(2048, 1 + int(rnd.expovariate(1 / 300))), lambda: rnd.randint(500, 700), lambda: 2048, lambda: rnd.randint(1000, 1100)][seed]
    histogram = {}
    for _ in range(3000):
        x = kind()
        histogram[x] = histogram.get(x, 0) + 1
    rows, n = packing.plan(histogram)
    filled = {}
    for length, lo, hi, first, times, place in rows:
        for i in range(hi - lo):
            filled.setdefault(first + i // times, []).append((place + i % times * length, length))
    assert sum(map(len, filled.values())) == 3000 and len(filled) == n
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    free = []  # best-fit decreasing, one by one
    for x in sorted((s for s, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [i for i, room in enumerate(free) if room >= x]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= x
        else:
            free.append(2048 - x)
    assert n <= len(free)
    assert packing.plan({}) == ([], 0)


def test_token_counts_equal_the_unigram_tokenizer(spark, documents):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = queries.tokenizer_file("piece_bpe_32k.model")
    pieces = token_counts.vocabulary(path)
    whole = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=True)
    texts = [r.text for r in documents.select("text").collect()] + ["", "  a  b ", "\n", "日本 x語", "▁a ▁", "a\tb\n\nc\n", "<0x0A> <unk>", "😀😀 é", "<s> y</s>", None]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, texts), path).collect()}
    assert got == {n: len(whole.encode(t or "").ids) for n, t in enumerate(texts)}


def test_ties_of_scores():
    from tokenizers import Tokenizer, models

    rnd = random.Random(5)
    for _ in range(200):
        pieces = [("<unk>", -9.0), *{"".join(rnd.choices("abc", k=rnd.randint(1, 4))): float(-rnd.randint(1, 3)) for _ in range(8)}.items()]
        whole, own = Tokenizer(models.Unigram(pieces, unk_id=0)), token_counts.Counter(pieces)
        for _ in range(10):
            word = "".join(rnd.choices("abcd", k=rnd.randint(1, 9)))
            assert own.segment(word)[1] == len(whole.encode(word).ids), (pieces, word)


# --- secrets -----------------------------------------------------------------


def plain_spans(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m.group(2)) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return out


SECRET_TEXTS = [
    None, "", "password=hunter22 token: 'abc' api_key = \"ABCDEFGH\"", "AKIA" + "A" * 16 + " AKIASHORT", "é token = " + "0123456789abcdef" * 2, "apikey:x passwd=PASSWORD=secret=abcdef",
    "ſecret=abcdefgh toKen=abcdefgh", "plain words only and thequickbrownfoxjumpsoverthelazydog", "x Zk3vQ9pL0tXb7YwR2mNc5HdJ8sGf1aVe x", "token=" + "a" * 50_000,
]


def test_secrets(spark, documents):
    texts = SECRET_TEXTS + [r.text for r in documents.select("text").collect()]
    order = {k: n for n, k in enumerate(secrets.KINDS)}
    found = {r.doc_id: r for r in secrets.report(docs(spark, texts)).collect()}
    for n, t in enumerate(texts):
        want = sorted(plain_spans(t or ""), key=lambda s: (s[1], order[s[0]]))
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert found[n].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t
        assert [found[n].n_assign, found[n].n_access, found[n].n_hex] == [sum(k == kind for k, *_ in want) for kind in ("assign", "access", "hex")]
        assert [s for s in found[n].spans.split(",") if s and not s.startswith("random")] == [s for s in line.split(",") if s]
    assert "random:2:34" in found[8].spans and "random" not in found[7].spans
    assert secrets.report(docs(spark, [])).count() == 0
    clean = {r.doc_id: r.text for r in secrets.redact(docs(spark, texts)).collect()}
    assert clean[0] is None and clean[2].startswith("[SECRET] token: 'abc' [SECRET]") and clean[8] == "x [SECRET] x" and not any(plain_spans(t) for t in clean.values() if t)


# --- quality, toxicity, leaks, licences --------------------------------------


def test_top_k_is_exact(spark):
    rnd = random.Random(7)
    keys = [rnd.choice([rnd.gauss(0, 1000), rnd.gauss(0, 1e-3), 5.0]) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(keys)), "doc_id long, key double")
    for k in (0, 1, 7, 1500, 2999, 3000, 4000):
        got = sorted(r.doc_id for r in quality.top_k(rows, "key", k).collect())
        least = sorted(keys, reverse=True)[k - 1] if k and k <= len(keys) else -1e9 if k else 1e9
        assert got == [i for i, x in enumerate(keys) if x >= least]
    assert quality.top_k(rows.limit(0), "key", 5).count() == 0


def test_quality_keeps_good_and_rejects_poor(spark):
    d, labels = (spark.read.parquet(f"{data('sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.resample(d, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good, poor = [i for i, q in truth.items() if q == 1], [i for i, q in truth.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in poor) <= 0.1 * len(poor)


def plain_weights(texts, held):
    """Log weights by id, with the models counted in one process."""
    c = np.ones((2, quality.BUCKETS))
    for i, t in texts.items():
        n = np.bincount(quality.buckets(t), minlength=quality.BUCKETS)
        c[0] += n
        c[1] += n if held.get(i) is False else 0
    p = np.log(c / c.sum(1, keepdims=True))
    return {i: (p[1] - p[0])[(b := quality.buckets(t))].sum() / (len(b) + 20) * 40 for i, t in texts.items()}


def test_resample_equals_brute_force(spark, documents):
    """Weights, the default number of rows and the sample, from end to end."""
    labels = spark.read.parquet(f"{data()}/labels.parquet")
    sample = quality.labelled_sample(labels, "quality").collect()
    held, label = {r.doc_id: r.held for r in sample}, {r.doc_id: r.label for r in sample}
    texts = {r.doc_id: r.text for r in documents.collect()}
    want = plain_weights(texts, held)
    noise = {r.doc_id: r.g for r in documents.select("doc_id", quality.text_hash("text").alias("h")).select("doc_id", quality.gumbel("doc_id", "h").alias("g")).collect()}
    unseen = [(want[i], label[i]) for i in texts if held.get(i)]
    k = sum(w >= quality.best_cut(*map(np.array, zip(*unseen, strict=True))) for w in want.values())
    keys = {i: want[i] + noise[i] for i in texts}
    least = sorted(keys.values(), reverse=True)[k - 1]
    got = quality.resample(documents, labels).collect()
    assert {r.doc_id for r in got} == {i for i, x in keys.items() if x >= least}
    assert all(r.log_weight == pytest.approx(want[r.doc_id], abs=1e-6) and r.key == pytest.approx(keys[r.doc_id], abs=1e-6) for r in got)


def test_samples_follow_the_weights(spark, documents):
    """Over many seeds, the first drawn comes with a probability in proportion to its weight, and the sample is not the k greatest weights."""
    labels = spark.read.parquet(f"{data()}/labels.parquet")
    rows = quality.weights(documents, labels).orderBy(F.desc("log_weight")).limit(60).select("doc_id", "text_hash", "log_weight").collect()
    table = spark.createDataFrame(rows)
    draws = table.crossJoin(spark.range(4000).withColumnRenamed("id", "seed")).withColumn("key", F.col("log_weight") + quality.gumbel("doc_id", "text_hash", seed=F.col("seed")))
    first = {r.doc_id: r["count"] for r in draws.groupBy("seed").agg(F.max_by("doc_id", "key").alias("doc_id")).groupBy("doc_id").count().collect()}
    w = np.exp([r.log_weight for r in rows])
    for r, p in zip(rows, w / w.sum(), strict=True):
        assert abs(first.get(r.doc_id, 0) - 4000 * p) <= 5 * (4000 * p * (1 - p)) ** 0.5 + 1
    got = [{r.doc_id for r in quality.resample(documents, labels, k=100, seed=s).collect()} for s in (1, 2)]
    plain_top = {r.doc_id for r in quality.weights(documents, labels).orderBy(F.desc("log_weight")).limit(100).collect()}
    assert len(got[0] ^ got[1]) > 20 and len(got[0] ^ plain_top) > 20


def test_quality_edges(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 1), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    texts = [None, "", "a b a b", "x" * 100_000]
    assert quality.resample(docs(spark, texts), labels).count() == 4
    assert quality.resample(docs(spark, texts), labels, k=2).count() == 2
    assert quality.resample(docs(spark, []), labels).count() == 0
    repeated = docs(spark, ["a b", "a b", "a b", "c"], [1, 1, None, None])
    assert quality.resample(repeated, labels, k=4).count() == 4 and quality.resample(repeated, labels, k=1).count() in (1, 2)
    clash = repeated.selectExpr("doc_id", "text", "1 AS key", "2 AS label", "3 AS held")
    assert quality.resample(clash, labels).count() == 4
    assert toxicity.classify(docs(spark, texts), labels, ["toxic"]).count() == 4
    assert toxicity.classify(docs(spark, []), labels.limit(0), ["quality", "toxic"]).count() == 0


def test_toxicity_on_held_out_labels():
    rnd = random.Random(8)
    plain_, bad = [f"w{n}" for n in range(300)], ["vile", "nasty", "awful", "foul"]
    rows = []
    for _ in range(900):
        toxic, loud = rnd.random() < 0.2, rnd.random() < 0.3
        rows.append((set(rnd.choices(plain_, k=40)) | (set(rnd.sample(bad, 2)) if toxic else set()) | ({"!!"} if loud else set()), int(loud), int(toxic)))
    y = np.array([r[1:] for r in rows])
    models, cuts = toxicity.fit_chain([r[0] for r in rows[:600]], y[:600], np.arange(600) % 5)
    right = 0
    for words, loud, toxic in rows[600:]:
        p = [models[0].probability(words, [])]
        p.append(models[1].probability(words, p))
        right += (p[0] >= cuts[0]) == loud and (p[1] >= cuts[1]) == toxic
    assert right >= 0.97 * 300


def test_lcs():
    rnd = random.Random(9)
    for _ in range(200):
        a, b = rnd.choices("abcd", k=rnd.randint(0, 15)), rnd.choices("abcd", k=rnd.randint(0, 15))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, z in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == z else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_leaks_recall_and_precision(spark):
    d, b = (spark.read.parquet(f"{data('sf0.01')}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: decontaminate.words(r.text) for r in b.collect()}
    texts = {r.doc_id: decontaminate.words(r.text) for r in d.collect()}
    rnd = random.Random(10)
    extra = {}
    for n, (i, w) in enumerate(items.items()):  # paraphrases: one word in eight left out or changed
        w = [x if rnd.random() > 0.12 else "zzz" for x in w if rnd.random() > 0.04]
        extra[10_000 + n] = " ".join(texts[n][:50] + w + texts[n + 1][:50])
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string")), b).collect()}
    brute = {(k, i) for k, w in texts.items() for i, x in items.items() if f" {' '.join(x)} " in f" {' '.join(w)} "}
    assert brute <= found
    hits = sum((10_000 + n, i) in found for n, i in enumerate(items))
    assert hits >= 0.9 * len(items)
    assert len({k for k, _ in found if k < 10_000} - {k for k, _ in brute}) <= 2


def test_leaks_edges(spark):
    benchmark = spark.createDataFrame([(1, "three short words"), (2, None), (None, "a b"), (3, ""), (4, "three short words")], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, [None, "", "xx Three, short words yy", "three short other words", "w " * 50_000]), benchmark).collect()
    assert [(r.doc_id, r.item_id, r.place) for r in got] == [(2, 1, 1)]
    assert decontaminate.find_leaks(docs(spark, []), benchmark).count() == 0
    assert decontaminate.find_leaks(docs(spark, ["x"]), benchmark.limit(0)).count() == 0


def test_a_large_benchmark_is_searched_in_parts(spark, monkeypatch):
    items = [(n, " ".join(f"w{(n * 37 + k * (n + 1)) % 400}" for k in range(50))) for n in range(12)]
    benchmark = spark.createDataFrame([*items, (99, items[0][1])], "item_id long, text string")
    texts = docs(spark, ["some other words before it " + items[n % 12][1] for n in range(15)] + ["nothing of it"])
    whole = {(r.doc_id, r.item_id, r.place) for r in decontaminate.find_leaks(texts, benchmark).collect()}
    assert {(n, n % 12) for n in range(15)} <= {(d, i) for d, i, _ in whole} and all(d < 15 for d, *_ in whole)
    own = list(decontaminate.read_parts(benchmark))
    monkeypatch.setattr(decontaminate, "MAX_SPACE", 200 * 960)  # some words and passages of four items
    parts = list(decontaminate.read_parts(benchmark))
    assert len(own) == 1 and len(parts) > 2 and sorted(i for p in parts for i, *_ in p) == list(range(12))
    monkeypatch.setattr(decontaminate, "MAX_SPACE", 10 * 200 * 960)
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 5)
    assert {(r.doc_id, r.item_id, r.place) for r in decontaminate.find_leaks(texts, benchmark).collect()} == whole


def test_shared_words_bound_the_subsequence():
    rnd = random.Random(12)
    items = [(n, own := rnd.choices([f"w{k}" for k in range(12)], k=rnd.randint(8, 40)), own[:2]) for n in range(6)]
    index = decontaminate.Index(items)
    for _ in range(60):
        ids = np.array([rnd.randint(-1, len(index.vocabulary) - 1) for _ in range(rnd.randint(1, 120))], np.int64)
        starts = np.arange(0, len(ids), decontaminate.STRIDE)
        i, q = (x.ravel() for x in np.meshgrid(np.arange(len(starts)), np.arange(len(index.of)), indexing="ij"))
        kept = index.sharing(ids, starts, i, q)
        for n, (a, b) in enumerate(zip(starts[i], q, strict=True)):
            (s, e), numbers = index.span[b], index.numbers[index.of[b]]
            near = ids[max(a - decontaminate.STRIDE, 0) : a + decontaminate.WINDOW + decontaminate.STRIDE].tolist()
            both = sum(min(near.count(w), numbers[s:e].count(w)) for w in set(numbers[s:e]))
            assert kept[n] == (both >= decontaminate.PART * (e - s))


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "MIT License\n\nReleased under the MIT License.\n" + "other words entirely " * 50),
        ("a/b/c.txt", "nothing here"),
        ("a/b/d.txt", "many plain words come first here\nLicensed under the Apache License, Version 2.0.\n" + "and some more follow after it too with others " * 3),
        ("a/x/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/x/y/z/e.txt", ""),
        ("top.txt", None),
        (None, "All rights reserved."),
        ("a/x/f.txt", "license " * 2000 + "of all"),
        ("q/r.txt", "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
        ("a/b/c.txt", "nothing here"),
    ]
    table = spark.createDataFrame([(n, p, t, "clash") for n, (p, t) in enumerate(rows)], "doc_id long, path string, text string, license string")
    got = {r.doc_id: (r.license, r.origin, r.directory, r.notices) for r in licenses.scan(table).collect()}
    assert got[0] == ("MIT", "notice", None, "MIT")
    assert got[1] == got[9] == ("MIT", "inherited", "a", "")
    assert got[2] == ("Apache-2.0", "notice", None, "Apache-2.0")
    assert got[3][:2] == ("GPL-3.0", "notice")
    assert got[4] == ("GPL-3.0", "inherited", "a/x", "")
    assert got[5][:3] == ("Proprietary", "inherited", "") and got[6][:2] == ("Proprietary", "notice")
    assert got[8][3] == "CC-BY-NC-4.0,MIT" and len(got) == len(rows)
    assert licenses.scan(table.limit(0)).count() == 0


# --- pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark):
    sf_dir = data("sf0.001")
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before, seen = now.columns, {r.doc_id: r.text for r in now.collect()}, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stage_at(step(spark, now, sf_dir), name)[0]
        after = {r.doc_id: r.text for r in now.collect()}
        assert now.columns == columns and now.count() == len(after) and set(after) <= set(before)
        seen[name], before = (before, after), after
    had, kept = seen["near-duplicates"]
    from tests.llm.test_near_copies import plain_copies

    ids = sorted(had)
    assert set(kept) == {i for n, (i, first) in enumerate(zip(ids, plain_copies([had[i] for i in ids]), strict=True)) if n == first}
    had, kept = seen["decontamination"]
    items = [" ".join(decontaminate.words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(kept) == {i for i, t in had.items() if not any(f" {x} " in f" {' '.join(decontaminate.words(t))} " for x in items)}
    had, kept = seen["secrets"]
    assert set(had) == set(kept) and all((kept[i] == t) == (not plain_spans(t)) for i, t in had.items())
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check_packing(rows, [r.length for r in rows])
    assert {r.doc_id for r in rows} == set(kept)




def test_pipeline_edges(spark, tmp_path):
    """Null and repeated ids, null texts, repeated rows, clashing columns, an empty table."""
    plain = spark.read.parquet(f"{data()}/documents.parquet").limit(30).select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, "one text without an id, quite by itself"), (None, "another text without an id, by itself too"), (0, "a second text of an id that is there"), (900, None), (901, "token=abcdef0123 and more"), (901, "token=abcdef0123 and more")], "doc_id long, text string")
    rows = plain.unionByName(odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))).withColumns({"key": F.lit(1), "row": F.lit(2), "component": F.lit("c"), "text_hash": F.lit(3)})
    for name, table in (("full", rows), ("empty", rows.limit(0))):
        table.coalesce(2).write.parquet(str(tmp_path / name / "documents.parquet"))
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{data()}/{other}.parquet").write.parquet(str(tmp_path / name / f"{other}.parquet"))
    now = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    kept = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stage_at(step(spark, now, str(tmp_path / "full")), name)[0]
        assert now.columns == rows.columns
        kept[name] = [(r.doc_id, r.text) for r in now.collect()]
    texts = [t for i, t in kept["near-duplicates"] if i is None]
    assert len(texts) == len(set(texts)) and sum(i == 901 for i, _ in kept["secrets"]) <= 1
    if (901, "token=abcdef0123 and more") in kept["decontamination"]:
        assert (901, "[SECRET] and more") in kept["secrets"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "full")).collect()} == {i for i, _ in kept["secrets"]}
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
