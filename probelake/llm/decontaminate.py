"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of ``WINDOW`` words, every ``STRIDE``) are TF-IDF vectors over the
benchmark's words, with idf from all documents. A randomised SVD gives the latent space:
its power iterations are products of the passage matrix with a thin block, summed over
partitions. The matrix has all passages of the benchmark, which are what is looked for: of
all spaces of the same rank theirs keeps the most of them, and all of them if they are at
most ``RANK``. Documents are projected into it and have no part in it, so that it depends on no choice of them.
Pairs of passages with a latent cosine of ``COSINE`` or more, whose product is not less
than ``KEPT`` of what a copy would have, are candidates, whatever else the window holds. So
is, beside the latent space, every place that has the first ``SHORT`` words of a passage,
word for word. The longest common subsequence of the item and the words around the passage decides:

* a share of ``SURE`` or more of the item, or of one whole passage of it, is a leak;
* from ``LIKELY`` on it is one if the item's answer (its own column, else its last
  sentence) is there too.

A candidate whose passage shares too few words with the place, each counted as often as it
is in both, has no such subsequence and is left out before it; that bound is exact.

Items of fewer than ``SHORT`` words leak only word for word. A benchmark of more than
``MAX_ITEMS`` items, or whose words and passages need more than ``MAX_SPACE`` bytes, is
searched in parts, each with a latent space of its own. The documents' words become numbers
for each part; those of a benchmark of one part are written once, then counted and searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.llm.common import ROWS, stage

WINDOW, STRIDE = 32, 16
RANK, OVERSAMPLE, ITERATIONS, SEED = 224, 16, 2, 7
MAX_ITEMS = 50_000
#: Bytes of the latent vectors of a part's words and passages, which every task holds (a task of the SVD twice), and of the counts of its words by passage.
MAX_SPACE = 100_000_000
COSINE, KEPT, SURE, LIKELY, SHORT = 0.6, 0.45, 0.8, 0.6, 8
#: Share of a passage without which its item is not looked for.
PART = 0.45
#: Words whose vectors are held at once, windows that are multiplied at once, and candidates whose words are compared at once: few enough for a processor's cache.
CHUNK_WORDS, CHUNK_WINDOWS, CHUNK_PAIRS = 2048, 512, 4096
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``b``."""
    at: dict = {}
    for i, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for w in a:
        m = at.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(b) - v.bit_count()


def passages(n: int) -> list[tuple[int, int]]:
    """(start, end) of an item's passages; the last reaches its end."""
    starts = list(range(0, max(n - WINDOW, 0) + 1, STRIDE))
    if n > WINDOW and starts[-1] + WINDOW < n:
        starts.append(n - WINDOW)
    return [(s, min(s + WINDOW, n)) for s in starts]


def _indices(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    """Vocabulary numbers of a text's words; -1 for others."""
    own = words(text)
    return np.fromiter(map(vocabulary.get, own, repeat(-1)), np.int64, len(own))


def _seeds(runs: np.ndarray) -> np.ndarray:
    """A hash of each row of ``SHORT`` words."""
    own = (runs.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    own ^= own >> np.uint64(29)
    out = own[:, 0].copy()
    for i in range(1, SHORT):
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out += own[:, i]
    return out


class Index:
    """What a worker needs: vocabulary, word vectors in the latent space, query passages, items."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]]):
        self.items = items
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, t, _ in items for w in t}))}
        self.of, self.span = [], []
        for k, (_, text, _) in enumerate(items):
            if len(text) >= SHORT:
                for s in passages(len(text)):
                    self.of.append(k)
                    self.span.append(s)
        self.numbers = [[self.vocabulary[w] for w in t] for _, t, _ in items]
        self.passage_words = [frozenset(self.numbers[k][s:e]) for k, (s, e) in zip(self.of, self.span, strict=True)]
        # How often a passage has a word; the last column stands for words outside the vocabulary.
        self.counts = np.zeros((len(self.of), len(self.vocabulary) + 1), np.uint8)
        for q, (k, (s, e)) in enumerate(zip(self.of, self.span, strict=True)):
            np.add.at(self.counts[q], self.numbers[k][s:e], 1)
        self.enough = np.array([PART * (e - s) for s, e in self.span])
        self.answers = [[self.vocabulary[w] for w in a] for _, _, a in items]
        # A window with fewer words of the vocabulary has no passage's least share.
        self.least = min((int(np.ceil(PART * (e - s))) for s, e in self.span), default=0)
        self.seeds: dict[int, list[int]] = {}
        firsts = np.array([self.numbers[k][s : s + SHORT] for k, (s, _) in zip(self.of, self.span, strict=True)], np.int64).reshape(-1, SHORT)
        for q, h in enumerate(_seeds(firsts).tolist()):
            self.seeds.setdefault(h, []).append(q)
        self.seeded = np.array(sorted(self.seeds), np.uint64)
        # Whether some passage has a word as its first, second and so on; the last column stands for words outside the vocabulary.
        self.opens = np.zeros((SHORT, len(self.vocabulary) + 1), bool)
        for i in range(SHORT):
            self.opens[i, firsts[:, i]] = True
        self.short = [(k, np.array(own, np.int32).tobytes()) for k, own in enumerate(self.numbers) if 0 < len(own) < SHORT]

    def weigh(self, total: int, df: np.ndarray) -> None:
        self.idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
        self.other = float(np.log(1 + total) + 1)

    def query_rows(self) -> list[np.ndarray]:
        out = []
        for k, (s, e) in zip(self.of, self.span, strict=True):
            out.append(np.array([self.vocabulary[w] for w in self.items[k][1][s:e]], np.int64))
        return out

    def project(self, basis: np.ndarray) -> None:
        """``basis``: words by latent dimensions."""
        self.vectors = np.ascontiguousarray((self.idf[:, None] * basis).astype(np.float32))
        q = np.array([self.vectors[r].sum(0) for r in self.query_rows()], np.float32).reshape(-1, basis.shape[1])
        norm = np.linalg.norm(q, axis=1)
        self.queries = q / np.maximum(norm, 1e-9)[:, None]
        # The share of its length that a query passage keeps in the latent space; a window that
        # holds the passage keeps as much of its own, but for the words around it.
        whole = np.array([np.sqrt((self.idf[r] ** 2).sum()) for r in self.query_rows()], np.float32)
        self.kept = np.maximum(norm / np.maximum(whole, 1e-9), 1e-3)
        self.whole = whole

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window start, query passage, cosine) of a document's words."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        if not len(ids) or not len(self.queries):
            return none
        blocks = -(-len(ids) // STRIDE)
        inside = np.flatnonzero(ids >= 0)
        known = np.bincount(inside // STRIDE, minlength=blocks + 1)
        full = np.flatnonzero(known[:-1] + known[1:] >= self.least)
        if not len(full):
            return none
        energy = np.full(blocks * STRIDE, 0.0)
        energy[: len(ids)] = self.other**2
        energy[inside] = self.idf[ids[inside]] ** 2
        energy = np.append(energy.reshape(blocks, STRIDE).sum(1), 0)
        energy = energy[full] + energy[full + 1]
        use = np.zeros(blocks + 1, bool)
        use[full] = use[full + 1] = True
        inside = inside[use[inside // STRIDE]]
        sums = np.zeros((blocks + 1, self.vectors.shape[1]), np.float32)
        block = inside // STRIDE
        for at in range(0, len(inside), CHUNK_WORDS):
            part = block[at : at + CHUNK_WORDS]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sums[part[first]] += np.add.reduceat(self.vectors.take(ids[inside[at : at + CHUNK_WORDS]], axis=0), first, axis=0)
        window = sums[full] + sums[full + 1]
        square = np.einsum("ij,ij->i", window, window)
        share = np.sqrt(square / np.maximum(energy, 1e-9))
        # A window of more weight than the passage is measured by the passage: words outside the
        # benchmark, whose weight grows with the number of documents, are no reason to leave it out.
        length = np.sqrt(square)
        live = np.flatnonzero((share >= KEPT * self.kept.min()) | (length >= KEPT * (self.kept * self.whole).min()))
        found = []
        for at in range(0, len(live), CHUNK_WINDOWS):
            own = live[at : at + CHUNK_WINDOWS]
            cosine = (window[own] / np.sqrt(square[own])[:, None]) @ self.queries.T
            i, q = np.nonzero(cosine >= COSINE)
            whole = (cosine[i, q] * share[own[i]] >= KEPT * self.kept[q]) | (cosine[i, q] * length[own[i]] >= KEPT * self.kept[q] * self.whole[q])
            i, q = i[whole], q[whole]
            shared = self.sharing(ids, full[own] * STRIDE, i, q)
            i, q = i[shared], q[shared]
            found.append((full[own[i]] * STRIDE, q, cosine[i, q]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none

    def sharing(self, ids: np.ndarray, starts: np.ndarray, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of the pairs of a place (``starts[i]``) and a passage ``q``, those that share enough words for a subsequence."""
        if not len(i):
            return np.zeros(0, bool)
        new = np.concatenate([[True], i[1:] != i[:-1]])  # pairs come by place
        at, i = starts[i[new], None] + np.arange(-STRIDE, WINDOW + STRIDE), np.cumsum(new) - 1
        padded = np.concatenate([np.full(STRIDE, -1), ids, np.full(WINDOW + 2 * STRIDE, -1)])
        near = padded.take(at + STRIDE)
        near.sort(axis=1)
        # The word's number among equal ones: a passage that has the word more often shares it.
        place = np.arange(near.shape[1], dtype=np.int8)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        times = (place - np.maximum.accumulate(np.where(fresh, place, np.int8(0)), axis=1)).astype(np.uint8)
        width = self.counts.shape[1]
        near[near < 0] = width - 1
        flat, keep = self.counts.ravel(), np.zeros(len(i), bool)
        for a in range(0, len(i), CHUNK_PAIRS):
            r, p = i[a : a + CHUNK_PAIRS], q[a : a + CHUNK_PAIRS]
            own = flat.take(near.take(r, axis=0) + (p * width)[:, None])
            keep[a : a + CHUNK_PAIRS] = np.count_nonzero(own > times.take(r, axis=0), axis=1) >= self.enough[p]
        return keep

    def verbatim(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, query passage, 1) of places with the first words of a passage."""
        found: list[tuple[int, int]] = []
        if len(ids) >= SHORT and len(self.seeded):
            places = np.arange(len(ids) - SHORT + 1)
            for i in range(SHORT):
                places = places[self.opens[i][ids[places + i]]]
            hashes = _seeds(ids[places[:, None] + np.arange(SHORT)])
            at = np.minimum(np.searchsorted(self.seeded, hashes), len(self.seeded) - 1)
            for n in np.flatnonzero(self.seeded[at] == hashes).tolist():
                i = int(places[n])
                for q in self.seeds[int(hashes[n])]:
                    s = self.span[q][0]
                    if ids[i : i + SHORT].tolist() == self.numbers[self.of[q]][s : s + SHORT]:
                        found.append((i, q))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1], np.ones(len(pairs), np.float32)

    def leaks(self, text: str | None) -> list[tuple[int, float, float, int, bool]]:
        """(item number, cosine, share, first word of the place, answer there) of a text's leaks, one for each item."""
        return self.leaks_of(_indices(text, self.vocabulary))

    def leaks_of(self, ids: np.ndarray) -> list[tuple[int, float, float, int, bool]]:
        """The same of the numbers of a text's words."""
        start, query, cosine = (np.concatenate(x) for x in zip(self.candidates(ids), self.verbatim(ids), strict=True))
        out: dict[int, tuple[float, float, int, bool]] = {}
        tried: dict[tuple[int, int], tuple[float, bool]] = {}
        for i in np.lexsort((start, -cosine)).tolist():
            k, (s, e) = self.of[query[i]], self.span[query[i]]
            numbers, answer = self.numbers[k], self.answers[k]
            place = int(start[i]) - s
            key = (k, place // STRIDE)
            # Where the item was looked for already, another passage can still be there as a whole.
            least = SURE if key in tried else PART
            if k in out and out[k][1] >= 1 or key in tried and e - s < STRIDE:
                continue
            # The passage first: without a good share of it the item cannot be there.
            own = self.passage_words[query[i]]
            near = [w for w in ids[max(start[i] - STRIDE, 0) : start[i] + WINDOW + STRIDE].tolist() if w in own]
            if len(near) < least * (e - s) or (part := lcs(near, numbers[s:e]) / (e - s)) < least:
                continue
            if key not in tried:
                region = ids[max(place - STRIDE, 0) : place + len(numbers) + 2 * STRIDE].tolist()
                tried[key] = lcs(region, numbers) / len(numbers), not answer or lcs(region, answer) >= LIKELY * len(answer)
            share, there = tried[key]
            if share >= SURE or part >= SURE and e - s >= STRIDE or share >= LIKELY and there:
                share = max(share, part)
                if k not in out or share > out[k][1]:
                    out[k] = (float(cosine[i]), share, max(place, 0), there)
        if self.short:
            whole, size = ids.astype(np.int32).tobytes(), np.dtype(np.int32).itemsize
            for k, item in self.short:
                at = whole.find(item)
                while at > 0 and at % size:
                    at = whole.find(item, at + 1)
                if at >= 0:
                    out[k] = (1.0, 1.0, at // size, True)
        return [(k, *v) for k, v in sorted(out.items())]


Item = tuple[int, list[str], list[str]]


def read_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None) -> Iterator[list[Item]]:
    """The items in parts of about ``MAX_ITEMS`` at most, read one by one; items of the same text are in one part. One part at least, which may be empty."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), answer.alias("answer")).dropna(subset=["id", "text"])
    texts = rows.groupBy("text").agg(F.min(F.struct("id", "answer")).alias("first")).select("first.id", "text", "first.answer")
    n = max(1, -(-texts.count() // MAX_ITEMS))
    for k in range(n):
        yield from in_space(read_items(texts.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k), "id", "text", "answer" if answer_col else None))


def in_space(items: list[Item]) -> Iterator[list[Item]]:
    """The items in parts that need at most ``MAX_SPACE`` bytes; one that needs more is a part of its own."""
    part: list[Item] = []
    seen: set[str] = set()
    held = 0
    for item in items:
        more = len(passages(len(item[1]))) if len(item[1]) >= SHORT else 0
        n = len(seen) + len(set(item[1]) - seen)
        if part and max(4 * (RANK + OVERSAMPLE) * (n + held + more), n * (held + more)) > MAX_SPACE:
            yield part
            part, seen, held = [], set(), 0
        part.append(item)
        seen.update(item[1])
        held += more
    yield part


def read_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None) -> list[Item]:
    """(id, words, words of the answer), without null or wordless items; the same text counts once, with its smallest id."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), answer.alias("answer")).dropna(subset=["id", "text"]).collect()
    out: dict[str, tuple] = {}
    for r in sorted(rows, key=lambda r: r.id):
        own = words(r.text)
        if own and r.text not in out:
            if answer_col:
                last = [w for w in words(r.answer) if w in set(own)]
            else:
                last = next((w for x in reversed(re.split(r"[.!?]\s", r.text.strip())) if len(w := words(x)) > 1), [])
            out[r.text] = (r.id, own, last)
    return list(out.values())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS).to_pydict()


def numbered(slim: DataFrame, vocabulary: dict[str, int], more: list[str]) -> DataFrame:
    """``slim`` (doc_id, text, more) with the numbers of each text's words in place of it: bytes of 16 bits each, or 32 if the vocabulary is large."""
    shared = slim.sparkSession.sparkContext.broadcast(vocabulary)
    kept, kind = ["doc_id", *more], _kind(len(vocabulary))
    schema = pa.schema([*[(c, pa.int64()) for c in kept], ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _slices(batches):
            yield pa.RecordBatch.from_pydict({**{k: c[k] for k in kept}, "ids": [_indices(t, shared.value).astype(kind).tobytes() for t in c["text"]]}, schema=schema)

    return slim.select(*kept, "text").mapInArrow(run, "".join(f"`{k}` bigint, " for k in kept) + "ids binary")


def _kind(words: int) -> type:
    return np.int16 if words < 1 << 15 else np.int32


def _read(ids: bytes, words: int) -> np.ndarray:
    return np.frombuffer(ids, _kind(words)).astype(np.int64)


def frequencies(rows: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Number of rows, and of those with each of the ``n`` words. ``rows``: ids."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for c in _slices(batches):
            for own in c["ids"]:
                ids = _read(own, n)
                ids = ids[ids >= 0]
                places = np.arange(len(ids))
                last[ids] = places
                count[ids[last[ids] == places]] += 1  # each word at its last place alone
            count[-1] += len(c["ids"])
        yield pa.RecordBatch.from_arrays([pa.array(at := np.flatnonzero(count)), pa.array(count[at])], schema=schema)

    out = np.zeros(n + 1, np.int64)
    for r in rows.select("ids").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return int(out[-1]), out[:-1]


def _thin_product(rows: DataFrame, index: Index, block: np.ndarray) -> np.ndarray:
    """A'(A B) for the passage matrix A of ``rows`` (arrays of word numbers), summed over partitions."""
    shared = rows.sparkSession.sparkContext.broadcast((index.idf, block.astype(np.float32)))
    n, width = block.shape
    schema = pa.schema([("sum", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, b = shared.value
        weighted = idf[:, None] * b
        out, any_ = np.zeros((n, width), np.float32), False
        for c in _slices(batches):
            for ids in c["ids"]:
                w, times = np.unique(np.array(ids, np.int64), return_counts=True)
                if len(w):
                    norm = np.sqrt(((times * idf[w]) ** 2).sum())
                    y = (times[:, None] * weighted[w]).sum(0) / norm
                    out[w] += (times * idf[w] / norm)[:, None] * y
                    any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], schema=schema)

    total = np.zeros((n, width))
    for r in rows.mapInArrow(run, "sum binary").toLocalIterator():  # one block for each of a few partitions
        total += np.frombuffer(bytes(r["sum"]), np.float32).reshape(n, width)
    shared.unpersist()
    return total


def latent_space(spark: SparkSession, index: Index, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (words by dimensions) of the TF-IDF matrix of all passages of the benchmark."""
    n, own = len(index.vocabulary), index.query_rows()
    if not own:
        return np.zeros((n, 1))
    rows = spark.createDataFrame([(r.tolist(),) for r in own], "ids array<bigint>").coalesce(2).cache()
    width = min(n, len(own), rank + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, width)))[0]
    for _ in range(ITERATIONS):
        q = np.linalg.qr(_thin_product(rows, index, q))[0]
    small = q.T @ _thin_product(rows, index, q)
    rows.unpersist()
    value, vector = np.linalg.eigh((small + small.T) / 2)
    # Dimensions that no passage has (repeated passages) would be any directions.
    best = [i for i in np.argsort(-value)[:rank] if value[i] > 1e-5 * value.max()]
    return q @ vector[:, best]


def build_index(slim: DataFrame, items: list[Item], more: list[str], write: bool) -> tuple[Index, DataFrame]:
    """The index of the items, and the numbers of all documents' words, which are written if asked for. ``slim``: doc_id, text and ``more``."""
    index = Index(items)
    rows = numbered(slim, index.vocabulary, more)
    if write:
        rows = stage(rows, "numbers")
    index.weigh(*frequencies(rows, len(index.vocabulary)))
    index.project(latent_space(slim.sparkSession, index))
    return index, rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", answer_col: str | None = None, more: list[str] | None = None) -> DataFrame:
    """doc_id, item_id, cosine, share, place (number of the first word), answer: a row for each document and item it holds.

    Null and wordless texts and items hold nothing, an empty table has no leaks. Repeated
    rows are each reported; texts are searched whole. Of items with the same text the one with
    the smallest id is named; of equal shares in one text the candidate of the greater cosine,
    then of the earlier place. ``more``: whole-number columns that are carried along; others
    are not read.
    """
    more = more or []
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    of = read_parts(benchmark, answer_col=answer_col)
    first = list(islice(of, 2))
    # Many parts' numbers would fill the disk; they are made again where they are read.
    parts = [_search(*build_index(slim, items, more, write=len(first) == 1), more) for items in chain(first, of)]
    return reduce(DataFrame.unionAll, parts)


def _search(index: Index, numbers: DataFrame, more: list[str]) -> DataFrame:
    """The leaks of one part of the benchmark's items."""
    shared = numbers.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64()), ("place", pa.int64()), ("answer", pa.bool_()), *[(m, pa.int64()) for m in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for c in _slices(batches):
            rows = [(d, own.items[k][0], *rest, *with_) for d, ids, *with_ in zip(c["doc_id"], c["ids"], *[c[m] for m in more], strict=True) for k, *rest in own.leaks_of(_read(ids, len(own.vocabulary)))]
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(schema.names)}, schema=schema)

    return numbers.mapInArrow(run, "doc_id bigint, item_id bigint, cosine double, share double, place bigint, answer boolean" + "".join(f", `{m}` bigint" for m in more))
