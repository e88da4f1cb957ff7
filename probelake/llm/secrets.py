"""Secret scans: patterns, and a battery of randomness tests with false-discovery control.

Candidates of the battery are maximal runs of 20 or more of ``A-Za-z0-9+/_-`` (``=`` only
ends one, so values after ``name=`` are candidates too) outside the patterns' spans. Each
gets an inferred encoding, the smallest alphabet that holds it, and is judged twice by the
positions in that alphabet:

* Is it random? Chi-squared of the letters' counts against a uniform alphabet, the runs above
  and below the alphabet's middle, and the serial correlation of neighbours, each with its
  p-value under letters that are all alike and independent, joined by Fisher's method. A
  string with less than ``LEAST_RANDOM`` is no candidate for a secret (p = 1).
* Is it ordinary? The likelihood ratio of the corpus' own words and of chance. Words are a
  chain of letters, whose pairs are counted over all documents (also across joined words;
  words with a first capital for mixed case), and ``STRANGE`` of its letters follow no rule
  of the corpus: names, abbreviations, words of other languages. The ratio
  is a p-value: ordinary text is k times likelier by chance with a probability of 1 / k at
  most. Words that use every letter, like a pangram, stay likelier as words.

The battery's own p-values hold for random strings, so great ones are no evidence; what has
to be rejected to find a secret is "ordinary text". Hence Benjamini-Hochberg goes over the
second p-value, with weights in proportion to the length (mean one over all candidates),
and controls the false discoveries over the whole table at ``RATE``.

Where a table has little ordinary text, the letters' pairs fall back to the letters' shares
and these to chance: evidence fades, and no size of the table is treated apart.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import ROWS, arrow_rows, stage

#: Fixed patterns: kind, pattern, group whose length counts, least length.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need no match
KINDS = ("assign", "access", "hex", "random")
SHORTEST = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}=*")
_WORDS = ("passw", "secret", "token", "api")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from small to large, and the ordinary text that each is held against; the first that holds a string is its encoding.
ENCODINGS = (
    ("decimal", _DIGITS, "words"),
    ("hex", _DIGITS + "abcdef", "words"),
    ("hex_upper", _DIGITS + "ABCDEF", "words"),
    ("lower", _LOWER, "words"),
    ("upper", _UPPER, "words"),
    ("base32", _UPPER + "234567", "words"),
    ("base36", _DIGITS + _LOWER, "words"),
    ("base36_upper", _DIGITS + _UPPER, "words"),
    ("base62", _DIGITS + _UPPER + _LOWER, "names"),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/-_", "names"),
)
_SETS = [(name, set(letters), {c: i for i, c in enumerate(letters)}) for name, letters, _ in ENCODINGS]
#: Ordinary texts and their letters: words of these letters alone; ``names`` are words with a first capital, ``words`` are in lower case.
ORDINARY = (("words", _DIGITS + _LOWER), ("names", _UPPER + _LOWER + _DIGITS + "+/-_"))
#: Pairs that the letters' own shares stand for beside a letter's pairs; share of letters in ordinary text that follow no rule.
PRIOR, STRANGE = 10.0, 0.3
#: Share of false ones among the found, and of random strings that the tests against chance may lose.
RATE, LEAST_RANDOM = 0.01, 0.01


def encoding(s: str) -> tuple[str, dict[str, int]] | None:
    """Name and positions of the smallest alphabet; None if none holds the string."""
    letters = set(s)
    for name, alphabet, index in _SETS:
        if letters <= alphabet:
            return name, index
    return None


def chi_squared_tail(x: float, df: int) -> float:
    """The probability of a chi-squared variable of ``df`` degrees of freedom to exceed ``x``."""
    h = max(x, 0.0) / 2
    if df % 2:
        out, term, j = math.erfc(math.sqrt(h)), 2 * math.sqrt(h / math.pi) * math.exp(-h), 1.5
    else:
        out, term, j = 0.0, math.exp(-h), 1.0
    for _ in range(df // 2):
        out += term
        term *= h / j
        j += 1
    return min(out, 1.0)


def fisher(ps: list[float]) -> float:
    return chi_squared_tail(-2 * sum(math.log(max(p, 1e-300)) for p in ps), 2 * len(ps))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chance(v: np.ndarray, k: int) -> tuple[float, float, float]:
    """p-values of chi-squared, runs and serial correlation of positions against ``k`` letters that are all alike and independent."""
    n = len(v)
    counts = np.bincount(v, minlength=k)
    high = v >= k / 2
    changes = int((high[1:] != high[:-1]).sum())
    x = (v - (k - 1) / 2) / math.sqrt((k * k - 1) / 12)
    return (
        chi_squared_tail(k * float((counts * counts).sum()) / n - n, k - 1),
        _two_sided((changes - (n - 1) / 2) / math.sqrt((n - 1) / 4)),
        _two_sided(float((x[1:] * x[:-1]).sum()) / math.sqrt(n - 1)),
    )


class Null:
    """Ordinary text of one alphabet, as a chain of letters."""

    def __init__(self, pairs: np.ndarray, own: list[int], ends: float = 0.0):
        """``pairs``: how often each letter follows each in ordinary text; ``own``: the letters of the alphabet; ``ends``: the share of letters after which a run ends.

        What follows a letter may also lie outside the alphabet: text that keeps to few of its letters is unusual by itself.
        """
        k, kept = len(own), pairs[np.ix_(own, own)]
        single = kept.sum(axis=0)
        shares = (single + 1) / (single.sum() + k)
        follows = (kept + PRIOR * shares) / (pairs.sum(axis=1)[own][:, None] + PRIOR)
        #: Log likelihood ratio of ordinary text and of chance: of the first letter, and of each pair; ``STRANGE`` bounds what one letter can say.
        self.first = np.log((1 - STRANGE) * k * shares + STRANGE)
        self.pair = np.log((1 - STRANGE) * k * follows + STRANGE) + math.log1p(-ends)

    def p_value(self, v: np.ndarray) -> float:
        """A p-value for ordinary text: that the ratio of chance over it is so great, which has a probability of one over the ratio at most."""
        return math.exp(min(0.0, float(self.first[v[0]] + self.pair[v[:-1], v[1:]].sum())))


#: For each byte: what it is in each ordinary text, and bits for those that hold it.
_INDEX = np.zeros((len(ORDINARY), 256), np.int64)
_HOLDS = np.zeros(256, np.uint8)
for _n, (_name, _letters) in enumerate(ORDINARY):
    for _i, _c in enumerate(_letters):
        for _d in {_c} if _name == "names" else {_c, _c.upper()}:
            _INDEX[_n, ord(_d)] = _i
            _HOLDS[ord(_d)] |= 1 << _n
#: Bit of the bytes that are digits.
DIGITS = len(ORDINARY)
for _c in _DIGITS:
    _HOLDS[ord(_c)] |= 1 << DIGITS
_HOLDS[ord("=")] = 128  # part of a run, of no alphabet


def ordinary(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the ordinary text, positions) of a text's words of fewer than ``SHORTEST`` letters, joined in order; last (-1, lengths of its numbers)."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    holds = _HOLDS[b]
    edge = np.flatnonzero(np.diff(holds != 0, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return
    bounds = edge[:-1] if edge[-1] == len(b) else edge
    words = np.bitwise_and.reduceat(holds, bounds)[::2]  # the texts that hold every letter of a word
    words[ends - starts >= SHORTEST] = 0
    size = ends - starts
    letters = holds != 0
    b, first = b[letters], np.cumsum(size) - size
    mask = np.repeat(words, size)
    for n, (name, _) in enumerate(ORDINARY):
        own = mask >> n & 1 != 0
        if name == "names":
            b = b.copy()
            lower = first[(b[first] >= 97) & (b[first] <= 122)]
            b[lower] -= 32
        yield n, _INDEX[n][b[own]]
    yield -1, size[words >> DIGITS & 1 != 0]


class Sums:
    """How often each letter follows each in both ordinary texts, and the numbers there; additive."""

    def __init__(self) -> None:
        self.pairs = [np.zeros((len(letters), len(letters))) for _, letters in ORDINARY]
        self.numbers = np.zeros(2)  # runs of digits alone, and their digits

    def add(self, n: int, v: np.ndarray) -> None:
        k = len(self.pairs[n])
        self.pairs[n] += np.bincount(v[:-1] * k + v[1:], minlength=k * k).reshape(k, k)

    def nulls(self) -> dict[str, Null]:
        """By encoding. Alphabets of one case share the pairs of all words."""
        out, at = {}, {name: n for n, (name, _) in enumerate(ORDINARY)}
        for name, letters, text in ENCODINGS:
            n = at[text]
            own = [ORDINARY[n][1].index(c if text == "names" else c.lower()) for c in letters]
            # Numbers are not joined without a sign between them, so a long one is unusual by itself.
            out[name] = Null(self.pairs[n], own, (self.numbers[0] + 1) / (self.numbers[1] + 4) if name == "decimal" and self.numbers[1] else 0.0)
        return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from (t for t in batch.slice(at, ROWS).column(0).to_pylist() if t)


def fit_nulls(docs: DataFrame, text_col: str = "text") -> dict[str, Null]:
    """The ordinary texts of all documents; some 6,000 sums reach the driver, at any size."""
    schema = pa.schema([("kind", pa.int32()), ("cell", pa.int32()), ("x", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for text in _texts(batches):
            for n, v in ordinary(text):
                if n < 0:
                    sums.numbers += len(v), v.sum()
                elif len(v) > 1:
                    sums.add(n, v)
        for n, x in enumerate([*(p.ravel() for p in sums.pairs), sums.numbers]):
            cell = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(cell), pa.int32()), pa.array(cell, pa.int32()), pa.array(x[cell])], schema=schema)

    total = Sums()
    flat = [*(p.reshape(-1) for p in total.pairs), total.numbers]
    for r in docs.select(F.col(text_col)).mapInArrow(run, "kind int, cell int, x double").groupBy("kind", "cell").agg(F.sum("x").alias("x")).collect():
        flat[r.kind][r.cell] += r.x
    return total.nulls()


def battery(s: str, nulls: dict[str, Null]) -> tuple[str | None, float]:
    """The encoding, and the p-value that an ordinary string is this far from ordinary: 1 if it isn't random."""
    s = s.rstrip("=")
    found = encoding(s) if len(s) > 1 else None
    if found is None:
        return None, 1.0
    name, index = found
    v = np.fromiter((index[c] for c in s), np.int64, len(s))
    if fisher(list(chance(v, len(index)))) < LEAST_RANDOM:
        return name, 1.0
    return name, nulls[name].p_value(v)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]], nulls: dict[str, Null]) -> list[tuple[int, int, str | None, float]]:
    """(start, end, encoding, p-value) of candidates that no base span touches."""
    out, k = [], 0
    reach = [e for _, _, e in base]
    for i in range(1, len(reach)):
        reach[i] = max(reach[i], reach[i - 1])  # spans come by start
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            k += 1
        if not k or reach[k - 1] <= m.start():
            out.append((m.start(), m.end(), *battery(m.group(), nulls)))
    return out


def scan(docs: DataFrame, nulls: dict[str, Null], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans and candidates with p-values, before the threshold; a row for each row."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
         ("found", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("p", pa.float64())])))]
    )

    def run(c: dict) -> dict:
        base, found = [], []
        for t in c["text"]:
            spans = base_spans(t or "")
            base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans])
            found.append([dict(zip(("start", "end", "encoding", "p"), x, strict=True)) for x in candidates(t or "", spans, nulls)])
        return {"doc_id": c["doc_id"], "base": base, "found": found}

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        arrow_rows(run, schema), "doc_id bigint, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,encoding:string,p:double>>"
    )


def threshold(scanned: DataFrame, rate: float = RATE) -> float:
    """The greatest p-value per unit of length that weighted Benjamini-Hochberg accepts; -1 if none is.

    A candidate's weight is its length over the mean length of all candidates. The greatest
    level t with at least m * t / ``rate`` weighted p-values up to t is found by counting
    from above, exactly: each count gives the next level, until it stays.
    """
    each = scanned.select(F.explode("found").alias("x")).select((F.col("x.end") - F.col("x.start")).alias("n"), F.col("x.p").alias("p"))
    total = each.agg(F.count("*").alias("m"), F.avg("n").alias("mean")).first()
    if not total.m:
        return -1.0
    low = each.select((F.col("p") * F.lit(float(total["mean"])) / F.col("n")).alias("q")).filter(F.col("q") <= F.lit(rate))
    level = rate
    while True:
        passed = low.filter(F.col("q") <= F.lit(level)).count()
        if not passed:
            return -1.0
        if rate * passed / total.m >= level:
            return level / float(total["mean"])
        level = rate * passed / total.m


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _passes(p: Column, start: Column, end: Column, least: float) -> Column:
    return p <= F.lit(least) * (end - start)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id and ``spans``: array of (start, order, end, encoding, p), a row for each row.

    Positions are code points, ends exclusive. A null text is an empty one, an empty table
    gives no rows. Texts are scanned whole, however long. Repeated rows are each returned, and
    their candidates each count in the false-discovery control; of equal p-values all or none
    pass. Patterns' spans of different kinds may overlap; those of kind ``random`` overlap no
    other. Ids may be null; other columns are not read.
    """
    found = stage(scan(docs, fit_nulls(docs, text_col), id_col, text_col), "secrets")
    least = threshold(found, rate)
    base = F.transform("base", lambda x: F.struct(x.start.alias("start"), x.kind.alias("order"), x.end.alias("end"), F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("double").alias("p")))
    more = F.transform(F.filter("found", lambda x: _passes(x.p, x.start, x.end, least)), lambda x: F.struct(x.start.alias("start"), F.lit(3).alias("order"), x.end.alias("end"), x.encoding.alias("encoding"), x.p.alias("p")))
    return found.select("doc_id", F.array_sort(F.concat(base, more)).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span of ``text_col`` replaced by ``mark``; null texts stay null.

    The p-values are taken once for the threshold; the texts are read again, not shuffled.
    """
    nulls = fit_nulls(docs, text_col)
    least = threshold(stage(scan(docs, nulls, id_col, text_col), "secrets"), rate)

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        base = base_spans(t)
        spans = sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, _, p in candidates(t, base, nulls) if p <= least * (e - s)])
        out, at = [], 0
        for s, e in spans:
            if e <= at:
                continue
            out += [t[at:s], mark] if s >= at else []
            at = e
        return "".join(out) + t[at:] if spans else t

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([clean(t) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text_col, cleaned(F.col(text_col)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the patterns' spans), spans (all of them)."""
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x.order + 1)
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x.start.cast("string"), x.end.cast("string"))), ",")
    base = F.filter("spans", lambda x: x.order < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x.order == k)).cast("long")
    return find_secrets(docs, id_col, text_col).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
