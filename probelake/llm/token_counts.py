"""Token counts by a unigram vocabulary, without building tokens.

An Aho-Corasick automaton lists every vocabulary piece in a word; dynamic programming
over the ends carries only the best score and its number of pieces. The rules are those
of the ``tokenizers`` Unigram model with ``Metaspace`` (a mark before every word, split
at the marks) and byte fallback: scores are doubles; a later candidate for an end wins
only if its score is strictly greater, and candidates come by start, so at equal scores
the longest last piece stays; where no single-character piece starts, an unknown
character costs the least score less 10, and counts the bytes of its character.
"""

from __future__ import annotations

import math
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import arrow_rows

MARK, PENALTY = "▁", 10.0
#: Cached words of a worker; beyond it the cache starts anew, counts stay the same. Words from ``LONG`` characters on are not cached.
CACHE, LONG = 500_000, 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, log probability) of a sentencepiece file.

    The public file has ranks for scores (the negative number of a merge), so a piece's
    probability follows Zipf's law in its rank: nothing is trained. Control pieces and
    runs of marks, which no word contains, are left out.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    ids = [i for i in ids if MARK not in sp.id_to_piece(i)[1:]]
    words = [i for i in ids if not sp.is_byte(i)]
    total = math.log(sum(1 / (2.7 + r) for r in range(len(words))))
    least = -math.log(2.7 + len(words)) - total
    out, rank = [("<unk>", least)], 0
    for i in ids:
        if sp.is_byte(i):
            out.append((sp.id_to_piece(i), least))
        else:
            out.append((sp.id_to_piece(i), -math.log(2.7 + rank) - total))
            rank += 1
    return out


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], cache: int = CACHE):
        """``pieces``: byte pieces are spelled <0x00> to <0xFF>."""
        self.bytes = all(f"<0x{b:02X}>" in dict(pieces) for b in range(256))
        self.machine = ahocorasick.Automaton()
        self.singles = set()
        for piece, score in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.singles.add(piece)
        self.machine.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        #: Where no piece holds a line break, it is an unknown character by itself and parts words like a mark.
        self.lines = self.bytes and not any("\n" in piece for piece, _ in pieces)
        self.size, self.cache, self.heads = cache, {}, {}

    def segment(self, word: str) -> tuple[float, int]:
        """Best score and number of pieces of a word that carries its mark already."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (size, score) in self.machine.iter(word):
            ends[last + 1].append((size, score))
        best: list[float | None] = [0.0] + [None] * n
        # Beside its score an end carries the pieces of its best way, and whether that ends in an unknown character, which joins the next one.
        count, unknown = [0] * (n + 1), [False] * (n + 1)
        singles, miss = self.singles, self.unknown
        for e in range(1, n + 1):
            found = ends[e]
            if len(found) > 1:
                found.sort(reverse=True)  # the earliest start first
            top, start, odd = None, 0, False
            for size, score in found:
                if (at := best[e - size]) is not None and (top is None or at + score > top):
                    top, start, odd = at + score, e - size, False
            if word[e - 1] not in singles and (at := best[e - 1]) is not None and (top is None or at + miss > top):
                top, start, odd = at + miss, e - 1, True
            best[e], unknown[e] = top, odd
            count[e] = count[start] + (1 if not odd else len(word[e - 1].encode("utf-8")) if self.bytes else not unknown[start])
        return best[n] or 0.0, count[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """Tokens and score of a text; words are cached."""
        if not text:
            return 0, 0.0
        if len(self.cache) + len(self.heads) > self.size:
            self.cache, self.heads = {}, {}
        text = text.replace(" ", MARK)
        text = text if text[0] == MARK else MARK + text
        lines = text.split("\n") if self.lines else [text]
        tokens, score = len(lines) - 1, (len(lines) - 1) * self.unknown
        for line in lines:
            head, *words = line.split(MARK)
            if head:  # follows a line break
                found = self.heads.get(head)
                if found is None:
                    found = self.segment(head)
                    if len(head) < LONG:
                        self.heads[head] = found
                score, tokens = score + found[0], tokens + found[1]
            for w in words:
                found = self.cache.get(w)
                if found is None:
                    found = self.segment(MARK + w)
                    if len(w) < LONG:
                        self.cache[w] = found
                score, tokens = score + found[0], tokens + found[1]
        return tokens, score


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score: a row for each row; a null or empty text has 0 tokens.

    ``score`` is the sum of the words' best log probabilities. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(c: dict) -> dict:
        one = counter(path)
        found = [one.count(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "n_tokens": [x[0] for x in found], "score": [x[1] for x in found]}

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(arrow_rows(run, schema), "doc_id bigint, n_tokens bigint, score double")
