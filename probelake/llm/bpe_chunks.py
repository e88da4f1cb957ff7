"""Byte-level BPE ids of whole texts, with chunks that documents share encoded once.

A rolling hash cuts every text into chunks whose borders depend on the bytes before them
alone, so that copied passages give the same chunks wherever they stand. Chunks that occur
more than once in the table go to a dictionary and are encoded there, once; all others are
encoded where their document is read. A document's parts are then joined: at each join the
text from the last settled word of the left side is encoded anew together with the head of
the right side, further and further, until a word of the right side begins where it does
in that side's own encoding. From there both agree, because words are found from left to
right and looking ahead less than ``MARGIN`` bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from probelake.llm.common import stage

#: Of 2 ** CUT_BITS positions one ends a chunk; the rolling hash sees the last 16 bytes; chunks of less or more bytes are joined or cut.
CUT_BITS, LEAST, MOST = 11, 256, 1 << 16
#: Bytes at the end of a text from which a word may still change; longer than any added token and any look ahead of the pattern.
MARGIN = 64
#: Bits of the filter of shared chunks (a bit each). A chunk that only meets another's bit is encoded in the dictionary too.
FILTER_BITS = 1 << 26
#: Marks the first id of a word in the arrays that parts are kept in.
FIRST = np.uint32(1 << 31)
#: Words whose ids a worker keeps; beyond it, it starts anew.
CACHE = 1_000_000
#: Bytes of texts or ids that a worker passes on at once.
OUT_BYTES = 8 << 20

_GEAR = np.frombuffer(hashlib.shake_256(b"chunk").digest(256 * 4), np.uint32)

#: Text whose classes of characters (letters, digits, spaces, others) are the same in every library: ASCII that prints, tab, line ends and Latin letters.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]*")
# The pattern of the byte-level pre-tokenizer, for plain text.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\t\n\r {_LETTER}0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data`` (UTF-8): where the hash of the last 16 bytes says so and a character ends; the last is its length."""
    a = np.frombuffer(data, np.uint8)
    h = _GEAR[a]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            g = h.copy()
            g[k:] += h[:-k] << np.uint32(k)
            h = g
    starts = np.append((a[1:] & 0xC0) != 0x80, True)
    out, last = [], 0
    for end in [*(np.flatnonzero(((h >> np.uint32(32 - CUT_BITS)) == 0) & starts) + 1).tolist(), len(data)]:
        while end - last > MOST:
            last += MOST
            while data[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if end - last >= LEAST:
            out.append(end)
            last = end
    if last < len(data):
        out.append(len(data))
    return out


def chunks(data: bytes) -> list[bytes]:
    at = [0, *cuts(data)] if data else []
    return [data[i:j] for i, j in zip(at, at[1:], strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class Encoder:
    """Ids, beginnings of words and bytes of a byte-level BPE file without a normalizer."""

    def __init__(self, path: str):
        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        spec = json.loads(self.own.to_str())
        if spec["normalizer"] or spec["post_processor"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer without a normalizer is needed")
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        if any(len(t.encode()) >= MARGIN for t in added.values()):
            raise ValueError(f"an added token has {MARGIN} bytes or more")
        self.model, self.letters = self.own.model, dict(enumerate(_byte_letters()))
        letters = {chr(c): b for b, c in self.letters.items()}
        size = self.own.get_vocab_size(with_added_tokens=True)
        self.bytes = [b""] * size
        for token, i in self.own.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = added[i].encode() if i in added else bytes(letters[c] for c in token)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.text = list(map(str, range(size)))
        self.special = re.compile("|".join(map(re.escape, added.values())) or r"(?!)")
        self.cache: dict[str, bytes] = {}

    def marked(self, text: bytes) -> np.ndarray:
        """Ids of a text, with the first of each word marked, words as the pre-tokenizer parts them."""
        plain = text.decode()
        if not _PLAIN.fullmatch(plain) or self.special.search(plain):
            found = self.own.encode(plain, add_special_tokens=False)
            ids, word = np.array(found.ids, np.uint32), np.array(found.word_ids)
            ids[np.flatnonzero(np.diff(word, prepend=-1))] |= FIRST
            return ids
        words = _WORD.findall(plain)
        if new := set(words).difference(self.cache):
            if len(self.cache) + len(new) > CACHE:
                self.cache, new = {}, set(words)
            for w in new:
                # The model alone: the word is parted already and holds no added token, so nothing else of the tokenizer applies to it.
                first, *rest = [t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))]
                self.cache[w] = array("I", [first | int(FIRST), *rest]).tobytes()
        return np.frombuffer(b"".join(map(self.cache.__getitem__, words)), np.uint32)

    def encode(self, text: bytes) -> np.ndarray:
        return self.marked(text) & ~FIRST

    def spelled(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def report(self, ids: np.ndarray) -> tuple[int, str, str]:
        """n_tokens, ids_sha256, decoded_sha256; bytes that are no character are decoded to U+FFFD."""
        listed = ids.tolist()
        data = b"".join(map(self.bytes.__getitem__, listed)).decode("utf-8", "replace").encode()
        listed = ",".join(map(self.text.__getitem__, listed)).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(data).hexdigest()


def _byte_letters() -> list[int]:
    """The code point that stands for each byte in a byte-level vocabulary: its own if it prints in Latin-1, else the next from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [b if b in printing else next(others) for b in range(256)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Joiner:
    """Joins the encodings of the parts of one text (marked ids of each), taken from left to right.

    ``open`` is text from the beginning of a word on that is settled: what lies before it is
    in ``done`` for good.
    """

    def __init__(self, enc: Encoder):
        self.enc, self.done, self.open, self.tried = enc, [], b"", 0

    def add(self, marked: np.ndarray) -> None:
        ids = marked & ~FIRST
        first = np.flatnonzero(marked & FIRST)
        at = np.concatenate([[0], np.cumsum(self.enc.size[ids])])  # bytes before each id
        if not self.open:
            self._settle(ids, first, at, 0)
        # A stretch without agreement is tried again when it has doubled, so its cost stays near its length.
        elif len(self.open) < 2 * self.tried:
            self.open += self.enc.spelled(ids)
        else:
            size = 2 * MARGIN
            while True:
                edges = first[at[first] >= size]
                end = int(edges[0]) if len(edges) else len(ids)
                agreed = self._agree(self.enc.spelled(ids[:end]), set(at[first[1:]].tolist()))
                if agreed is not None:
                    self._settle(ids, first, at, int(np.searchsorted(at, agreed)))
                    return
                if end == len(ids):
                    break
                size *= 8
            self.tried = len(self.open)
            self.open += self.enc.spelled(ids)

    def _agree(self, head: bytes, own: set[int]) -> int | None:
        """The first byte of the right side at which a word begins in both encodings; the ids before it are then done."""
        found = self.enc.marked(self.open + head)
        ids = found & ~FIRST
        first = np.flatnonzero(found & FIRST)
        at = np.concatenate([[0], np.cumsum(self.enc.size[ids])])
        shift, last = len(self.open), len(self.open) + len(head) - MARGIN
        for k in first[(at[first] > shift) & (at[first] <= last)].tolist():
            if int(at[k]) - shift in own:
                self.done.append(ids[:k])
                return int(at[k]) - shift
        return None

    def _settle(self, ids: np.ndarray, first: np.ndarray, at: np.ndarray, start: int) -> None:
        """From id ``start`` on the part's own ids hold, up to its last word that begins before the margin; the rest is open."""
        held = first[(at[first] <= at[-1] - MARGIN) & (first >= start)]
        end = int(held[-1]) if len(held) else start
        self.done.append(ids[start:end])
        self.open, self.tried = self.enc.spelled(ids[end:]), 0

    def finish(self) -> np.ndarray:
        return np.concatenate([*self.done, self.enc.encode(self.open)])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            yield i.as_py(), (t.as_py() or "").encode()


def _emit(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``OUT_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _bit(d: bytes) -> int:
    return int.from_bytes(d[:8], "little") % FILTER_BITS


def shared_filter(docs: DataFrame) -> bytes:
    """A bit for each chunk that occurs more than once in the table: FILTER_BITS / 8 bytes (8 MB), however many chunks there are.

    Digests are counted by Spark; what the driver gets are bitmaps of the places of the bits.
    """
    schema = pa.schema([("digest", pa.binary()), ("place", pa.int64())])

    def run(batches):
        return _emit(((d, _bit(d) + 1) for _, text in _texts(batches) for d in map(digest, chunks(text))), schema)

    counted = docs.mapInArrow(run, "digest binary, place bigint").groupBy("digest", "place").agg(F.count("*").alias("n")).filter("n > 1")
    maps = counted.groupBy(F.bitmap_bucket_number("place").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()  # FILTER_BITS / 32768 rows at most
    out = bytearray(FILTER_BITS // 8)
    for r in maps:
        out[(r.b - 1) * 4096 : r.b * 4096] = r.bits
    return bytes(out)


_PARTS = pa.schema([
    ("doc_id", pa.int64()), ("kind", pa.int32()), ("key", pa.binary()), ("pos", pa.int32()), ("digest", pa.binary()), ("data", pa.binary()),
    ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
])
_PARTS_SQL = "doc_id bigint, kind int, key binary, pos int, digest binary, data binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Kinds of rows of the parts: a finished document; one that is joined later; a part of it (own ids or a digest); a shared chunk.
WHOLE, JOINED, PART, CHUNK = range(4)


def _parts(path: str, shared) -> callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        enc, bits, texts, listed = encoder(path), shared.value, set(), set()
        for doc_id, text in _texts(batches):
            cut = [(c, d, b) for c in chunks(text) for d in [digest(c)] for b in [_bit(d)]]
            common = [bool(bits[b >> 3] >> (b & 7) & 1) for _, _, b in cut]
            if not any(common):
                yield doc_id, WHOLE, None, None, None, None, *enc.report(enc.encode(text))
                continue
            key = hashlib.sha256(text).digest()
            yield doc_id, JOINED, key, None, None, None, None, None, None
            if key in texts:
                continue
            texts.add(key)
            own, pos = [], 0
            for (c, d, _), is_common in zip([*cut, (b"", b"", 0)], [*common, True], strict=True):
                if not is_common:
                    own.append(c)
                    continue
                if own:
                    yield None, PART, key, pos, None, enc.marked(b"".join(own)).tobytes(), None, None, None
                    own, pos = [], pos + 1
                if c:
                    yield None, PART, key, pos, d, None, None, None, None
                    pos += 1
                    if d not in listed:
                        listed.add(d)
                        yield None, CHUNK, None, None, d, c, None, None, None

    return lambda batches: _emit(rows(batches), _PARTS)


def _dictionary(path: str) -> callable:
    schema = pa.schema([("digest", pa.binary()), ("data", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        enc, seen = encoder(path), set()
        for batch in batches:
            for d, chunk in zip(batch.column(0), batch.column(1), strict=True):
                if (d := d.as_py()) not in seen:
                    seen.add(d)
                    yield d, enc.marked(chunk.as_py()).tobytes()

    return lambda batches: _emit(rows(batches), schema)


def _join(path: str) -> callable:
    schema = pa.schema([("key", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        enc, last, joiner = encoder(path), None, None
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                if (key := key.as_py()) != last:
                    if joiner:
                        yield last, *enc.report(joiner.finish())
                    last, joiner = key, Joiner(enc)
                joiner.add(np.frombuffer(data.as_py(), np.uint32))
        if joiner:
            yield last, *enc.report(joiner.finish())

    return lambda batches: _emit(rows(batches), schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256 (of the decoded text): a row for each row.

    A null text is empty: no tokens. Ids may be null or repeat; texts, not ids, name what
    is joined, and equal texts are joined once. A very long text is one row as before; its
    stretches are encoded where it is read. Columns other than the two are not read; an
    empty table gives no rows. ``path``: a byte-level BPE file of ``tokenizers``, at the
    same place on all machines.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(shared_filter(read))
    parts = stage(read.mapInArrow(_parts(path, shared), _PARTS_SQL), "parts")
    kind = lambda k: parts.filter(F.col("kind") == k)
    whole = kind(WHOLE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    encoded = kind(CHUNK).select("digest", "data").repartition("digest").mapInArrow(_dictionary(path), "digest binary, data binary")
    # A text that many tasks have read lists its chunks once for each of them.
    uses = kind(PART).filter("digest is not null").select("key", "pos", "digest").distinct()
    own = kind(PART).filter("digest is null").select("key", "pos", "data")
    filled = own.unionByName(uses.join(encoded, "digest").select("key", "pos", "data"))
    joined = filled.repartition("key").sortWithinPartitions("key", "pos").select("key", "data").mapInArrow(_join(path), "key binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return whole.unionByName(kind(JOINED).select("doc_id", "key").join(joined, "key").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
