"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints stand in blocks of 64 lanes whose 64 bit planes are stored vertically; a
fingerprint meets a block plane by plane, with 64 distances kept in carry-save counters,
and leaves it once all are beyond the radius. Each partition reports a spanning forest of
its links, never all pairs of a group; the forests are joined into components by
alternating star contraction on DataFrames. What meets is decided beforehand:

* ``near_duplicates`` links fingerprints at most ``RADIUS`` (3) bits apart. Of two such, one of
  four quarters is equal, so groups agree on a quarter of the bits; a group that is still
  large is cut again by quarters of its remaining bits. Nothing is capped.
* ``near_copies`` links texts of a Jaccard similarity of ``SIMILARITY`` of their word shingles.
  Their fingerprints lie some 10 bits apart, too far for equal quarters. Texts with equal
  sets of shingles are one class; classes meet in groups that agree on two minima of their
  shingles' hashes (``BANDS`` times); fingerprints within ``WIDE`` bits are candidates, and the
  sets themselves decide. Large groups are cut into blocks that meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import arrow_rows, remove, stage, stage_at, text_hash

RADIUS, SEED, SHINGLE = 3, 42, 3
#: A group of more fingerprints is cut by a quarter of its remaining bits.
LARGE_GROUP = 16_384
#: Widths of the keys' bits: 64, then what a quarter less leaves.
WIDTHS = (64, 48, 36)
#: Rows from which a fingerprint counts as common.
COMMON = 1000
#: (fingerprint, block) comparisons held at once.
PAIRS = 8192
#: Near copies: words of a shingle, similarity, groups of a text, bits apart at most (a pair of
#: similarity 0.8 shares no group with a probability of 0.002, and is further apart with 0.0005).
SIZE, SIMILARITY, BANDS, WIDE = 5, 0.8, 6, 20
#: Shingles of a group that one task holds, about (4 bytes each); a group of more is cut into blocks.
BLOCK_SHINGLES = 4_000_000
#: Components up to this number (some 80 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, and white space of ASCII
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][: len(words) - size + 1]
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes; 0 without words."""
    h = shingle_hashes(text, size)
    return majority(h) if len(h) else 0


def majority(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and signed 64-bit ``fp``, a row for each row; a null text is an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(c: dict) -> dict:
        return {"doc_id": c["doc_id"], "fp": np.array([fingerprint(t) for t in c["text"]], np.uint64).view(np.int64)}

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(arrow_rows(run, schema), "doc_id bigint, fp bigint")


class Forest:
    """Labels of positions; union() joins pairs and keeps the smallest position of a set as its label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def find(self, i: int) -> int:
        up = self.label
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.label[i], self.label[j]], 1), axis=0)
        for a, b in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
            a, b = self.find(a), self.find(b)
            if a != b:
                self.label[max(a, b)] = min(a, b)
        self.flatten()

    def flatten(self) -> None:
        while True:
            up = self.label[self.label]
            if (up == self.label).all():
                return
            self.label = up


def planes(fps: np.ndarray) -> np.ndarray:
    """Blocks of 64 fingerprints to (blocks, 64) words: bit k of word p is bit p of lane k."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")  # block, lane, bit
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little")).view(np.uint64)[..., 0]


def near(fps: np.ndarray, ends: np.ndarray, radius: int, forest: Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of fingerprints at most ``radius`` bits apart, in parts, but for some pairs of one label.

    ``ends``: for each position the end of its group, which is contiguous. Pairs across groups
    that share a block may come as well; they are real. Labels may be joined between parts.
    """
    n = len(fps)
    blocks = -(-n // 64)
    fill = np.repeat(n - 1, blocks * 64 - n)
    plane = planes(np.concatenate([fps, fps[fill]]))
    masks = np.where(np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), np.uint64(2**64 - 1), np.uint64(0))
    first, last = (np.arange(n) + 1) // 64, (ends - 1) // 64
    reach = np.where(ends > np.arange(n) + 1, last - first + 1, 0)
    stops = np.cumsum(reach)
    # Counters of ``width`` bits start so high that they run over when the distance passes the radius.
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    at = 0
    while at < n:
        to = max(int(np.searchsorted(stops, (stops[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        count = reach[at:to]
        q = np.repeat(np.arange(at, to), count)
        b = first[q] + np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
        at = to
        if not len(q):
            continue
        lanes = np.concatenate([forest.label, forest.label[fill]]).reshape(-1, 64)
        whole = (lanes == lanes[:, :1]).all(axis=1)
        keep = ~(whole[b] & (lanes[b, 0] == forest.label[q]))  # blocks within the fingerprint's own set need no look
        q, b = q[keep], b[keep]
        counters = [np.full(len(q), 2**64 - 1 if start >> t & 1 else 0, np.uint64) for t in range(width)]
        more = np.zeros(len(q), np.uint64)  # lanes whose distance passed the radius
        for p in range(64):
            carry = plane[b, p] ^ masks[q, p]
            for t, c in enumerate(counters):
                counters[t], carry = c ^ carry, c & carry
            more |= carry
            if p % 8 == 7:
                live = more != np.uint64(2**64 - 1)
                if not live.all():
                    q, b, more, counters = q[live], b[live], more[live], [c[live] for c in counters]
                    if not len(q):
                        break
        if not len(q):
            continue
        k, lane = np.nonzero(np.unpackbits((~more).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = q[k], b[k] * 64 + lane
        right = (j < n) & (j > i)
        yield i[right], j[right]


def linked(fps: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Labels of positions: linked fingerprints of a group, and through others, have one label."""
    forest = Forest(len(fps))
    if len(fps) > 1:
        for i, j in near(fps, ends, radius, forest):
            forest.union(i, j)
    return forest.label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) in order of key to edges (a, b); rows of a key are held together, in blocks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        ends = np.repeat(np.concatenate([starts[1:], [len(k)]]), np.diff(np.concatenate([starts, [len(k)]])))
        label = linked(f.view(np.uint64), ends)
        own = np.flatnonzero(label != np.arange(len(f)))
        own = own[f[own] != f[label[own]]]
        return pa.RecordBatch.from_arrays([pa.array(f[own]), pa.array(f[label[own]])], schema=schema)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        k = batch.column(0)
        if sum(x.num_rows for x in held) < 16_384 or held[0].column(0)[0].as_py() == k[len(k) - 1].as_py():
            continue  # too few, or all of one key as yet
        keys, fps = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1))
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        yield edges(keys[:cut], fps[:cut])
        held = [pa.RecordBatch.from_arrays([pa.array(keys[cut:]), pa.array(fps[cut:])], names=["key", "fp"])]
    if held:
        yield edges(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1)))


def _quarter(rest: Column, width: int, c: int) -> tuple[Column, Column]:
    """Quarter ``c`` of the ``width`` low bits of ``rest``, and the other bits."""
    q = width // 4
    turned = rest
    if c:
        turned = F.shiftleft(rest, q * c).bitwiseOR(F.shiftrightunsigned(rest, width - q * c))
    keep = (1 << (width - q)) - 1
    top = F.shiftrightunsigned(turned, width - q).bitwiseAND((1 << q) - 1)
    return top, turned.bitwiseAND(keep)


def _keyed(rows: DataFrame, width: int) -> DataFrame:
    """Each row (key, fp, rest) four times, under its key and one quarter of rest."""
    parts = []
    for c in range(4):
        top, rest = _quarter(F.col("rest"), width, c)
        parts.append(F.struct(F.xxhash64("key", F.lit(c), top).alias("key"), rest.alias("rest")))
    return rows.select("fp", F.explode(F.array(*parts)).alias("k")).select("k.key", "fp", "k.rest")


def links(distinct_fps: DataFrame, large: int = LARGE_GROUP) -> DataFrame:
    """Edges (a, b) that span the same components as all links between the different fingerprints ``fp``."""
    rows = _keyed(distinct_fps.select(F.lit(0).cast("long").alias("key"), "fp", F.col("fp").alias("rest")), WIDTHS[0])
    ready = []
    for width in WIDTHS[1:]:
        hot = rows.groupBy("key").count().filter(F.col("count") > large).select("key")
        ready.append(rows.join(hot, "key", "left_anti").select("key", "fp"))
        rows = _keyed(rows.join(hot, "key", "left_semi"), width)
    out = rows.select("key", "fp")
    for part in ready:
        out = out.unionByName(part)
    n = int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartition(n, "key").sortWithinPartitions("key")
    return out.mapInArrow(_links, "a bigint, b bigint").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge (a, b); root: the smallest node of its component.

    Large-star and small-star in turn until nothing changes; both are joins with the
    nodes' smallest neighbours, so a node with many neighbours is never gathered.
    """
    # Both ends of an edge differ; u > v throughout.
    spark = edges.sparkSession
    now, path = stage_at(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        now, after = stage_at(small, "edges")
        remove(spark, path)
        path = after
        state = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE_GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach), a row for each row.

    Texts without words (null, empty) have fingerprint 0 and link like any other. A null
    id keeps its row and never counts as smallest; a component of null ids has a null id.
    Repeated rows are each returned. Other columns of ``docs`` are not read.
    """
    prints = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    ids = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "groups")
    roots = components(links(ids.select("fp"), large))
    named = ids.join(roots, ids.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stage(named.join(least, "root").select("fp", "component_id", "n"), "names")
    # Copies of one text all have one fingerprint: the few common ones are broadcast, so that no
    # task gets all rows of one; the others are joined by shuffle.
    common = of.filter(F.col("n") >= COMMON)
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    known = prints.join(F.broadcast(common.select("fp", F.struct("component_id").alias("c"))), "fp", "left") if common.count() <= BROADCAST_ROWS else prints.withColumn("c", F.lit(None).cast("struct<component_id:bigint>"))
    first = known.filter("c is not null").select("doc_id", text, "c.component_id")
    rest = known.filter("c is null").join(of, "fp").select("doc_id", text, "component_id")
    return first.unionByName(rest)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, cls (digest of the set of shingles), fp, n, shingles (sorted, 4 bytes each), keys; a row for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("cls", pa.string()), ("fp", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary()), ("keys", pa.list_(pa.int64()))])
    by = _multipliers()[:, None]

    def run(c: dict) -> dict:
        out = {"doc_id": c["doc_id"], "text_hash": c["text_hash"], "cls": [], "fp": [], "n": [], "shingles": [], "keys": []}
        for t in c["text"]:
            h = shingle_hashes(t, size)
            own = np.unique(h)
            low = np.unique((own & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            keys = []
            if len(own):
                least = np.full(2 * BANDS, np.uint64(2**64 - 1))
                for at in range(0, len(own), 65_536):
                    np.minimum(least, (own[at : at + 65_536] * by).min(axis=1), out=least)
                keys = [xxhash.xxh64_intdigest(least[2 * k : 2 * k + 2].tobytes(), k) for k in range(BANDS)]
            out["cls"].append(xxhash.xxh3_128_hexdigest(own.tobytes()))
            out["fp"].append(majority(h) if len(h) else 0)
            out["n"].append(len(low))
            out["shingles"].append(low.tobytes())
            out["keys"].append(np.array(keys, np.uint64).view(np.int64).tolist())
        out["fp"] = np.array(out["fp"], np.uint64).view(np.int64)
        return out

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return slim.mapInArrow(arrow_rows(run, schema), "doc_id bigint, text_hash bigint, cls string, fp bigint, n bigint, shingles binary, keys array<bigint>")


def similar(fps: np.ndarray, own: list[np.ndarray], block: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Links that span the components of all pairs of the sets ``own`` with the similarity; of two blocks only pairs across."""
    n = len(fps)
    forest = Forest(n)
    across = len(set(block.tolist())) > 1
    size = np.array([len(x) for x in own])
    stops = np.cumsum(size)
    local = np.unique(np.concatenate(own), return_inverse=True)[1]
    mark = np.zeros(len(local) + 1, bool)
    for i, j in near(fps, np.full(n, n), WIDE, forest):
        fits = (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])) & (forest.label[i] != forest.label[j])
        if across:
            fits &= block[i] != block[j]
        i, j = i[fits], j[fits]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else ():
            a = int(i[part[0]])
            mine = local[stops[a] - size[a] : stops[a]]
            mark[mine] = True
            for at in range(0, len(part), 256):
                others = j[part[at : at + 256]]
                others = others[forest.label[others] != forest.label[a]]
                if not len(others):
                    continue
                taken = np.concatenate([local[stops[x] - size[x] : stops[x]] for x in others.tolist()])
                both = np.add.reduceat(mark[taken].astype(np.int64), np.cumsum(size[others]) - size[others])
                for x in others[both >= similarity * (size[a] + size[others] - both) - 1e-9].tolist():
                    if forest.label[x] != forest.label[a]:
                        forest.union(np.array([a]), np.array([x]))
                        yield a, x
            mark[mine] = False


def _similar(similarity: float):
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def links() -> pa.RecordBatch:
            found = []
            if len(held) > 1:
                cls, fps, block, own = zip(*held, strict=True)
                found = [(cls[a], cls[b]) for a, b in similar(np.array(fps, np.int64).view(np.uint64), [np.frombuffer(x, np.uint32) for x in own], np.array(block), similarity)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], schema=schema)

        for batch in batches:
            for *of, cls, fp, block, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != key:
                    yield links()
                    held, key = [], of
                held.append((cls, fp, block, own))
        yield links()

    return run


def copy_links(rows: DataFrame, similarity: float = SIMILARITY, most: int = BLOCK_SHINGLES) -> DataFrame:
    """Edges (a, b) that span the same components as all links between different classes. ``rows``: a staged table of row, cls, fp, n, keys, shingles."""
    classes = stage(rows.filter("n > 0").groupBy("cls").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("fp", "n", "keys")]), "classes")  # equal in a class
    keyed = classes.select("cls", "n", F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("weight")).filter("members > 1").select("key", F.ceil(F.col("weight") / most).cast("int").alias("blocks"))
    # Most groups have one class; only the classes of others carry their sets along, from one of their rows.
    met = keyed.join(groups, "key").select("cls", F.struct("key", "blocks").alias("g")).groupBy("cls").agg(F.collect_list("g").alias("groups"))  # BANDS at most
    own = F.pmod(F.xxhash64("cls"), F.col("g.blocks")).cast("int")
    meeting = classes.select("cls", "row", "fp").join(met, "cls").join(rows.select("row", "shingles"), "row").select("cls", "fp", "shingles", F.explode("groups").alias("g")).withColumn("block", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("g.blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi")))
    dealt = meeting.select(F.col("g.key").alias("key"), F.explode(pairs).alias("p"), "cls", "fp", "block", "shingles").select("key", "p.lo", "p.hi", "cls", "fp", "block", "shingles")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cls").mapInArrow(_similar(similarity), "a string, b string").distinct()


def near_copies(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, component: texts linked by the Jaccard similarity of their sets of ``size``-word shingles, a row for each row.

    ``component`` is a digest that the rows of one component share. A text of fewer words is
    one shingle; texts without words (null, empty) are copies of each other. Ids may be null or
    repeated; an empty table gives no rows; texts count whole. Other columns are not read.
    """
    rows = stage(sets(docs, size, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sets")
    roots = components(copy_links(rows, similarity)).select(F.col("node").alias("cls"), "root")
    if roots.count() <= BROADCAST_ROWS:
        roots = F.broadcast(roots)
    return rows.select("doc_id", "text_hash", "cls").join(roots, "cls", "left").select("doc_id", "text_hash", F.coalesce("root", "cls").alias("component"))


def survivors(copies: DataFrame) -> DataFrame:
    """doc_id, text_hash of the row of each component that stays: the smallest id (null last), then the smallest text hash."""
    return copies.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("s")).select("s.doc_id", "s.text_hash")
