"""Best-fit packing with the linear grouping scheme.

Lengths are whole numbers up to the capacity, so the whole table is planned from its
histogram (at most ``capacity`` numbers on the driver, at any size of the table):

1. Large lengths are sorted and cut into groups of equal cardinality, each rounded up to
   its largest; the few sizes left make a configuration programme, solved by column
   generation.
2. Whole multiples of the configurations become sequences; the actual lengths are put in
   for the rounded ones, which leaves gaps.
3. The rest of the large lengths and the small ones fill the gaps best-fit, longest first.

Sequences with equal contents are kept as runs, so the plan has thousands of rows, not
one per document. Documents then find their places by their rank among equal lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelake.llm.common import arrow_rows, stage
from probelake.llm.word_ids import word_ids

CAPACITY = 2048
#: (share of the capacity over which a length is large, groups), tried in turn until no plan can have fewer sequences.
TRIALS = ((1 / 2, 48), (1 / 3, 48), (1 / 4, 96), (1 / 8, 96))
#: Pieces of a length that one rank window holds, about.
RANK_ROWS = 1000
MAX_PLAN = 1_000_000


@dataclass
class Run:
    """``n`` sequences with the same lengths: items are (length, number in each, offset)."""

    n: int
    room: int
    items: tuple

    def put(self, n: int, length: int, times: int) -> Run:
        return Run(n, self.room - times * length, (self.items, (length, times, self.room)))


class Bins:
    """Runs by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.at = capacity, [], {}

    def add(self, run: Run) -> None:
        if run.n:
            if run.room not in self.at:
                insort(self.rooms, run.room)
                self.at[run.room] = deque()
            self.at[run.room].append(run)

    def take(self, length: int) -> Run:
        """A run with the least room that fits; a new one of one sequence if none does (``n`` 0: as many as wanted)."""
        k = bisect_left(self.rooms, length)
        if k == len(self.rooms):
            return Run(0, self.capacity, ())
        room = self.rooms[k]
        run = self.at[room].popleft()
        if not self.at[room]:
            del self.at[room], self.rooms[k]
        return run

    def place(self, length: int, count: int) -> None:
        """``count`` items of one length, best-fit: into the tightest sequence for as long as it fits."""
        while count:
            run = self.take(length)
            times = run.room // length
            n = run.n or -(-count // times)
            full = min(n, count // times)
            self.add(run.put(full, length, times))
            count -= full * times
            if full < n:
                if count:
                    self.add(run.put(1, length, count))
                    n, count = n - 1, 0
                if run.n:
                    self.add(Run(n - full, run.room, run.items))

    def runs(self) -> list[Run]:
        return [r for q in self.at.values() for r in q]


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value; sizes are large, so few fit."""
    use = np.flatnonzero(values > 1e-12)
    counts = np.zeros(len(sizes))
    if not len(use):
        return 0.0, counts
    s, v = sizes[use], values[use]
    best, picks = np.zeros(capacity + 1), []
    index = np.arange(capacity + 1)[None, :] - s[:, None]
    fits = index >= 0
    for _ in range(int(capacity // s.min())):
        value = np.where(fits, best[np.maximum(index, 0)] + v[:, None], -1.0)
        pick = value.argmax(0)
        new = value[pick, np.arange(capacity + 1)]
        pick = np.where(new > best + 1e-15, pick, -1)
        picks.append(pick)
        if (pick < 0).all():
            break
        best = np.where(pick >= 0, new, best)
    room = capacity
    for pick in reversed(picks):
        if (i := pick[room]) >= 0:
            counts[use[i]] += 1
            room -= s[i]
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used in the programme's optimum, by column generation."""
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        value, column = knapsack(sizes, np.linalg.solve(basis.T, np.ones(len(sizes))), capacity)
        if value <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, column)
        ratio = np.where(way > 1e-10, x / np.where(way > 1e-10, way, 1), np.inf)
        out = int(ratio.argmin())
        step = max(ratio[out], 0.0)
        x = np.maximum(x - step * way, 0)
        x[out], basis[:, out] = step, column
    return [(basis[:, i].astype(int), float(x[i])) for i in range(len(sizes))]


def _grouped(histogram: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Groups of [length, count], longest first, of equal cardinality but for rounding."""
    total = sum(histogram.values())
    size, out = -(-total // groups), [[]]
    left = size
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            if not left:
                out.append([])
                left = size
            n = min(left, count)
            out[-1].append([length, n])
            left, count = left - n, count - n
    return out


def _pack(histogram: dict[int, int], capacity: int, share: float, groups: int) -> list[Run]:
    bins, small = Bins(capacity), dict(histogram)
    large = {s: n for s, n in histogram.items() if capacity * share < s < capacity}
    if large:
        parts = _grouped(large, groups)
        sizes = np.array([p[0][0] for p in parts])
        demand = np.array([sum(n for _, n in p) for p in parts], float)
        queues = [deque(p) for p in parts]
        for counts, times in configurations(sizes, demand, capacity):
            n = int(times + 1e-9)
            if n < 1 or not counts.any():
                continue
            runs, odd = [Run(n, capacity, ())], False
            for g in np.flatnonzero(counts):
                for _ in range(counts[g]):
                    taken, need = [], n
                    while need and queues[g]:
                        entry = queues[g][0]
                        k = min(need, entry[1])
                        taken.append((entry[0], k))
                        small[entry[0]] -= k
                        entry[1] -= k
                        need -= k
                        if not entry[1]:
                            queues[g].popleft()
                    runs, odd = _merge(runs, taken[::-1] if odd else taken), not odd
            for run in runs:
                bins.add(run)
    for length in sorted((s for s, n in small.items() if n), reverse=True):
        bins.place(length, small[length])
    return bins.runs()


def _merge(runs: list[Run], taken: list[tuple[int, int]]) -> list[Run]:
    """One more item in each sequence of ``runs``, lengths in the order ``taken``; they may not reach all."""
    out, queue = [], deque(runs)
    for length, k in taken:
        while k:
            run = queue.popleft()
            n = min(k, run.n)
            out.append(run.put(n, length, 1))
            if n < run.n:
                queue.appendleft(Run(run.n - n, run.room, run.items))
            k -= n
    return out + list(queue)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, from rank, to rank, first sequence, items of the length in each, offset), and the number of sequences.

    The i-th item of a row's ranks goes to sequence first + i // times, at offset + i % times * length.
    """
    histogram = {int(s): int(n) for s, n in histogram.items() if n}
    least, best, fewest = -(-sum(s * n for s, n in histogram.items()) // capacity), [], None
    for share, groups in TRIALS:
        runs = _pack(histogram, capacity, share, groups)
        if fewest is None or sum(r.n for r in runs) < fewest:
            best, fewest = runs, sum(r.n for r in runs)
        if fewest == least:
            break
    rows, rank, first = [], dict.fromkeys(histogram, 0), 0
    for run in best:
        items = run.items
        while items:
            items, (length, times, room) = items
            n = run.n * times
            rows.append((length, rank[length], rank[length] + n, first, times, capacity - room))
            rank[length] += n
        first += run.n
    return rows, first


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id, cut only where longer than ``capacity``."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = end_id.to_bytes(4, "little")

    def run(c: dict) -> dict:
        words, rows = word_ids(path), []
        for doc, text in zip(c["doc_id"], c["text"], strict=True):
            ids = words.ids(text) + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        return {n: [r[i] for r in rows] for i, n in enumerate(schema.names)}

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(arrow_rows(run, schema), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def assign(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``; read twice, so give a written table."""
    histogram = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    rows, _ = plan(histogram, capacity)
    if len(rows) > MAX_PLAN:
        raise ValueError(f"a plan of {len(rows)} rows")
    spark = items.sparkSession
    where = spark.createDataFrame(rows, "length long, lo long, hi long, first long, times long, place long")
    # Rank among equal lengths: within a share of them, plus the shares before.
    shares = spark.createDataFrame([(s, 1 + n // RANK_ROWS) for s, n in histogram.items()], "length long, shares long")
    columns = items.columns
    salted = items.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.col("shares"))).drop("shares")
    before = (
        salted.groupBy("length", "share").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    ranked = (
        salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy(*[c for c in ("doc_id", "piece", "ids_crc32") if c in columns])) - 1)
        .join(before, ["length", "share"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    placed = ranked.join(F.broadcast(where), (ranked.length == where.length) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(where.length)
    nth = F.col("rank") - F.col("lo")
    return placed.withColumn("sequence_id", F.col("first") + F.floor(nth / F.col("times"))).withColumn("offset", F.col("place") + nth % F.col("times") * F.col("length")).select(*columns, "sequence_id", "offset")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's pieces in as few sequences as found.

    A null or empty text is the end id alone. Each of repeated rows is packed. Sequences
    have no gaps and no more than ``capacity`` tokens. Other columns are not read.
    """
    return assign(stage(pieces(docs, path, id_col, text_col, capacity), "pieces"), capacity)
