"""A splittable scan of JSON files that hold an array of objects, however they are laid out.

The text reader cuts a file at every '}', so its splits are read apart and no line, array
or file is ever whole in memory. What a '}' means depends on all text before it: whether it
stands in a string, and at which depth. A first pass sums up each split for both cases (its
beginning inside or outside of a string); these sums are additive, so a prefix sum over the
splits of a file gives each its state. A second pass cuts out the objects: those that lie in
one split are given out there; pieces of objects that cross a border are joined by the
number of their object.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What matters for the depth: escaped characters (passed over), quotes and braces.
_SIGNS = re.compile(r'\\.|["{]', re.DOTALL)
#: Characters that a task gives out at once; an object with more than the second is kept as it lies, in parts, and not parsed.
OUT_BYTES, OBJECT_BYTES = 4 << 20, 16 << 20
#: What stands between the objects of an array.
_BETWEEN = " \t\r\n,[]\ufeff"


def _step(piece: str, inside: bool) -> tuple[bool, int]:
    """(in a string after the piece, depth gained), for a piece between two '}'."""
    depth = 0
    for sign in _SIGNS.findall(piece):
        if sign == '"':
            inside = not inside
        elif sign == "{" and not inside:
            depth += 1
    return inside, depth


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """piece, file, file_size, block (where its split begins); the rows of a split come in the order of the file."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("value").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"))


_SUMS = pa.schema([("file", pa.string()), ("file_size", pa.int64()), ("block", pa.int64()), ("bytes", pa.int64()), ("quotes", pa.int64()), ("depth0", pa.int64()), ("depth1", pa.int64()), ("ends0", pa.map_(pa.int64(), pa.int64())), ("ends1", pa.map_(pa.int64(), pa.int64()))])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split its bytes and, for both beginnings, whether it ends in a string, the depth gained, and how many '}' close which depth."""
    at, sums = None, None

    def row() -> pa.RecordBatch:
        (name, size, block), (length, states) = at, sums
        a, b = states
        return pa.RecordBatch.from_pylist([{"file": name, "file_size": size, "block": block, "bytes": length, "quotes": int(a[0]), "depth0": a[1], "depth1": b[1], "ends0": list(a[2].items()), "ends1": list(b[2].items())}], schema=_SUMS)

    for batch in batches:
        for piece, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place != at:
                if at:
                    yield row()
                at, sums = place, [0, [[False, 0, Counter()], [True, 0, Counter()]]]
            sums[0] += len(piece.encode()) + 1
            for s in sums[1]:
                s[0], gained = _step(piece, s[0])
                s[1] += gained
                if not s[0]:
                    s[1] -= 1
                    s[2][s[1]] += 1
    if at:
        yield row()


def _states(pieces: DataFrame) -> DataFrame:
    """file, block, inside, depth, number (of the object that is open or comes next) at the beginning of each split, and whether the file's last '}' is one."""
    ddl = "file string, file_size bigint, block bigint, bytes bigint, quotes bigint, depth0 bigint, depth1 bigint, ends0 map<bigint,bigint>, ends1 map<bigint,bigint>"
    sums = pieces.select("piece", "file", "file_size", "block").mapInArrow(_summed, ddl)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    known = sums.withColumns({"inside": sum_before(F.col("quotes")) % 2 == 1, "is_last": F.lead("block").over(order).isNull(), "total": F.sum("bytes").over(Window.partitionBy("file"))})
    known = known.withColumn("depth", sum_before(F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))))
    closed = F.coalesce(F.try_element_at(F.when(F.col("inside"), F.col("ends1")).otherwise(F.col("ends0")), -F.col("depth")), F.lit(0))
    # The reader ends a file's last piece as if a '}' followed; then it has read a byte too many.
    return known.withColumn("number", sum_before(closed)).select("file", "block", "inside", "depth", "number", (F.col("is_last") & (F.col("total") > F.col("file_size"))).alias("open_end"))


_OBJECTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("part", pa.int32()), ("is_whole", pa.bool_()), ("text", pa.string())])


def _lasts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, bool]]:
    """Rows, and whether each is the last of its split."""
    held = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held:
                yield held, row[1:3] != held[1:3]
            held = row
    if held:
        yield held, True


class _Cutter:
    """Cuts one split after the other into objects; ``out`` has what is ready."""

    def __init__(self, most: int) -> None:
        self.out: list[dict] = []
        self.size, self.at, self.most = 0, None, most

    def begin(self, name: str, block: int, inside: bool, depth: int, number: int) -> None:
        self.at, self.held, self.length, self.part = (name, block), [], 0, 0
        self.inside, self.depth, self.number, self.begun = inside, depth, number, depth == 0 and not inside

    def give(self, is_whole: bool) -> None:
        text = "".join(self.held)
        if text.strip(_BETWEEN):
            self.out.append({"file": self.at[0], "block": self.at[1], "number": self.number, "part": self.part, "is_whole": is_whole, "text": text})
        self.size += len(text)
        self.held, self.length, self.part = [], 0, self.part + 1

    def add(self, piece: str, closes: bool) -> None:
        """A piece; ``closes``: a '}' follows it."""
        self.inside, gained = _step(piece, self.inside)
        self.depth += gained
        self.held.append(piece + "}" if closes else piece)
        self.length += len(piece) + 1
        if closes and not self.inside:
            self.depth -= 1
            if self.depth == 0:
                self.give(self.begun)
                self.number, self.begun, self.part = self.number + 1, True, 0
        if self.length > self.most:
            self.give(False)
            self.begun = False


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Objects that a split holds whole, and the parts at its borders."""
    cutter = _Cutter(most)
    for (piece, name, block, inside, depth, number, open_end), is_last in _lasts(batches):
        if (name, block) != cutter.at:
            cutter.begin(name, block, inside, depth, number)
        cutter.add(piece, not (is_last and open_end))
        if is_last and cutter.held:
            cutter.give(False)
        if cutter.size > OUT_BYTES:
            yield pa.RecordBatch.from_pylist(cutter.out, schema=_OBJECTS)
            cutter.out, cutter.size = [], 0
    if cutter.out:
        yield pa.RecordBatch.from_pylist(cutter.out, schema=_OBJECTS)


def scan_objects(spark: SparkSession, path: str, most: int = OBJECT_BYTES) -> DataFrame:
    """file, number (from 0, in the file's order), text: a row for each object of each file; a cut one ends where its file ends.

    Of a damaged file the objects before the damage come as they are, what follows as it
    can be cut; nothing is left out. What never ends is not gathered: beyond ``most``
    characters its parts are rows of their own, in order, with one number.
    A file without objects gives no rows. Packed files are one split.
    """
    pieces = _pieces(spark, path)
    states = F.broadcast(_states(pieces))  # a row for each split of spark.sql.files.maxPartitionBytes
    rows = pieces.drop("file_size").join(states, ["file", "block"]).select("piece", "file", "block", "inside", "depth", "number", "open_end")
    cut = rows.mapInArrow(lambda batches: _cut(batches, most), "file string, block bigint, number bigint, part int, is_whole boolean, text string")
    whole = cut.filter("is_whole").select("file", "number", "text")
    parts = cut.filter("NOT is_whole").withColumn("total", F.sum(F.length("text")).over(Window.partitionBy("file", "number")))
    crossing = parts.filter(F.col("total") <= most).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("p"))
    joined = crossing.select("file", "number", F.array_join(F.col("p.text"), "").alias("text"))
    endless = parts.filter(F.col("total") > most).select("file", "number", "text")
    return whole.unionByName(joined).unionByName(endless).withColumn("text", F.ltrim("text", F.lit(" \t\r\n,[\ufeff")))
