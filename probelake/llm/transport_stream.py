"""Media columns: MPEG transport streams written, parsed and checked.

``mux`` stores bytes as private data in PES packets of one elementary stream: 188-byte
packets, PAT and PMT before every random-access point, PCR and PTS. ``demux`` reads any
single- or multi-program stream of whole packets: program tables (with their CRC),
continuity counters (repeated packets are dropped, gaps counted), elementary packets
reassembled with their PTS/DTS and random-access flags.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import arrow_rows

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
#: Stream type and stream id of private PES data.
PRIVATE_TYPE, PRIVATE_ID = 0x06, 0xBD
#: Bytes of an access unit, and ticks of the 90 kHz clock between two.
UNIT, TICKS = 16_384, 3_600


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables; over a section with its own CRC it is 0."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    n = len(body) + 9
    head = bytes([table_id, 0xB0 | n >> 8, n & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    out = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return out + b"\xff" * (PACKET - len(out))


_PAT = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(
    PMT_PID,
    _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """A transport stream that holds ``payload``; each access unit of ``unit`` bytes is a random-access point."""
    if not 0 < unit <= 65_000:
        raise ValueError("an access unit has 1 to 65,000 bytes")
    out, count, tables = [], 0, 0
    for k in range(0, max(len(payload), 1), unit):
        pts = k // unit * TICKS & (1 << 33) - 1
        data = payload[k : k + unit]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_ID]) + (8 + len(data)).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(2, pts) + data
        for packet in (_PAT, _PMT):
            out.append(packet[:3] + bytes([0x10 | tables & 15]) + packet[4:])
        tables += 1
        clock = bytes([pts >> 25 & 255, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255, (pts & 1) << 7 | 0x7E, 0])
        first = pes[: PACKET - 12]
        if len(first) < PACKET - 12:
            room = 7 + PACKET - 12 - len(first)
            out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | count & 15, room, 0x50]) + clock + b"\xff" * (room - 7) + first)
        else:
            out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | count & 15, 7, 0x50]) + clock + first)
        count += 1
        rest = pes[len(first) :]
        full = len(rest) // (PACKET - 4)
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
            block[:, 3] = 0x10 | (np.arange(count, count + full) & 15)
            block[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, -1)
            out.append(block.tobytes())
            count += full
        if tail := rest[full * (PACKET - 4) :]:
            room = PACKET - 5 - len(tail)
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | count & 15, room]) + (b"\x00" + b"\xff" * (room - 1) if room else b"") + tail)
            count += 1
    return b"".join(out)


@dataclass
class Unit:
    """An elementary packet: ``start`` is the number of the packet that begins it."""

    pid: int
    start: int
    pts: int | None
    dts: int | None
    random_access: bool
    whole: bool
    data: bytes


@dataclass
class Stream:
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    lost: int = 0
    repeated: int = 0
    bad_tables: int = 0
    bad_packets: int = 0


def _sections(payloads: list[tuple[bool, bytes]]) -> list[bytes]:
    """The sections of one table PID from its packets' payloads (does a section start in it?, bytes)."""
    out, held = [], b""
    for starts, data in payloads:
        if starts and data:
            tail, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            held += tail
            if len(held) >= 3 and len(held) >= 3 + ((held[1] & 15) << 8 | held[2]):
                out.append(held[: 3 + ((held[1] & 15) << 8 | held[2])])
            held = b""
        elif not held:
            continue
        held += data
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + ((held[1] & 15) << 8 | held[2])):
            out.append(held[:n])
            held = held[n:]
        if held[:1] == b"\xff":
            held = b""
    return out


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def demux(media: bytes) -> Stream:
    """Parse whole packets; those without a sync byte or with the error flag are counted and left out."""
    out = Stream(packets=len(media) // PACKET)
    a = np.frombuffer(media, np.uint8, out.packets * PACKET).reshape(-1, PACKET)
    good = (a[:, 0] == SYNC) & (a[:, 1] < 0x80)
    out.bad_packets = int(out.packets - good.sum()) + (len(media) % PACKET > 0)
    pids = (a[:, 1] & 31).astype(np.int32) << 8 | a[:, 2]
    begins, flags, counter = (a[:, 1] & 0x40) > 0, a[:, 3] >> 4 & 3, a[:, 3] & 15
    has_field, has_data = (flags & 2) > 0, (flags & 1) > 0
    size = np.where(has_field, a[:, 4].astype(np.int32) + 1, 0)
    marks = np.where(has_field & (size > 1), a[:, 5], 0)
    offset = np.minimum(4 + size, PACKET)

    def table(pid: int) -> list[bytes]:
        rows = np.flatnonzero(good & has_data & (pids == pid))
        found = dict.fromkeys(_sections([(bool(begins[i]), a[i, offset[i] :].tobytes()) for i in rows]))
        right = [s for s in found if len(s) >= 12 and section_crc(s) == 0]
        out.bad_tables += len(found) - len(right)
        return right

    for s in table(PAT_PID):
        for i in range(8, len(s) - 4, 4):
            if number := s[i] << 8 | s[i + 1]:
                out.programs[number] = (s[i + 2] & 31) << 8 | s[i + 3]
    for pid in dict.fromkeys(out.programs.values()):
        for s in table(pid):
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while i + 5 <= len(s) - 4:
                out.streams[(s[i + 1] & 31) << 8 | s[i + 2]] = s[i]
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])

    for pid in out.streams:
        rows = np.flatnonzero(good & has_data & (pids == pid))
        if not len(rows):
            continue
        step = np.diff(counter[rows].astype(np.int32), prepend=int(counter[rows[0]]) - 1) % 16
        excused = (marks[rows] & 0x80) > 0
        twice = np.zeros(len(rows), bool)
        for k in np.flatnonzero((step == 0) & ~excused):
            twice[k] = k > 0 and not twice[k - 1] and bool((a[rows[k], offset[rows[k]] :] == a[rows[k - 1], offset[rows[k - 1]] :][: PACKET]).all() if offset[rows[k]] == offset[rows[k - 1]] else False)
        gap = (step != 1) & ~excused & ~twice
        out.repeated += int(twice.sum())
        out.lost += int(gap.sum())
        rows, gap = rows[~twice], gap[~twice]
        block, start = a[rows], offset[rows]
        data = block[np.arange(PACKET)[None, :] >= start[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(PACKET - start)])
        firsts = np.flatnonzero(begins[rows])
        for n, k in enumerate(firsts):
            stop = int(firsts[n + 1]) if n + 1 < len(firsts) else len(rows)
            pes = data[ends[k] : ends[stop]]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                out.bad_packets += 1
                continue
            length, head = pes[4] << 8 | pes[5], 9 + pes[8]
            body = pes[head : 6 + length] if length else pes[head:]
            out.units.append(
                Unit(
                    pid,
                    int(rows[k]),
                    _read_stamp(pes[9:14]) if pes[7] & 0x80 else None,
                    _read_stamp(pes[14:19]) if pes[7] & 0xC0 == 0xC0 else None,
                    bool(marks[rows[k]] & 0x40),
                    not gap[k + 1 : stop].any() and (not length or len(pes) >= 6 + length),
                    body,
                )
            )
    return out


def pad64(raw: bytes) -> bytes:
    return raw + b"\x00" * (64 if not raw else -len(raw) % 64)


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as a transport stream; a row for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(text_col, F.lit("")), "utf-8").alias("raw"))
    schema = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def write(c: dict) -> dict:
        return {"doc_id": c["doc_id"], "n_bytes": [len(x) for x in c["raw"]], "media": [mux(pad64(x)) for x in c["raw"]]}

    if kind != "bigint":
        slim = slim.withColumn("doc_id", F.col("doc_id").cast("string"))
    return slim.mapInArrow(arrow_rows(write, schema), f"doc_id {'bigint' if kind == 'bigint' else 'string'}, n_bytes bigint, media binary")


def entry_points(s: Stream) -> list[tuple[int, int, int | None]]:
    """(packet, PID, PTS) of the random-access points, by packet: where a reader can start."""
    return sorted(((u.start, u.pid, u.pts) for u in s.units if u.random_access), key=lambda p: p[:2])


def feature(s: Stream) -> str:
    """Programs, streams, packets and losses, and the elementary packets in order of their place: each one's data as a CRC, with its PTS."""
    stamps = [u.pts for u in s.units if u.pts is not None]
    content = 0
    for u in sorted(s.units, key=lambda u: (u.start, u.pid)):
        content = zlib.crc32(f"{u.pid}:{u.pts}:{len(u.data)}:".encode(), content)
        content = zlib.crc32(u.data, content)
    return (
        f"programs={len(s.programs)};streams={','.join(f'{p}:{t}' for p, t in sorted(s.streams.items()))};packets={s.packets};units={len(s.units)};"
        f"random_access={sum(u.random_access for u in s.units)};pts={min(stamps, default='')}-{max(stamps, default='')};lost={s.lost};repeated={s.repeated};bad={s.bad_packets + s.bad_tables};content={content:08x}"
    )


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media to the payload read back, its digests, the stream's feature string and its random-access points.

    ``entry_points``: array of (packet, pid, pts), by which a part of the media can be read
    from its packet on. A null media column gives nulls. Damaged streams give what whole
    packets hold; ``feature`` counts losses. A row for each row; ids may be null or repeated.
    """
    kinds = dict(media.dtypes)
    schema = pa.schema(
        [("doc_id", pa.int64() if kinds["doc_id"] == "bigint" else pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("entry_points", pa.list_(pa.struct([("packet", pa.int64()), ("pid", pa.int32()), ("pts", pa.int64())])))]
    )

    def read(c: dict) -> dict:
        rows = []
        for m in c["media"]:
            if m is None:
                rows.append((None,) * 7)
                continue
            s = demux(m)
            payload = b"".join(u.data for u in s.units)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(s), [dict(zip(("packet", "pid", "pts"), p, strict=True)) for p in entry_points(s)]))
        names = schema.names[2:]
        return {"doc_id": c["doc_id"], "n_bytes": c["n_bytes"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        arrow_rows(read, schema), f"doc_id {kinds['doc_id']}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, entry_points array<struct<packet:bigint,pid:int,pts:bigint>>"
    )


def units(media: DataFrame) -> DataFrame:
    """doc_id, media to a row for each elementary packet: pid, number, packet, pts, dts, random_access, whole, data."""
    kinds = dict(media.dtypes)
    schema = pa.schema([("doc_id", pa.int64() if kinds["doc_id"] == "bigint" else pa.string()), ("pid", pa.int32()), ("number", pa.int64()), ("packet", pa.int64()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("whole", pa.bool_()), ("data", pa.binary())])

    def read(c: dict) -> dict:
        rows = [(d, u.pid, n, u.start, u.pts, u.dts, u.random_access, u.whole, u.data) for d, m in zip(c["doc_id"], c["media"], strict=True) if m is not None for n, u in enumerate(demux(m).units)]
        return {n: [r[i] for r in rows] for i, n in enumerate(schema.names)}

    return media.select("doc_id", "media").mapInArrow(arrow_rows(read, schema), f"doc_id {kinds['doc_id']}, pid int, number bigint, packet bigint, pts bigint, dts bigint, random_access boolean, whole boolean, data binary")
