"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

`mux` stores bytes as access units in PES packets of a one-programme stream; `demux` parses any stream of 188-byte
packets: programme association and map tables with their CRC, over as many packets as a section takes, continuity
counters, elementary packets, time stamps, random-access points. Bytes are stored as they are, so a round trip is
lossless.

Of damaged streams: a section that never gets complete is dropped, one with a wrong CRC or without room for its header
is counted in crc_errors; an elementary packet without room for its header is dropped and one that is shorter than it
says is kept as far as it goes, both counted in cut_units; packets with the error bit, scrambled ones and ones whose
adaptation field is too long are counted in bad_packets and skipped. A stream that isn't whole packets raises ValueError.

Defined results: a null text counts as empty and has a payload of padding only; every payload has at least one
access unit; equal texts have equal values, so rows that repeat an id or a text each have their own; a text of any
length is stored whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, SYNC, UNIT = 188, 0x47, 576
PAT_PID, PMT_PID, DATA_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
#: 90 kHz ticks between access units, access units in a PES packet, PES packets between random-access points.
TICKS, UNITS_PER_PES, GROUP = 3600, 48, 8


def _crc_table() -> list[int]:
    rows = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        rows.append(c & 0xFFFFFFFF)
    return rows


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), ext, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + (b"\x00" + section).ljust(PACKET - 4, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(2, 1, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000))
)


def _stamp(ticks: int) -> bytes:
    t = ticks & 0x1FFFFFFFF
    return bytes((0x21 | (t >> 29) & 0x0E, t >> 22 & 0xFF, 0x01 | (t >> 14) & 0xFE, t >> 7 & 0xFF, 0x01 | (t << 1) & 0xFE))


def mux(payload: bytes) -> bytes:
    """A stream with the tables first, then a PES packet for every 48 access units of 576 bytes."""
    out, counter, step = [_TABLES], 0, UNIT * UNITS_PER_PES
    for k, at in enumerate(range(0, len(payload), step)):
        data = payload[at : at + step]
        pts = k * UNITS_PER_PES * TICKS
        pes = b"\x00\x00\x01" + bytes((PRIVATE_STREAM,)) + struct.pack(">H", len(data) + 8) + b"\x84\x80\x05" + _stamp(pts) + data
        start = k % GROUP == 0
        clock = struct.pack(">Q", (pts << 15) | (0x3F << 9))[2:]  # 33 bits of base, 6 reserved, 9 of extension
        field_ = bytes((7, 0x50)) + clock if start else b""
        first, rest = pes[: PACKET - 4 - len(field_)], pes[PACKET - 4 - len(field_) :]
        if len(first) + len(field_) < PACKET - 4:
            field_ = _stuffed(field_, PACKET - 4 - len(first))
        out.append(struct.pack(">BHB", SYNC, 0x4000 | DATA_PID, (0x30 if field_ else 0x10) | counter) + field_ + first)
        counter = (counter + 1) & 15
        whole = len(rest) // (PACKET - 4)
        if whole:
            block = np.empty((whole, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            block[:, 3] = 0x10 | ((np.arange(whole) + counter) & 15)
            block[:, 4:] = np.frombuffer(rest, np.uint8, whole * (PACKET - 4)).reshape(whole, PACKET - 4)
            out.append(block.tobytes())
            counter = (counter + whole) & 15
        last = rest[whole * (PACKET - 4) :]
        if last:
            out.append(struct.pack(">BHB", SYNC, DATA_PID, 0x30 | counter) + _stuffed(b"", PACKET - 4 - len(last)) + last)
            counter = (counter + 1) & 15
    return b"".join(out)


def _stuffed(field_: bytes, size: int) -> bytes:
    """An adaptation field of `size` bytes in all."""
    if size == 1:
        return b"\x00"
    body = (field_[1:] or b"\x00").ljust(size - 1, b"\xff")
    return bytes((size - 1,)) + body


@dataclass
class Stream:
    """What demux found. units: (pid, stream id, pts, dts, random access, data) of each elementary packet."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[tuple[int, int, int | None, int | None, bool, bytes]] = field(default_factory=list)
    packets: int = 0
    continuity_errors: int = 0
    crc_errors: int = 0
    clocks: int = 0
    cut_units: int = 0
    bad_packets: int = 0


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


class _Sections:
    """Sections of one PID, put together over packets."""

    def __init__(self):
        self.open: bytearray | None = None

    def feed(self, data: bytes, start: bool) -> Iterator[bytes]:
        if start:
            skip = data[0] if data else 0
            if self.open is not None:  # the rest of the section before
                self.open += data[1 : 1 + skip]
                yield from self._complete()
            self.open = bytearray(data[1 + skip :])
        elif self.open is not None:
            self.open += data
        yield from self._complete()

    def _complete(self) -> Iterator[bytes]:
        at, data = 0, self.open or b""
        while at + 3 <= len(data) and data[at] != 0xFF:
            size = 3 + ((data[at + 1] & 0x0F) << 8 | data[at + 2])
            if at + size > len(data):
                break
            yield bytes(data[at : at + size])
            at += size
        if self.open is not None:
            del self.open[:at]
            if self.open[:1] == b"\xff":  # stuffing up to the next start
                self.open = None


#: Stream ids whose PES packets have no flags and no time stamps: maps, padding, private stream 2, ECM, EMM, DSM-CC, H.222.1 type E, directory.
_PLAIN_PES = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}


def _unit(pid: int, random: bool, pes: bytes, got: Stream) -> None:
    """Add an elementary packet to what was found."""
    if pes[:3] != b"\x00\x00\x01":
        return
    size = pes[4] << 8 | pes[5] if len(pes) >= 6 else 0
    plain = len(pes) >= 6 and pes[3] in _PLAIN_PES
    if len(pes) < (6 if plain else 9):
        got.cut_units += 1
        return
    got.cut_units += bool(size) and len(pes) < 6 + size
    pes = pes[: 6 + size] if size else pes
    if plain:
        got.units.append((pid, pes[3], None, None, random, pes[6:]))
        return
    if len(pes) < 9 or len(pes) < 9 + pes[8]:
        got.cut_units += 1
        return
    head = pes[9 : 9 + pes[8]]
    pts = _read_stamp(head[:5]) if pes[7] & 0x80 and len(head) >= 5 else None
    dts = _read_stamp(head[5:10]) if pes[7] & 0x40 and len(head) >= 10 else pts
    got.units.append((pid, pes[3], pts, dts, random, pes[9 + pes[8] :]))


def _read_section(s: bytes, got: Stream) -> None:
    if len(s) < 12 or crc32_mpeg(s):
        got.crc_errors += 1
    elif s[0] == 0:
        body = s[8:-4]
        got.programs |= {n: p & 0x1FFF for n, p in struct.iter_unpack(">HH", body[: len(body) // 4 * 4]) if n}
    elif s[0] == 2:
        x, end = 12 + ((s[10] & 0x0F) << 8 | s[11]), len(s) - 4
        while x + 5 <= end:
            got.streams[(s[x + 1] & 0x1F) << 8 | s[x + 2]] = s[x]
            x += 5 + ((s[x + 3] & 0x0F) << 8 | s[x + 4])


def demux(stream: bytes) -> Stream:
    """Parse a stream of whole 188-byte packets; raises ValueError when it isn't one."""
    if len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    got = Stream(packets=len(stream) // PACKET)
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("a packet has no sync byte")
    pids = ((rows[:, 1] & 0x1F).astype(np.int32) << 8 | rows[:, 2]).tolist()
    starts = (rows[:, 1] & 0x40 != 0).tolist()
    control, extra = rows[:, 3].tolist(), rows[:, 4].tolist()
    bad = ((rows[:, 1] & 0x80 != 0) | (rows[:, 3] & 0xC0 != 0) | ((rows[:, 3] & 0x20 != 0) & (rows[:, 4] > PACKET - 5))) & (np.array(pids) != NULL_PID)
    got.bad_packets = int(bad.sum())
    bad = bad.tolist()
    last: dict[int, int] = {}
    open_: dict[int, list] = {}
    tables: dict[int, _Sections] = {}

    def close(pid: int) -> None:
        random, parts = open_.pop(pid)
        _unit(pid, random, b"".join(parts), got)

    for i, (pid, start, c) in enumerate(zip(pids, starts, control, strict=True)):
        if pid == NULL_PID or bad[i]:
            continue
        at, random, jump = i * PACKET + 4, False, False
        if c & 0x20:
            size = extra[i]
            if size:
                flags = stream[at + 1]
                jump, random = bool(flags & 0x80), bool(flags & 0x40)
                got.clocks += flags >> 4 & 1
            at += 1 + size
        if not c & 0x10:
            continue
        count = c & 15
        if pid in last and not jump:
            if count == last[pid]:  # a packet may be sent twice
                continue
            if count != (last[pid] + 1) & 15:
                got.continuity_errors += 1
                tables.pop(pid, None)
        last[pid] = count
        data = stream[at : (i + 1) * PACKET]
        if pid == PAT_PID or pid in got.programs.values():
            for s in tables.setdefault(pid, _Sections()).feed(data, start):
                _read_section(s, got)
        elif pid in got.streams:
            if start:
                if pid in open_:
                    close(pid)
                open_[pid] = [random, [data]]
            elif pid in open_:
                open_[pid][1].append(data)
    for pid in list(open_):
        close(pid)
    return got


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


SCHEMA = (
    "doc_id long, n_bytes long, media binary, payload binary, programs long, streams long, packets long, clocks long, continuity_errors long, crc_errors long, "
    "pts array<long>, random_access array<long>"
)
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [_KINDS[x.split()[1]] for x in SCHEMA.split(", ")]
#: Bytes of text after which a batch of streams is handed on.
BATCH = 1 << 22


def to_transport_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the stored stream (media), the payload read back from it, and what the parser found.

    pts has the time stamp of every elementary packet and random_access those at random-access points, in 90 kHz ticks.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = x.as_py()
                media = mux(padded(data))
                got = demux(media)
                rows.append((
                    i, len(data), media, b"".join(u[5] for u in got.units), len(got.programs), len(got.streams), got.packets, got.clocks,
                    got.continuity_errors, got.crc_errors, [u[2] for u in got.units], [u[2] for u in got.units if u[4]],
                ))
                size += len(data)
                if size >= BATCH:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data")).mapInArrow(run, SCHEMA)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of the stored streams, with the time stamps and the random-access points."""
    feature = F.concat_ws(
        ";", *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in ("programs", "streams", "packets")), F.concat(F.lit("pes="), F.size("pts").cast("string")),
        F.concat(F.lit("units="), (F.length("payload") / UNIT).cast("long").cast("string")), F.concat(F.lit("pts="), F.get("pts", F.lit(0)), F.lit(".."), F.element_at("pts", -1)),
        F.concat(F.lit("random_access="), F.size("random_access").cast("string")), *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in ("clocks", "continuity_errors", "crc_errors")),
    )
    tail = F.crc32(F.expr("substring(payload, -32, 32)"))
    return to_transport_streams(docs, id_col, text_col).select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "pts", "random_access",
    )
