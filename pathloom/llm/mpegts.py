"""Media columns: MPEG-2 transport streams.

``mux`` stores a payload as 8-bit samples in a transport stream: program tables, one elementary stream cut
into access units of 576 bytes, each in a packetized elementary packet with a time stamp, a clock reference
and, every so many units, a random-access point. ``demux`` parses any such stream from its bytes alone:
program tables with their checksums, continuity counters, reassembled elementary packets, time stamps and
random-access points.

Defined cases: null or empty text is stored as one unit of filler; texts of any length are stored whole; rows that repeat are
stored each, equal texts alike; damaged streams don't raise, but are reported (``ok`` false, counted continuity errors,
checksum errors); null media parses as an empty stream; an empty table gives no rows; extra columns pass, those named like an
output are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathloom.llm.shared import map_text

PACKET, SYNC = 188, 0x47
UNIT = 576
#: 90 kHz ticks from one unit to the next: 576 samples at 48 kHz.
TICKS = 1080
#: Units from one random-access point, with its program tables, to the next.
RAP_EVERY = 64
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE = 0x1000, 0x100, 1, 0x06
PES_HEAD = 14


def _crc_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        values = np.where(values & np.uint32(1 << 31), (values << np.uint32(1)) ^ np.uint32(0x04C11DB7), values << np.uint32(1)).astype(np.uint32)
    return values


_CRC = [int(x) for x in _crc_table()]


def section_crc(data: bytes) -> int:
    """The checksum of program tables (polynomial 0x04C11DB7, not reflected)."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ byte]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    data = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(data.ljust(PACKET, b"\xff"), np.uint8)


PAT = _table_packet(0, _section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255])))
PMT = _table_packet(PMT_PID, _section(2, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0])))


def _unit_template() -> tuple[np.ndarray, np.ndarray]:
    """The packets of one unit without what changes, and the places of its payload in them."""
    data = bytearray()
    places: list[int] = []
    left, first = PES_HEAD + UNIT, True
    while left:
        room = PACKET - 4 - (8 if first else 0)
        fits = min(left, room)
        stuffing = room - fits
        adaptation = 8 + stuffing if first else stuffing
        data += bytes([SYNC, (0x40 if first else 0) | ES_PID >> 8, ES_PID & 255, 0x30 if adaptation else 0x10])
        if adaptation:
            flags = bytes([0x10]) + bytes(6) if first else (b"\0" if adaptation > 1 else b"")
            data += bytes([adaptation - 1]) + flags + b"\xff" * (adaptation - 1 - len(flags))
        places += range(len(data), len(data) + fits)
        data += bytes(fits)
        left, first = left - fits, False
    template = np.frombuffer(bytes(data), np.uint8).copy()
    length = 3 + 5 + UNIT
    template[places[:PES_HEAD]] = [0, 0, 1, 0xBD, length >> 8, length & 255, 0x84, 0x80, 5, 0, 0, 0, 0, 0]
    return template, np.array(places)


UNIT_PACKETS, PLACES = _unit_template()
PER_UNIT = len(UNIT_PACKETS) // PACKET


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``unit``."""
    return data + b"\xff" * (unit - len(data) % unit if len(data) % unit or not data else 0)


def mux(payload: bytes) -> bytes:
    """A transport stream of a payload whose length is a positive multiple of 576."""
    units = len(payload) // UNIT
    n = np.arange(units, dtype=np.int64)
    out = np.tile(UNIT_PACKETS, (units, 1))
    out[:, PLACES[PES_HEAD:]] = np.frombuffer(payload, np.uint8).reshape(units, UNIT)
    counters = (n[:, None] * PER_UNIT + np.arange(PER_UNIT)) & 15
    out[:, 3::PACKET] |= counters.astype(np.uint8)
    rap = n % RAP_EVERY == 0
    out[rap, 5] |= 0x40
    pts = n * TICKS & (1 << 33) - 1
    for place, value in zip(range(6, 12), (pts >> 25, pts >> 17, pts >> 9, pts >> 1, (pts & 1) << 7 | 0x7E, pts * 0), strict=True):
        out[:, place] = value & 255
    stamp = (0x21 | pts >> 30 << 1, pts >> 22, pts >> 14 | 1, pts >> 7, pts << 1 | 1)
    for place, value in zip(PLACES[9:PES_HEAD], stamp, strict=True):
        out[:, place] = value & 255
    chunks = []
    for k, at in enumerate(range(0, units, RAP_EVERY)):
        tables = np.concatenate([PAT, PMT])
        tables[[3, 3 + PACKET]] |= k & 15
        chunks += [tables, out[at : at + RAP_EVERY].ravel()]
    return np.concatenate(chunks).tobytes()


@dataclass
class Stream:
    """An elementary stream: its bytes, and for each of its packets the time stamp (-1: none), the place
    of its first byte and whether it is a random-access point."""

    pid: int
    program: int
    stream_type: int
    data: bytes = b""
    pts: list[int] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)


@dataclass
class Parsed:
    ok: bool
    packets: int
    programs: dict[int, int]
    streams: list[Stream]
    continuity_errors: int
    table_errors: int


def _sections(payloads: list[tuple[bytes, bool]]) -> Iterator[bytes]:
    held = b""
    for data, start in payloads:
        if start and data:
            held = data[1 + data[0] :]
        else:
            held += data
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < size:
                break
            yield held[:size]
            held = held[size:]


def demux(media: bytes) -> Parsed:
    """Parses a transport stream."""
    whole = len(media) // PACKET
    p = np.frombuffer(media, np.uint8, whole * PACKET).reshape(whole, PACKET)
    good = p[:, 0] == SYNC
    ok = whole > 0 and len(media) == whole * PACKET and bool(good.all())
    p = p[good & (p[:, 1] & 0x80 == 0)]
    pids = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    control = p[:, 3] >> 4 & 3
    starts = np.where(control & 2, 5 + p[:, 4].astype(np.int32), 4)
    has = (control & 1 == 1) & (starts <= PACKET)
    errors = 0
    use = has.copy()
    for pid in np.unique(pids[has & (pids != 0x1FFF)]):
        at = np.flatnonzero(has & (pids == pid))
        step = np.diff(p[at, 3] & 15) & 15
        again = np.concatenate([[False], (step == 0) & (p[at[1:]] == p[at[:-1]]).all(1)])
        use[at[again]] = False
        told = (control[at[1:]] & 2 == 2) & (p[at[1:], 4] > 0) & (p[at[1:], 5] & 0x80 == 0x80)
        errors += int(((step != 1) & ~again[1:] & ~told).sum())

    def payloads(pid: int) -> list[tuple[bytes, bool]]:
        return [(p[i, starts[i] :].tobytes(), bool(p[i, 1] & 0x40)) for i in np.flatnonzero(use & (pids == pid))]

    programs: dict[int, int] = {}
    bad, seen = 0, set()
    for section in _sections(payloads(0)):
        if section in seen:
            continue
        seen.add(section)
        if section_crc(section):
            bad += 1
        elif section[0] == 0:
            for k in range(8, len(section) - 4, 4):
                if number := section[k] << 8 | section[k + 1]:
                    programs[number] = (section[k + 2] & 31) << 8 | section[k + 3]
    streams: dict[int, Stream] = {}
    for number, pid in programs.items():
        for section in _sections(payloads(pid)):
            if section in seen:
                continue
            seen.add(section)
            if section_crc(section):
                bad += 1
            elif section[0] == 2 and (section[3] << 8 | section[4]) == number:
                k = 12 + ((section[10] & 15) << 8 | section[11])
                while k + 5 <= len(section) - 4:
                    es = (section[k + 1] & 31) << 8 | section[k + 2]
                    streams.setdefault(es, Stream(es, number, section[k]))
                    k += 5 + ((section[k + 3] & 15) << 8 | section[k + 4])
    for stream in streams.values():
        _reassemble(stream, p, np.flatnonzero(use & (pids == stream.pid)), starts, control)
    return Parsed(ok and bool(streams) and not errors and not bad, whole, programs, list(streams.values()), errors, bad)


def _reassemble(stream: Stream, p: np.ndarray, at: np.ndarray, starts: np.ndarray, control: np.ndarray) -> None:
    """Joins the payloads of a stream's packets and takes the heads off its elementary packets."""
    opens = p[at, 1] & 0x40 == 0x40
    if not opens.any():
        return
    at = at[int(np.argmax(opens)) :]
    opens = p[at, 1] & 0x40 == 0x40
    joined = p[at][np.arange(PACKET) >= starts[at][:, None]]
    ends = np.cumsum(PACKET - starts[at])
    first = (ends - (PACKET - starts[at]))[opens]
    last = np.concatenate([first[1:], ends[-1:]])
    flags = (control[at] & 2 == 2) & (p[at, 4] > 0) & (p[at, 5] & 0x40 == 0x40)
    # heads of all packets at once; what is no head (or is cut off) is left out with what follows it
    head = np.concatenate([joined, np.zeros(PES_HEAD, np.uint8)])[first[:, None] + np.arange(PES_HEAD)].astype(np.int64)
    fine = (last - first >= 9) & (head[:, 0] == 0) & (head[:, 1] == 0) & (head[:, 2] == 1)
    first, last, head, rap = first[fine], last[fine], head[fine], flags[opens][fine]
    size, body = head[:, 4] << 8 | head[:, 5], first + 9 + head[:, 8]
    stop = np.where(size > 0, np.minimum(last, first + 6 + size), last)
    body = np.minimum(body, stop)
    stamp = (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | head[:, 11] >> 1 << 15 | head[:, 12] << 7 | head[:, 13] >> 1
    stamped = (head[:, 7] & 0x80 == 0x80) & (head[:, 8] >= PES_HEAD - 9) & (last - first >= PES_HEAD)
    edges = np.zeros(len(joined) + 1, np.int8)
    np.add.at(edges, body, 1)
    np.add.at(edges, stop, -1)
    stream.data = joined[np.cumsum(edges[:-1]) > 0].tobytes()
    stream.pts = np.where(stamped, stamp, -1).tolist()
    stream.places = (np.cumsum(stop - body) - (stop - body)).tolist()
    stream.random_access = rap.tolist()


STREAM_FIELDS = {
    "ok": "boolean", "packets": "bigint", "continuity_errors": "bigint", "table_errors": "bigint", "streams":
    "array<struct<program:int,pid:int,stream_type:int,data:binary,pts:array<bigint>,places:array<bigint>,random_access:array<boolean>>>",
}


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Replaces each whole text by its transport stream and ``n_bytes``, the text's length in UTF-8."""

    def fn(texts: list[str]) -> list[list]:
        raw = [t.encode() for t in texts]
        return [[len(x) for x in raw], [mux(padded(x)) for x in raw]]

    return map_text(df, text, {"n_bytes": "bigint", media: "binary"}, fn, drop=(text,))


def parse(df: DataFrame, media: str = "media") -> DataFrame:
    """Replaces stored streams by what ``demux`` finds in them."""

    def fn(column: list[bytes]) -> list[list]:
        found = [demux(x or b"") for x in column]
        streams = [[(s.program, s.pid, s.stream_type, s.data, s.pts, s.places, s.random_access) for s in x.streams] for x in found]
        names = ("program", "pid", "stream_type", "data", "pts", "places", "random_access")
        return [[x.ok for x in found], [x.packets for x in found], [x.continuity_errors for x in found], [x.table_errors for x in found], [[dict(zip(names, s, strict=True)) for s in row] for row in streams]]

    return map_text(df, media, STREAM_FIELDS, fn, drop=(media,))


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """Replaces stored streams by digests of the payload read back, of the stream, a feature string, and its random-access
    points with their time stamps.

    Feature: programs, packets, elementary packets, random-access points, span of time stamps, mean and deviation of
    the samples, continuity errors."""

    def fn(column: list[bytes]) -> list[list]:
        out: list[list] = [[] for _ in range(7)]
        for stored in column:
            stored = stored or b""
            found = demux(stored)
            s = found.streams[0] if found.streams else Stream(0, 0, 0)
            samples = np.frombuffer(s.data, np.uint8)
            n, total, squares = len(samples), int(samples.sum(dtype=np.int64)), int(np.dot(samples.astype(np.float64), samples))
            mean = total / max(n, 1)
            feature = f"programs={len(found.programs)};packets={found.packets};pes={len(s.pts)};rap={sum(s.random_access)};pts={min(s.pts, default=-1)}-{max(s.pts, default=-1)};mean={mean:.4f};sd={max(0.0, squares / max(n, 1) - mean * mean) ** 0.5:.4f};cc_errors={found.continuity_errors};ok={int(found.ok)}"
            points = [{"place": at, "pts": p} for at, p, rap in zip(s.places, s.pts, s.random_access, strict=True) if rap]
            for target, value in zip(out, (n, hashlib.sha256(s.data).hexdigest(), zlib.crc32(s.data[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, points), strict=True):
                target.append(value)
        return out

    fields = {"payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string", "access_points": "array<struct<place:bigint,pts:bigint>>"}
    return map_text(df, media, fields, fn, drop=(media,))
