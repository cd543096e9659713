import hashlib
import random
import zlib

import pytest

from pathloom.llm import mpegts


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 100_000])
def test_round_trip(n):
    payload = mpegts.padded(random.Random(n).randbytes(n))
    found = mpegts.demux(mpegts.mux(payload))
    units = len(payload) // 576
    assert found.ok and found.programs == {1: mpegts.PMT_PID} and found.streams[0].data == payload
    assert found.streams[0].pts == [k * 1080 for k in range(units)] and found.streams[0].places == [k * 576 for k in range(units)]
    assert found.streams[0].random_access == [k % 64 == 0 for k in range(units)]


def _plain(media):
    """A stream's payload, stamps and access points, packet by packet and byte by byte."""
    data, pts, places, points, unit, held = b"", [], [], [], b"", None

    def close():
        nonlocal data
        if held is not None and len(unit) >= 9 and unit[:3] == b"\0\0\1":
            size, body = int.from_bytes(unit[4:6], "big"), 9 + unit[8]
            places.append(len(data))
            s = unit[9:14]
            pts.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1 if unit[7] & 0x80 and unit[8] >= 5 and len(unit) >= 14 else -1)
            points.append(held)
            data += unit[body : 6 + size if size else len(unit)]

    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        if (p[1] & 31) << 8 | p[2] != mpegts.ES_PID:
            continue
        start = 5 + p[4] if p[3] & 0x20 else 4
        if p[1] & 0x40:
            close()
            unit, held = b"", bool(p[3] & 0x20 and p[4] and p[5] & 0x40)
        unit += p[start:]
    close()
    return data, pts, places, points


@pytest.mark.parametrize("seed", range(6))
def test_parsed_as_packet_by_packet(seed):
    """Streams with stamps beyond 32 bits, without stamps, with broken heads and with lengths left open."""
    rng = random.Random(seed)
    media = bytearray(mpegts.mux(mpegts.padded(rng.randbytes(rng.randint(1, 60_000)))))
    for at in range(0, len(media), 188):
        head = at + 5 + media[at + 4]
        if media[at + 1] & 0x40 and (media[at + 1] & 31) << 8 | media[at + 2] == mpegts.ES_PID:
            kind = rng.randint(0, 5)
            if kind == 0:
                media[head + 9 : head + 14] = bytes([0x2F, 0xFF, 0xFF, 0xFF, 0xFF])
            elif kind == 1:
                media[head + 7] = 0
            elif kind == 2:
                media[head + 2] = 0
            elif kind == 3:
                media[head + 4 : head + 6] = b"\0\0"
    s = mpegts.demux(bytes(media)).streams[0]
    assert (s.data, s.pts, s.places, s.random_access) == _plain(bytes(media))


def test_damage_is_reported():
    media = bytearray(mpegts.mux(mpegts.padded(b"x" * 3000)))
    lost = bytes(media[: 188 * 5] + media[188 * 6 :])
    assert mpegts.demux(lost).continuity_errors == 1 and not mpegts.demux(lost).ok
    twice = bytes(media[: 188 * 6] + media[188 * 5 :])
    assert mpegts.demux(twice).ok and mpegts.demux(twice).streams[0].data == mpegts.padded(b"x" * 3000)
    media[8] ^= 1
    assert mpegts.demux(bytes(media)).table_errors == 1
    for broken in (b"", b"\x47", bytes(188), b"\x47" * 188, bytes(media[:-7]), bytes(media[100:])):
        assert not mpegts.demux(broken).ok


def test_section_checksum():
    assert mpegts.section_crc(b"123456789") == 0x0376E6E7


def test_columns(odd, nothing):
    rows = {(r.doc_id, r.n_bytes): r for r in mpegts.features(mpegts.store(odd.select("doc_id", "text"))).collect()}
    for r in odd.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        got = rows[r.doc_id, len(raw)]
        assert got.payload_bytes == len(payload) and got.payload_sha256 == hashlib.sha256(payload).hexdigest() and got.tail_crc32 == zlib.crc32(payload[-32:])
        assert got.media_bytes % 188 == 0 and got.feature.endswith("cc_errors=0;ok=1")
        units = len(payload) // 576
        assert [tuple(p) for p in got.access_points] == [(k * 576, k * 1080) for k in range(0, units, 64)]
    assert mpegts.features(mpegts.store(nothing)).count() == 0
    clash = odd.selectExpr("doc_id", "text", "'x' AS media", "1 AS n_bytes", "2 AS feature", "3 AS payload_sha256", "4 AS kept")
    again = {(r.doc_id, r.n_bytes): r for r in mpegts.features(mpegts.store(clash)).collect()}
    assert {k: r.feature for k, r in again.items()} == {k: r.feature for k, r in rows.items()} and {r.kept for r in again.values()} == {4}


def test_parsed_table(spark):
    rows = spark.createDataFrame([(1, bytearray(mpegts.mux(mpegts.padded(b"abc")))), (2, None), (3, bytearray(b"junk"))], "id int, media binary")
    found = {r.id: r for r in mpegts.parse(rows).collect()}
    assert found[1].ok and bytes(found[1].streams[0].data) == mpegts.padded(b"abc") and found[1].streams[0].random_access == [True]
    assert not found[2].ok and found[2].packets == 0 and not found[3].ok
