import hashlib
import os
import struct

import pytest

from tesselle.llm import ogg


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_checksum_equals_bitwise_division():
    for n in (0, 1, 27, 500):
        d = os.urandom(n)
        assert ogg.page_crc(d) == slow_crc(d)


@pytest.mark.parametrize("n", [576, 1152, 576 * 170, 576 * 171, 576 * 401])
def test_samples_round_trip(n):
    p = os.urandom(n)
    got, info = ogg.samples(ogg.store_samples(p))
    assert got == p and info["streams"] == 2 and info["bad"] == 0


@pytest.mark.parametrize("n_streams", [1, 2, 3, 5])
def test_times_of_any_number_of_streams(n_streams):
    p = os.urandom(576 * 6 + 100)
    media = ogg.store_samples(p, n_streams=n_streams)
    got, info = ogg.samples(media)
    assert got == p and info["streams"] == n_streams
    times = sorted(t for s in ogg.read_streams(media)[0].values() for t, _ in ogg.timed_frames(s, n_streams))
    assert times == [576 * k for k in range(7)]


def test_packets_over_page_ends_and_empty_packets():
    big = os.urandom(200_000)
    packets = [b"head", big, b"x" * 255, b"", b"y" * 510]
    media = b"".join(p for _, p in ogg.stream_pages(7, packets, [0, 5, 6, 7, 8]))
    streams, bad = ogg.read_streams(media)
    assert bad == 0 and streams[7].packets == packets and streams[7].ended and streams[7].granules[-1] == 8


def test_damage_loses_one_page_only():
    p = os.urandom(576 * 600)
    media = bytearray(ogg.store_samples(p))
    at = [k for k in range(len(media) - 4) if media[k : k + 4] == b"OggS"]
    media[at[3] + 300] ^= 1
    streams, bad = ogg.read_streams(bytes(media))
    assert bad >= 1 and sum(s.lost for s in streams.values()) == 1
    kept = {t: f for s in streams.values() for t, f in ogg.timed_frames(s, 2)}
    assert len(kept) > 400 and all(p[t : t + 576] == f for t, f in kept.items())
    assert ogg.read_streams(b"junk") == ({}, 0) and ogg.read_streams(None) == ({}, 0) and ogg.read_streams(b"OggS")[1] == 1


def test_column(spark, odd):
    got = {r.doc_id: r for r in ogg.decode_media(ogg.encode_media(odd)).collect()}
    texts = {r.doc_id: r.text for r in odd.collect()}
    for k, r in got.items():
        raw = (texts[k] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest()) and r.bad_pages == 0
    assert got[6].media_sha256 == got[7].media_sha256 and got[6].feature == got[7].feature and got[1].feature == got[2].feature
    assert ogg.decode_media(ogg.encode_media(odd.limit(0))).count() == 0
    assert struct.calcsize("<4sBBQIIIB") == 27
