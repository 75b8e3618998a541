"""Matroska: round trips, hand-made elements, damage."""

import hashlib
import struct
import zlib

from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import matroska as m


@given(st.binary(min_size=1, max_size=40_000))
def test_round_trip(payload):
    data = m.mux(payload)
    media = m.parse(data)
    assert media.status == "ok" and m.demux(data, media) == payload
    assert media.cues == [(1, t, o) for t, o in zip((c[1] for c in media.cues), (data.index(m.CLUSTER.to_bytes(4, "big"), c[2]) for c in media.cues))]
    times = [p[1] for p in media.packets]
    assert times == [i * 512 * 125_000 for i in range(len(times))]


def body(*parts, ident=m.SEGMENT, unknown=False):
    inner = b"".join(parts)
    return ident.to_bytes(4, "big") + (b"\x01" + b"\xff" * 7 if unknown else m.vint(len(inner))) + inner


TRACKS = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 1) + m.number(m.TRACK_TYPE, 1) + m.element(m.CODEC_ID, b"V_X") + m.number(m.DEFAULT_DURATION, 40_000_000)))


def test_all_lacings_and_groups():
    frames = [b"a" * 300, b"b" * 5, b"c" * 700, b"d"]
    blocks = [m.block(1, 0, frames, "xiph"), m.block(1, 10, frames, "ebml"), m.block(1, -3, [b"xy", b"zw"], "fixed"), m.block(1, 20, [b"q"], "none", key=False)]
    group = m.element(m.BLOCK_GROUP, m.block(1, 30, [b"g1", b"g2"], "fixed", ident=m.BLOCK) + m.element(m.REFERENCE_BLOCK, b"\xff"))
    data = m.HEAD + body(TRACKS, m.element(m.CLUSTER, m.number(m.TIMESTAMP, 100) + b"".join(blocks) + group))
    media = m.parse(data)
    assert media.status == "ok" and media.lacings == {"none": 1, "xiph": 1, "fixed": 2, "ebml": 1} and media.blocks == 5
    assert [data[o : o + n] for *_, o, n in media.packets] == [*frames, *frames, b"xy", b"zw", b"q", b"g1", b"g2"]
    assert [p[1] // 1_000_000 for p in media.packets] == [100, 140, 180, 220, 110, 150, 190, 230, 97, 137, 120, 130, 170]
    assert [p[6] for p in media.packets] == [True] * 10 + [False] * 3


def test_unknown_sizes_and_unknown_elements():
    void = m.element(0xEC, b"\0" * 9)
    clusters = [body(m.number(m.TIMESTAMP, t), m.block(1, 0, [bytes([t])], "none"), void, ident=m.CLUSTER, unknown=True) for t in (1, 2)]
    data = m.HEAD + body(void, TRACKS, *clusters, unknown=True)
    media = m.parse(data)
    assert media.status == "ok" and media.clusters == 2 and m.demux(data, media) == b"\1\2" and [p[1] for p in media.packets] == [1_000_000, 2_000_000]


def test_vints():
    for n in (0, 126, 127, 128, 16382, 16383, 2**21, 2**35, 2**56 - 2):
        assert m.read_vint(m.vint(n), 0)[:2] == (n, len(m.vint(n)))
    assert m.read_vint(b"\xff", 0)[2] and not m.read_vint(b"\x40\x7f", 0)[2]


def test_damage():
    whole = m.mux(bytes(range(256)) * 200)
    assert m.parse(None).status == m.parse(b"").status == "empty" and m.parse(b"RIFF....").status == "invalid"
    for n in (5, len(m.HEAD) + 6, 200, 5000, len(whole) - 3):
        cut = m.parse(whole[:n])
        assert cut.status == "truncated" and all(p[7] + p[8] <= n for p in cut.packets)
    for at in range(0, 400, 7):
        m.parse(whole[:at] + bytes([whole[at] ^ 0x5A]) + whole[at + 1 :])  # never raises
    bad = m.HEAD + body(m.element(m.CLUSTER, m.element(m.SIMPLE_BLOCK, m.vint(1) + struct.pack(">hB", 0, 2) + b"\x05\xff\xff\x01x")))
    assert m.parse(bad).status in ("invalid", "truncated")


def test_tables(spark, odd, none):
    digest = {(r.doc_id, r.n_bytes): r for r in m.media_digest(m.text_media(odd)).collect()}
    for doc_id, text in ((7, "é ü 漢字 😀 x"), (3, ""), (4, ""), (9, "a" * 300_000)):
        raw = text.encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = digest[doc_id, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert m.media_digest(m.text_media(odd)).count() == odd.count() and m.media_digest(m.text_media(none)).count() == 0
    files = spark.createDataFrame([("x", bytearray(m.mux(b"abc" * 400))), ("y", None), ("z", bytearray(b"junk"))], "name string, blob binary")
    found = {r.id: r for r in m.file_table(files, "name", "blob").collect()}
    assert (found["x"].status, found["x"].n_packets, found["x"].media_payload, found["y"].status, found["z"].status) == ("ok", 3, 1200, "empty", "invalid")
    packets = m.packet_table(files, "name", "blob").collect()
    assert [(p.id, p.byte_length) for p in packets] == [("x", 512), ("x", 512), ("x", 176)]
