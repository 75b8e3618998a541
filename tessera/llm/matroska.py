"""Media columns: Matroska.

``mux`` writes a byte string as 8-bit PCM samples into a Matroska file, ``parse`` reads any Matroska bytes: EBML elements
with variable-length identifiers and sizes (unknown sizes included), clusters, simple blocks and block groups with all
four kinds of lacing, and cues. ``packet_table`` and ``file_table`` apply the parser to a binary column.

Edge cases: null or empty bytes give status ``empty`` and no packets; bytes that do not begin with an EBML header give
``invalid``; a file that ends inside an element gives ``truncated`` with every packet that is whole. No input raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import arrow_map, col, id_and_text

# Element identifiers of the Matroska specification (RFC 9559), with their length markers.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
ENTERED = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}
LACINGS = ("none", "xiph", "fixed", "ebml")

# What the muxer writes: 8 kHz mono samples, so that a tick is one sample.
RATE, FRAME, LACE, BLOCKS = 8000, 512, 8, 8


def vint(value: int, length: int = 0) -> bytes:
    """A size or an unsigned number as an EBML variable-length integer."""
    n = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return ((1 << 7 * n) | value).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> bytes:
    """The body of a laced block after its flags."""
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == "ebml":
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            n = next(n for n in range(1, 9) if abs(b - a) < (1 << (7 * n - 1)) - 1)
            head += vint(b - a + (1 << (7 * n - 1)) - 1, n)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing takes frames of one size")
    return head + b"".join(frames)


def block(track: int, ticks: int, frames: list[bytes], kind: str, ident: int = SIMPLE_BLOCK, key: bool = True) -> bytes:
    flags = (0x80 if key and ident == SIMPLE_BLOCK else 0) | LACINGS.index(kind) << 1
    return element(ident, vint(track) + struct.pack(">hB", ticks, flags) + (frames[0] if kind == "none" else lace(frames, kind)))


# The parts of the header that are alike in every file.
HEAD = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8)
               + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
TRACK = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2)
                + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME * 10**9 // RATE)
                + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """A Matroska file whose one audio track holds payload as 8-bit samples.

    Frames of 512 samples go eight to a block, with fixed lacing where sizes are equal and EBML or Xiph lacing (by turns)
    where the last frame is shorter; eight blocks make a cluster, and each cluster has a cue.
    """
    info = element(INFO, number(TIMESTAMP_SCALE, 10**9 // RATE) + element(DURATION, struct.pack(">d", len(payload)))
                   + element(MUXING_APP, b"tessera") + element(WRITING_APP, b"tessera"))
    body, at, cues = [info, TRACK], len(info) + len(TRACK), []
    for k, start in enumerate(range(0, len(payload), FRAME * LACE * BLOCKS)):
        parts = [number(TIMESTAMP, start)]
        for b in range(start, min(start + FRAME * LACE * BLOCKS, len(payload)), FRAME * LACE):
            chunk = payload[b : b + FRAME * LACE]
            frames = [chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)]
            kind = "none" if len(frames) == 1 else "fixed" if len(frames[-1]) == FRAME else ("ebml", "xiph")[k % 2]
            parts.append(block(1, b - start, frames, kind))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    if cues:
        body.append(element(CUES, b"".join(cues)))
    return HEAD + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp in ns, cluster, block, lace index, lacing, keyframe, offset, length)."""

    status: str = "ok"
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    blocks: int = 0
    lacings: dict[str, int] = field(default_factory=lambda: dict.fromkeys(LACINGS, 0))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, end, whether all value bits are set (an unknown size). Raises IndexError beyond the end, ValueError if malformed."""
    first = data[at]
    if not first:
        raise ValueError("a variable-length integer longer than 8 bytes")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise IndexError
    value = int.from_bytes(data[at : at + n], "big")
    bare = value & ((1 << 7 * n) - 1)
    return (value if keep_marker else bare), at + n, bare == (1 << 7 * n) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, start, start of body, end of body) of all elements, parents before children.

    An element of unknown size ends with its parent, or where an element begins that cannot be its child.
    """
    ends: list[tuple[int, int]] = []
    while at < end:
        while ends and at >= ends[-1][1]:
            ends.pop()
        ident, p, _ = read_vint(data, at, keep_marker=True)
        size, body, unknown = read_vint(data, p)
        if ident in TOP_LEVEL or ident in (SEGMENT, EBML):
            while ends and (ends[-1][0] != SEGMENT or ident in (SEGMENT, EBML)):
                ends.pop()
        stop = (ends[-1][1] if ends else end) if unknown else body + size
        yield ident, at, body, stop
        if ident in ENTERED:
            ends.append((ident, stop))
            at = body
        else:
            at = stop


def frame_sizes(data: bytes, at: int, end: int, kind: str) -> tuple[int, list[int]]:
    """Where the first frame begins, and the size of each."""
    if kind == "none":
        return at, [end - at]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == "fixed":
        if (end - at) % count:
            raise ValueError("fixed lacing of an uneven length")
        return at, [(end - at) // count] * count
    for i in range(count - 1):
        if kind == "xiph":
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            value, after, _ = read_vint(data, at)
            n = value if not i else sizes[-1] + value - ((1 << (7 * (after - at) - 1)) - 1)
            at = after
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes beyond the block")
    return at, sizes


def parse(data: bytes | None) -> Media:
    out = Media()
    if not data:
        out.status = "empty"
        return out
    if data[:4] != EBML.to_bytes(4, "big"):
        out.status = "invalid"
        return out
    track: dict = {}
    base = cue_time = cue_track = 0
    segment, group_block = 0, -1
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b - a in (4, 8) else 0.0
    try:
        for ident, _, a, b in elements(data, 0, len(data)):
            if b > len(data):
                out.status = "truncated"
                if ident not in ENTERED:
                    break
            if ident == SEGMENT:
                segment = a
            elif ident == TIMESTAMP_SCALE:
                out.scale = uint(a, b) or 1_000_000
            elif ident == DURATION:
                out.duration = real(a, b)
            elif ident == TRACK_ENTRY:
                out.tracks.append(track := {"number": 0, "type": 0, "codec": "", "rate": 0.0, "channels": 0, "bits": 0, "default_ns": 0})
            elif ident == TRACK_NUMBER:
                track["number"] = uint(a, b)
            elif ident == TRACK_TYPE:
                track["type"] = uint(a, b)
            elif ident == CODEC_ID:
                track["codec"] = data[a:b].decode("ascii", "replace")
            elif ident == DEFAULT_DURATION:
                track["default_ns"] = uint(a, b)
            elif ident == SAMPLING_FREQUENCY:
                track["rate"] = real(a, b)
            elif ident == CHANNELS:
                track["channels"] = uint(a, b)
            elif ident == BIT_DEPTH:
                track["bits"] = uint(a, b)
            elif ident == CLUSTER:
                out.clusters, base = out.clusters + 1, 0
            elif ident == TIMESTAMP:
                base = uint(a, b)
            elif ident == BLOCK_GROUP:
                group_block = -1
            elif ident == REFERENCE_BLOCK and group_block >= 0:  # a block that refers to another is no keyframe
                out.packets[group_block:] = [(*p[:6], False, *p[7:]) for p in out.packets[group_block:]]
            elif ident == CUE_TIME:
                cue_time = uint(a, b)
            elif ident == CUE_TRACK:
                cue_track = uint(a, b)
            elif ident == CUE_CLUSTER_POSITION:
                out.cues.append((cue_track, cue_time * out.scale, segment + uint(a, b)))
            elif ident in (SIMPLE_BLOCK, BLOCK):
                number_, p, _ = read_vint(data, a)
                ticks, flags = struct.unpack_from(">hB", data, p)
                kind = LACINGS[flags >> 1 & 3]
                at, sizes = frame_sizes(data, p + 3, b, kind)
                step = next((t["default_ns"] for t in out.tracks if t["number"] == number_), 0)
                if ident == BLOCK:
                    group_block = len(out.packets)
                for i, n in enumerate(sizes):
                    out.packets.append((number_, (base + ticks) * out.scale + i * step, out.clusters - 1, out.blocks, i, kind, ident == BLOCK or bool(flags & 0x80), at, n))
                    at += n
                out.blocks += 1
                out.lacings[kind] += 1
    except (IndexError, struct.error):
        out.status = "truncated"
    except ValueError:
        out.status = "invalid"
    return out


PACKETS = ("track long, timestamp_ns long, cluster_index long, block_index long, lace_index long, lacing string, "
           "keyframe boolean, byte_offset long, byte_length long")  # fmt: skip


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per packet of every file in media_col: track, timestamp, place in cluster and block, byte range in the file."""
    rows = df.select(col(id_col).alias("id"), col(media_col).cast("binary").alias("media"))
    kind = dict(rows.dtypes)["id"]

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = [(i, *p) for i, m in zip(batch["id"].to_pylist(), batch["media"].to_pylist()) for p in parse(m).packets]
            schema = pa.schema([batch.schema.field("id"), *((n, pa.int64()) for n in ("track", "timestamp_ns", "cluster_index", "block_index", "lace_index")),
                                ("lacing", pa.string()), ("keyframe", pa.bool_()), ("byte_offset", pa.int64()), ("byte_length", pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema) if found else None

        return apply

    return arrow_map(rows, make, f"id {kind}, {PACKETS}")


def file_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per file: status, tracks as text, counts of clusters, blocks, packets, cues, and the bytes its packets hold."""
    rows = df.select(col(id_col).alias("id"), col(media_col).cast("binary").alias("media"))
    kind = dict(rows.dtypes)["id"]

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [parse(m) for m in batch["media"].to_pylist()]
            arrays = [batch["id"], pa.array([m.status for m in found]), pa.array([";".join(f"{t['number']}:{t['codec']}" for t in m.tracks) for m in found])]
            arrays += [pa.array([f(m) for m in found], pa.int64()) for f in (lambda m: m.clusters, lambda m: m.blocks, lambda m: len(m.packets), lambda m: len(m.cues), lambda m: sum(p[8] for p in m.packets))]
            return pa.RecordBatch.from_arrays(arrays, ["id", "status", "tracks", "n_clusters", "n_blocks", "n_packets", "n_cues", "media_payload"])

        return apply

    return arrow_map(rows, make, f"id {kind}, status string, tracks string, n_clusters long, n_blocks long, n_packets long, n_cues long, media_payload long")


def demux(data: bytes, media: Media, track: int = 1) -> bytes:
    """The bytes of a track's packets in file order."""
    return b"".join(data[o : o + n] for t, *_, o, n in media.packets if t == track)


def feature(media: Media) -> str:
    """Counts and extremes of a file's packet table as one line of text."""
    sizes = [p[8] for p in media.packets]
    codecs = ",".join(f"{t['number']}:{t['codec']}:{t['rate']:g}Hz:{t['channels']}ch:{t['bits']}bit" for t in media.tracks)
    laced = ",".join(f"{k}:{n}" for k, n in media.lacings.items() if n)
    return (f"tracks={codecs};clusters={media.clusters};blocks={media.blocks};packets={len(sizes)};cues={len(media.cues)};lacing={laced};"
            f"packet_bytes={min(sizes, default=0)}..{max(sizes, default=0)};last_ns={max((p[1] for p in media.packets), default=0)};duration={media.duration * media.scale / 1e9:g}")  # fmt: skip


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text (null: empty) as UTF-8, zero-padded to a positive multiple of 64, stored as a Matroska file.

    Returns doc_id, n_bytes (before padding) and media, the file. Repeated rows and repeated ids stay separate rows.
    """
    rows = id_and_text(df, id_col, text_col)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch["text"].cast(pa.binary())]
            files = [mux(t + bytes(-len(t) % 64 if t else 64)) for t in texts]
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(map(len, texts), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

        return apply

    return arrow_map(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, media binary")


def media_digest(df: DataFrame) -> DataFrame:
    """What ``text_media`` stored, read back: digests of payload and file, and the features of the packet table."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in range(6)]
            for data in batch["media"].to_pylist():
                media = parse(data)
                payload = demux(data, media)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(media))
                for c, v in zip(columns, row):
                    c.append(v)
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            return pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in columns)], ["doc_id", "n_bytes", *names])

        return apply

    return arrow_map(df, make, f"doc_id {dict(df.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_matroska(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` as Matroska files, stored, read back and digested."""
    return media_digest(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
