"""Media columns: an Ogg container written and read in Arrow batches.

A payload is stored losslessly as 64-byte sample blocks dealt over two logical streams (even and odd
blocks; a payload of one block leaves the second stream with its header alone).  Each stream has its own
serial number; PACKET_BLOCKS blocks make a packet, packets are cut into lacing values and may span pages,
every page carries the container's checksum and a granule position that counts samples.  Reading verifies
each page's checksum and sequence number, reassembles packets from lacing values, demultiplexes the streams
block by block and derives times from granule positions.

Defined results: null or empty text is an empty payload (64 zero bytes); null doc_id is carried; repeated rows
and equal texts give equal media; an empty table gives no rows; very long texts are treated whole, one at
a time; further columns are ignored, whatever their names; a damaged page raises OggError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, texts_of

#: Fixed values of the container format.
CAPTURE, VERSION, CONTINUED, FIRST, LAST, MAX_SEGMENTS = b"OggS", 0, 1, 2, 4, 255
HEADER = struct.Struct("<4sBBqIIIB")
#: Ours: what the first packet of each stream says, samples a second, bytes in a block, blocks in a packet.
MAGIC, RATE, BLOCK, PACKET_BLOCKS = b"brdlpcm8", 8000, 64, 16
IDENT = struct.Struct("<8sBBIQ")

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def checksum(data: bytes) -> int:
    """The container's CRC (most significant bit first, start 0): the mirrored CRC that zlib has, on mirrored bytes."""
    reg = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{reg:032b}"[::-1], 2)


def page(kind: int, granule: int, serial: int, seq: int, lacing: bytes, body: bytes) -> bytes:
    blank = HEADER.pack(CAPTURE, VERSION, kind, granule, serial, seq, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", checksum(blank)) + blank[26:]


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets are (bytes, granule at the packet's end), the first is the header."""
    out, seq = [], 0
    lacing, body, granule, cont = bytearray(), bytearray(), -1, False

    def flush(last: bool) -> None:
        nonlocal seq, granule
        out.append(page((CONTINUED if cont else 0) | (FIRST if seq == 0 else 0) | (LAST if last else 0), granule, serial, seq, bytes(lacing), bytes(body)))
        seq += 1
        lacing.clear()
        body.clear()
        granule = -1

    for k, (data, at) in enumerate(packets):
        values, pos = [255] * (len(data) // 255) + [len(data) % 255], 0
        for j, v in enumerate(values):
            if len(lacing) == MAX_SEGMENTS:
                flush(False)
                cont = j > 0
            lacing.append(v)
            body += data[pos : pos + v]
            pos += v
        granule = at
        if k == 0 or k == len(packets) - 1:
            flush(k == len(packets) - 1)
            cont = False
    return out


def mux(payload: bytes) -> bytes:
    """The payload (a multiple of 64 bytes) as one physical stream of two multiplexed logical streams."""
    if len(payload) % BLOCK:
        raise OggError("payload is not a whole number of blocks")
    step, streams = BLOCK * PACKET_BLOCKS, []
    base = zlib.crc32(payload)
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    for n in (0, 1):
        own = blocks[n::2].tobytes()
        packets = [(IDENT.pack(MAGIC, n, 2, RATE, len(own)), 0)]
        packets += [(own[k : k + step], min(k + step, len(own))) for k in range(0, len(own), step)]
        streams.append(stream_pages((base + n) & 0xFFFFFFFF, packets))
    pages = [streams[0][0], streams[1][0]]
    for k in range(1, max(map(len, streams))):
        pages += [s[k] for s in streams if k < len(s)]
    return b"".join(pages)


def pages_of(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, int, int]]:
    """(kind, granule, serial, sequence, lacing, body start, body end) of each page, checksums verified."""
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise OggError("cut page header")
        capture, version, kind, granule, serial, seq, crc, n = HEADER.unpack_from(media, at)
        if capture != CAPTURE or version != VERSION:
            raise OggError(f"no page at {at}")
        lacing = media[at + HEADER.size : at + HEADER.size + n]
        start = at + HEADER.size + n
        end = start + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise OggError("cut page")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at {at}")
        yield kind, granule, serial, seq, lacing, start, end
        at = end


def demux(media: bytes) -> tuple[bytes, dict]:
    """The payload read back, and what reading showed: streams, pages, packets, seconds."""
    streams: dict[int, dict] = {}
    n_pages = 0
    for kind, granule, serial, seq, lacing, start, end in pages_of(media):
        n_pages += 1
        s = streams.setdefault(serial, {"packets": [], "part": bytearray(), "open": False, "seq": 0, "granule": 0, "last": False})
        if seq != s["seq"] or s["last"] or bool(kind & FIRST) != (seq == 0) or bool(kind & CONTINUED) != s["open"]:
            raise OggError(f"stream {serial}: page {seq} out of order")
        s["seq"] += 1
        pos = start
        for v in lacing:
            s["part"] += media[pos : pos + v]
            pos += v
            s["open"] = v == 255
            if v < 255:
                s["packets"].append(bytes(s["part"]))
                s["part"] = bytearray()
        if granule >= 0:
            if granule < s["granule"]:
                raise OggError(f"stream {serial}: granule positions fall")
            s["granule"] = granule
        s["last"] = bool(kind & LAST)
    order: dict[int, dict] = {}
    for s in streams.values():
        if not s["last"] or s["open"] or not s["packets"]:
            raise OggError("a stream has no end")
        magic, n, _, s["rate"], size = IDENT.unpack(s["packets"][0])
        if magic != MAGIC or sum(map(len, s["packets"][1:])) != size or s["granule"] != size:
            raise OggError("a stream's length differs from its header's")
        order[n] = s
    if sorted(order) != [0, 1]:
        raise OggError("the even or the odd blocks are missing")
    own = [np.frombuffer(b"".join(order[n]["packets"][1:]), np.uint8) for n in (0, 1)]
    if any(len(x) % BLOCK for x in own) or len(own[0]) - len(own[1]) not in (0, BLOCK):
        raise OggError("the streams' blocks don't alternate")
    blocks = np.empty(((len(own[0]) + len(own[1])) // BLOCK, BLOCK), np.uint8)
    for n in (0, 1):
        blocks[n::2] = own[n].reshape(-1, BLOCK)
    seconds = sum(s["granule"] / s["rate"] for s in order.values())
    return blocks.tobytes(), {"streams": len(order), "pages": n_pages, "packets": sum(len(s["packets"]) for s in order.values()), "seconds": seconds}


def feature(payload: bytes, seen: dict) -> str:
    """Features computed from what was read back: layout, playing time, mean and peak sample."""
    mean = sum(payload) / len(payload) if payload else 0.0
    return f"streams={seen['streams']};pages={seen['pages']};packets={seen['packets']};seconds={seen['seconds']:.6f};mean={mean:.4f};peak={max(payload, default=0)}"


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8")
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (binary column) for every whole text; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts = texts_of(b)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([mux(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """What reading a media column (doc_id, n_bytes, media) gives: digests, sizes, features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for media in b.column(2).to_pylist():
                payload, seen = demux(media)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, seen)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_media(documents(spark, sf_dir)))
