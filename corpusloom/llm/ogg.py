"""Media columns: the Ogg container (RFC 3533), written and read in Arrow batches.

Reading verifies each page's checksum, sequence number and flags, puts packets together from lacing values across pages,
separates logical streams by serial number and derives times from granule positions. Writing stores a byte payload
losslessly as unsigned 8-bit PCM packets (an OggPCM header, one channel) beside a second logical stream that holds the
CRC-32 of every PCM packet; reading holds one against the other.

A damaged page, a gap in the sequence, a missing end or a checksum that differs raises OggError: nothing is skipped.
Nulls and empty texts are a payload of zero bytes only; long payloads take more pages. Equal payloads give equal files.
An empty table gives an empty result. Other columns than the two named are neither read nor returned.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean

RATE = 8000
#: Samples in a PCM packet; packets of one page; bytes that payloads are padded to.
PACKET, PAGE_PACKETS, BLOCK = 4096, 8, 64
AUDIO, CHECKS = 0x0A0D10, 0xC4EC5
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes are not a whole, undamaged Ogg file."""


def page_crc(page: bytes) -> int:
    """Ogg's checksum: polynomial 0x04C11DB7, most significant bit first, from 0. It is the mirrored CRC-32 of mirrored bytes."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


class StreamWriter:
    """Pages of one logical stream; a packet that does not fit a page's 255 lacing values goes on in the next."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def pages(self, packets: list[tuple[bytes, int]], last: bool) -> Iterator[bytes]:
        """packets: (bytes, granule position at its end). All in one page where lacing allows."""
        lacing, body, granule, continued = bytearray(), bytearray(), -1, False
        for k, (data, end) in enumerate(packets):
            values = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
            at = 0
            for i, v in enumerate(values):
                if len(lacing) == 255:
                    yield self._emit(lacing, body, granule, continued, False)
                    continued, lacing, body, granule = i > 0, bytearray(), bytearray(), -1
                lacing.append(v)
                body += data[at : at + v]
                at += v
            granule = end
        if lacing:
            yield self._emit(lacing, body, granule, continued, last)

    def _emit(self, lacing: bytearray, body: bytearray, granule: int, continued: bool, last: bool) -> bytes:
        flags = continued | 2 * (self.number == 0) | 4 * last
        page = _page(self.serial, self.number, flags, granule, bytes(lacing), bytes(body))
        self.number += 1
        return page


def write_pcm8(payload: bytes) -> bytes:
    """An Ogg file of two logical streams: the payload as unsigned 8-bit samples, and the packets' CRC-32 values."""
    audio, checks = StreamWriter(AUDIO), StreamWriter(CHECKS)
    head = struct.pack(">8sHHIIBBHI", b"PCM     ", 0, 0, 1, RATE, 8, 1, PACKET, 0)
    out = [*audio.pages([(head, 0)], False), *checks.pages([(b"CRC32   ", 0)], False)]
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min(i + PACKET, len(payload)) for i in range(0, len(payload), PACKET)]
    for k in range(0, len(packets), PAGE_PACKETS):
        group, last = range(k, min(k + PAGE_PACKETS, len(packets))), k + PAGE_PACKETS >= len(packets)
        out += audio.pages([(packets[i], ends[i]) for i in group], last)
        out += checks.pages([(struct.pack("<I", zlib.crc32(packets[i])), ends[i]) for i in group], last)
    return b"".join(out)


@dataclass
class LogicalStream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # -1 where no page states one for the packet
    pages: int = 0
    ended: bool = False
    open: bytearray | None = None


def read(data: bytes) -> dict[int, LogicalStream]:
    """Logical streams by serial number."""
    streams: dict[int, LogicalStream] = {}
    at = 0
    while at < len(data):
        if len(data) < at + 27 or data[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc = struct.unpack_from("<4sBBqIII", data, at)
        segments = data[at + 26]
        body = at + 27 + segments
        lacing = data[at + 27 : body]
        end = body + sum(lacing)
        if version or len(lacing) < segments or end > len(data):
            raise OggError(f"page at byte {at} is cut off or of an unknown version")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        s = streams.get(serial)
        if bool(flags & 2) != (s is None):
            raise OggError(f"beginning of stream {serial}")
        s = streams.setdefault(serial, LogicalStream())
        if number != s.pages or s.ended or bool(flags & 1) != (s.open is not None):
            raise OggError(f"sequence of stream {serial} at page {number}")
        s.pages += 1
        packet, whole = s.open if s.open is not None else bytearray(), 0
        s.open = None
        for v in lacing:
            packet += data[body : body + v]
            body += v
            if v < 255:
                s.packets.append(bytes(packet))
                s.granules.append(-1)
                packet, whole = bytearray(), whole + 1
        if lacing and lacing[-1] == 255:
            s.open = packet
        if whole and granule != -1:
            s.granules[-1] = granule  # a page's position is that of the last packet that ends in it
        s.ended = bool(flags & 4)
        at = end
    for serial, s in streams.items():
        if not s.ended or s.open is not None:
            raise OggError(f"stream {serial} does not end")
    return streams


def timestamps(stream: LogicalStream, samples: list[int], rate: int) -> list[float]:
    """Seconds at which each packet ends: from its granule position, else back from the next one that is stated."""
    ends, known = [0] * len(stream.packets), None
    for i in range(len(stream.packets) - 1, -1, -1):
        if stream.granules[i] >= 0:
            known = stream.granules[i]
        ends[i] = known if known is not None else 0
        if known is not None:
            known -= samples[i]
    return [e / rate for e in ends]


def read_pcm8(data: bytes) -> tuple[bytes, dict]:
    """The payload and its features, from the stored bytes alone."""
    streams = read(data)
    if AUDIO not in streams or CHECKS not in streams or len(streams) != 2:
        raise OggError("other logical streams than expected")
    audio, checks = streams[AUDIO], streams[CHECKS]
    magic, _, _, kind, rate, bits, channels, _, _ = struct.unpack(">8sHHIIBBHI", audio.packets[0])
    if (magic, kind, bits, channels) != (b"PCM     ", 1, 8, 1):
        raise OggError("not 8-bit PCM of one channel")
    if [struct.pack("<I", zlib.crc32(p)) for p in audio.packets[1:]] != checks.packets[1:]:
        raise OggError("a packet differs from its CRC-32")
    payload = b"".join(audio.packets[1:])
    ends = timestamps(audio, [0, *map(len, audio.packets[1:])], rate)
    if ends[-1] != len(payload) / rate:
        raise OggError("granule positions do not fit the samples")
    wave = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    sign = wave >= 0
    return payload, {
        "samples": len(payload),
        "seconds": ends[-1],
        "packets": len(audio.packets) - 1,
        "pages": audio.pages + checks.pages,
        "sum": int(wave.sum()),
        "energy": int((wave * wave).sum()),
        "peak": int(np.abs(wave).max(initial=0)),
        "crossings": int(np.count_nonzero(sign[1:] != sign[:-1])),
    }


def padded(text: str = "text"):
    """The text as UTF-8, with bytes 0 up to a positive multiple of BLOCK."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return F.rpad(data, F.greatest(F.lit(1), F.ceil(F.octet_length(data) / BLOCK)).cast("int") * BLOCK, F.lit(b"\0"))


def store(payloads: DataFrame) -> DataFrame:
    """Of key and payload columns, key and media: the payload as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                media = pa.array([write_pcm8(x) for x in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), media], names=batch.schema.names[:1] + ["media"])

    key = payloads.schema.fields[0]
    return payloads.mapInArrow(lean(run), f"`{key.name}` {key.dataType.simpleString()}, media binary")


def extract(media: DataFrame) -> DataFrame:
    """Of key and media columns, key, media, the payload read back, and its features as JSON with sorted names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [read_pcm8(x) for x in part.column(1).to_pylist()]
                payload, feature = pa.array([r[0] for r in rows], pa.binary()), pa.array([json.dumps(r[1], sort_keys=True) for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), payload, feature], names=[*batch.schema.names[:2], "payload", "feature"])

    key = media.schema.fields[0]
    return media.mapInArrow(lean(run), f"`{key.name}` {key.dataType.simpleString()}, media binary, payload binary, feature string")


def documents_as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload, feature for each document."""
    key = F.struct("doc_id", F.octet_length(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("n_bytes"))
    return extract(store(docs.select(key.alias("key"), padded().alias("payload")))).select("key.*", "media", "payload", "feature")


def digest(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    size = F.octet_length("payload")
    return media.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
