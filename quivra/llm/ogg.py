"""Media columns in Ogg: pages with checksums, packets by lacing values, logical streams, times by granule positions.

A payload of 8-bit samples is stored losslessly as two multiplexed logical streams, its even and its odd samples.
Each begins with a header packet; data packets may go over page ends. Reading finds pages by their capture
pattern, verifies each checksum, joins packets over pages, tells streams apart by serial number and takes
times from granule positions. A damaged page is counted and skipped, and the packet it belongs to is lost, no other.

Nulls: a null text counts as empty and has one padded unit; a null media column decodes to no streams.
Equal payloads have equal bytes: serial numbers come from the payload. Repeated rows are stored one by one."""

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

from quivra.llm.common import id_and_text, quoted

UNIT, RATE, PACKET = 192, 8000, 4000
HEAD = struct.Struct("<4sBBqIIIB")
MAGIC = b"\x01qpcm\x00"
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7, most significant bit first, no inversions: zlib's of reversed bits."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    page = head + lacing + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def _pages(samples: bytes, serial: int, header: bytes) -> list[bytes]:
    """Pages of one logical stream; the granule position counts the samples of packets that have ended."""
    out = [_page(2, 0, serial, 0, bytes([len(header)]), header)]
    whole, rest = divmod(len(samples), PACKET)
    sizes = [PACKET] * whole + ([rest] if rest or not whole else [])
    lacing = b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    at, ended = 0, 0
    for k in range(0, len(lacing), 255):
        part = lacing[k : k + 255]
        n = sum(part)
        packets = len(part) - part.count(255)
        ended = min(len(samples), ended + packets * PACKET)
        flags = (k > 0 and lacing[k - 1] == 255) | (4 if k + 255 >= len(lacing) else 0)
        out.append(_page(flags, ended if packets else -1, serial, len(out), part, samples[at : at + n]))
        at += n
    return out


def mux(payload: bytes, unpadded: int) -> bytes:
    """The payload as an Ogg file of two logical streams."""
    serial = zlib.crc32(payload)
    streams = [_pages(payload[c::2], serial ^ c, MAGIC + struct.pack("<BIQ", c, RATE, unpadded)) for c in (0, 1)]
    longest = max(map(len, streams))
    return b"".join(s[k] for k in range(longest) for s in streams if k < len(s))


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granule: int = 0
    pages: int = 0
    ended: bool = False
    lost: int = 0
    open: list[bytes] | None = None
    number: int = -1


def demux(data: bytes | None) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and how many pages were damaged."""
    streams: dict[int, Stream] = {}
    bad, at, data = 0, 0, data or b""
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > len(data):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = data[at:end]
        if version or len(lacing) < n or end > len(data) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad, at = bad + 1, at + 4
            continue
        s = streams.setdefault(serial, Stream(serial))
        if number != s.number + 1:
            s.lost, s.open = s.lost + 1, None
        s.number, s.pages, s.ended = number, s.pages + 1, s.ended or bool(flags & 4)
        if granule >= 0:
            s.granule = granule
        parts = s.open if flags & 1 else []
        if not flags & 1 and s.open:
            s.lost += 1
        place, start, run = at + 27 + n, at + 27 + n, 0
        for value in lacing:
            run += value
            place += value
            if value < 255:
                if parts is not None:
                    parts.append(data[start:place])
                    s.packets.append(parts[0] if len(parts) == 1 else b"".join(parts))
                parts, start = [], place
        if n and lacing[-1] == 255:
            s.open = [*parts, data[start:place]] if parts is not None else None
        else:
            s.open = []
        at = end
    return streams, bad


def payload_of(data: bytes) -> tuple[bytes, int, dict[int, Stream]]:
    """(payload, unpadded length, streams) of what mux() wrote; raises if anything is missing."""
    streams, bad = demux(data)
    by = {s.packets[0][len(MAGIC)]: s for s in streams.values() if s.packets and s.packets[0].startswith(MAGIC)}
    if bad or sorted(by) != [0, 1] or any(s.lost or not s.ended for s in by.values()):
        raise ValueError("damaged media")
    halves = [b"".join(by[c].packets[1:]) for c in (0, 1)]
    if any(len(h) != by[c].granule for c, h in enumerate(halves)):
        raise ValueError("samples are missing")
    out = bytearray(sum(map(len, halves)))
    out[0::2], out[1::2] = halves
    return bytes(out), struct.unpack_from("<Q", by[0].packets[0], len(MAGIC) + 5)[0], by


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT), len(raw)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for at in range(0, len(ids), 256):  # media are as large as texts: small batches on
            media = [mux(*padded(x.as_py())) for x in texts[at : at + 256]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 256], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each whole text, padded, as an Ogg file."""
    return id_and_text(df, id_col, text_col).mapInArrow(_store, "doc_id long, media binary")


def _features(payload: bytes, streams: dict[int, Stream]) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    even, odd = x[0::2], x[1::2]
    seconds = max(s.granule for s in streams.values()) / RATE
    pages, packets = (sum(f(s) for s in streams.values()) for f in (lambda s: s.pages, lambda s: len(s.packets)))
    return f"seconds={seconds:.6f};pages={pages};packets={packets};mean={int(x.sum()) / len(x):.4f};power={int((x * x).sum()) / len(x):.4f};peak={int(x.max())};difference={int(np.abs(even - odd).sum()) / len(even):.4f}"


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = media.as_py()
            payload, n, streams = payload_of(data)
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), _features(payload, streams)))
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _DIGEST.split(", ")])


def digest(media: DataFrame) -> DataFrame:
    """What is read back from store()."""
    return media.mapInArrow(_digest, _DIGEST)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "serial", "pages", "packets", "bytes", "granule", "ended", "lost", "damaged"]
    for batch in batches:
        rows = []
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1)):
            found, bad = demux(media.as_py())
            rows += [(key, s.serial, s.pages, len(s.packets), sum(map(len, s.packets)), s.granule, s.ended, s.lost, bad) for s in found.values()]
        columns = list(zip(*rows)) or [()] * 9
        kinds = [pa.int64()] * 6 + [pa.bool_()] + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def streams(df: DataFrame, id_col: str, media_col: str, rate: int = RATE) -> DataFrame:
    """One row for each logical stream of any Ogg column, with its end time in seconds."""
    found = df.select(quoted(id_col).cast("long"), quoted(media_col)).mapInArrow(_streams, "id long, serial long, pages long, packets long, bytes long, granule long, ended boolean, lost long, damaged long")
    return found.withColumn("seconds", F.col("granule") / rate)
