"""Ogg containers as a media column: writing, and reading with every check the format allows.

Reading verifies page checksums, reassembles packets from lacing values, demultiplexes logical
streams by serial number and derives timestamps from granule positions.  Samples are 8-bit
unsigned PCM in the OggPCM mapping; a second logical stream carries the unpadded length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import docs, map_text, prepare

CONTINUED, FIRST, LAST = 1, 2, 4
PACKET = 8192
RATE = 8000
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEADER = struct.Struct("<4sBBqIIIB")
#: OggPCM main header: magic, major, minor, format (1: unsigned 8 bit), rate, bits, channels, frames in a packet, further headers.
_PCM = struct.Struct(">8sHHIIBBHI")


def page_crc(page: bytes) -> int:
    """Polynomial 0x04C11DB7, most significant bit first, from 0, nothing inverted.

    It equals the common reflected CRC over mirrored bytes, which zlib computes.
    """
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return b"".join((head[:22], crc.to_bytes(4, "little"), head[26:], body))


def pages_of(serial: int, packets: list[tuple[bytes, int]], headers: int = 1) -> list[bytes]:
    """The pages of one logical stream from (packet, granule position at its end).

    Each of the first ``headers`` packets ends its page.
    """
    pages, lacing, body, granule, flags, number = [], bytearray(), [], -1, FIRST, 0

    def flush(more: bool) -> None:
        nonlocal lacing, body, granule, flags, number
        pages.append(_page(flags, granule, serial, number, bytes(lacing), b"".join(body)))
        lacing, body, granule, flags, number = bytearray(), [], -1, CONTINUED if more else 0, number + 1

    for k, (packet, at) in enumerate(packets):
        whole, rest = divmod(len(packet), 255)
        values, start = bytes([255] * whole + [rest]), 0
        while values:
            take = values[: 255 - len(lacing)]
            size = sum(take)
            lacing += take
            body.append(packet[start : start + size])
            start, values = start + size, values[len(take) :]
            if not values:
                granule = at
            if len(lacing) == 255 and (values or k < len(packets) - 1) or not values and k < headers:
                flush(bool(values))
    if lacing or not pages:
        flush(False)
    last = bytearray(pages[-1])
    last[5] |= LAST
    last[22:26] = bytes(4)
    last[22:26] = page_crc(bytes(last)).to_bytes(4, "little")
    return [*pages[:-1], bytes(last)]


def mux(streams: list[list[bytes]]) -> bytes:
    """Interleave logical streams: first pages of all, then page by page in turn."""
    out = [s[0] for s in streams]
    for k in range(1, max(map(len, streams))):
        out += [s[k] for s in streams if k < len(s)]
    return b"".join(out)


@dataclass
class Logical:
    """One logical stream as read back."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at the end of the packet, or None where no page states it.
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    _next: int = 0
    _open: list[bytes] | None = None

    def add(self, flags: int, granule: int, number: int, lacing: bytes, body: memoryview) -> None:
        if number != self._next:
            self.gaps += 1
            self._open = None
        self._next, self.pages, at = number + 1, self.pages + 1, 0
        parts, skip = (self._open, False) if flags & CONTINUED and self._open is not None else ([], bool(flags & CONTINUED))
        ends, size = 0, 0
        for value in lacing:
            size += value
            if value < 255:
                if not skip:
                    parts.append(bytes(body[at : at + size]))
                    self.packets.append(b"".join(parts))
                    self.granules.append(None)
                    ends += 1
                parts, skip, at, size = [], False, at + size, 0
        if lacing and lacing[-1] == 255:
            parts.append(bytes(body[at : at + size]))
            self._open = None if skip else parts
        else:
            self._open = None
        if ends and granule >= 0:
            self.granules[-1] = granule
        self.ended |= bool(flags & LAST)


def demux(data: bytes) -> tuple[dict[int, Logical], int]:
    """Logical streams by serial number, and how many pages failed their checksum or were cut.

    A bad page is left out and reading resumes at the next capture pattern; the stream it
    belonged to shows a gap, and no packet that crosses the gap is returned.
    """
    streams: dict[int, Logical] = {}
    at, bad, view = 0, 0, memoryview(data)
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > len(data):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(lacing)
        if version or len(lacing) < n or end > len(data) or page_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            bad, at = bad + 1, at + 1
            continue
        streams.setdefault(serial, Logical(serial)).add(flags, granule, number, lacing, view[start:end])
        at = end
    return streams, bad


def timestamps(stream: Logical, lengths: list[int], rate: int) -> list[float]:
    """Seconds at which each data packet starts, from the granule positions pages state.

    Packets between two stated positions are placed backwards from the later one by ``lengths``.
    """
    ends: list[int] = [0] * len(lengths)
    known = stream.granules[len(stream.granules) - len(lengths) :]
    after = None
    for k in range(len(lengths) - 1, -1, -1):
        after = known[k] if known[k] is not None else None if after is None else after - lengths[k + 1]
        ends[k] = after if after is not None else sum(lengths[: k + 1])
    return [(e - n) / rate for e, n in zip(ends, lengths)]


def encode_samples(payload: bytes, n_bytes: int) -> bytes:
    """A payload as 8-bit PCM in one logical stream, its unpadded length in another."""
    serial = zlib.crc32(payload)
    main = _PCM.pack(b"PCM     ", 0, 0, 1, RATE, 8, 1, PACKET, 0)
    sound = [(main, 0)] + [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    note = [(b"fsnote\x00\x01", 0), (n_bytes.to_bytes(8, "little"), len(payload))]
    return mux([pages_of(serial, sound), pages_of(serial ^ 0xFFFFFFFF, note)])


def decode_samples(data: bytes) -> dict:
    """What the container holds: samples, unpadded length, starts of packets and page counts."""
    streams, bad = demux(data)
    sound = next((s for s in streams.values() if s.packets and s.packets[0][:8] == b"PCM     "), None)
    note = next((s for s in streams.values() if s.packets and s.packets[0][:6] == b"fsnote"), None)
    if bad or sound is None or note is None or sound.gaps or note.gaps:
        raise ValueError(f"not a whole stream: {bad} bad pages, {len(streams)} logical streams")
    rate = _PCM.unpack(sound.packets[0])[4]
    packets = sound.packets[1:]
    return {
        "payload": b"".join(packets), "n_bytes": int.from_bytes(note.packets[1], "little"), "rate": rate, "streams": len(streams),
        "pages": sound.pages + note.pages, "packets": len(packets), "starts": timestamps(sound, list(map(len, packets)), rate),
    }


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def feature(got: dict) -> str:
    """Duration, layout, level, loudness and zero crossings of the samples read back."""
    x = np.frombuffer(got["payload"], np.uint8)
    # Whole-number sums: the same on every machine.
    seen, level = np.bincount(x, minlength=256), np.arange(256)
    mean, power = int((seen * level).sum()) / len(x), int((seen * level * level).sum()) / len(x)
    signs = x >= 128
    crossings = int(np.count_nonzero(signs[1:] != signs[:-1]))
    return f"seconds={len(x) / got['rate']:.4f};last_start={got['starts'][-1]:.4f};streams={got['streams']};pages={got['pages']};packets={got['packets']};mean={mean:.4f};rms={power**0.5:.3f};crossings={crossings}"


def media_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store every whole text as Ogg, read it back, describe what came back; no shuffle.

    A null text counts as empty (64 zero bytes).  Null and repeated ids pass through; equal texts
    give equal media.  With ``keep_media`` the container is returned as ``media``.
    """
    prepare(df.sparkSession)

    def run(ids: list, texts: list) -> list[list]:
        rows = []
        for text in texts:
            payload, n = padded(text)
            media = encode_samples(payload, n)
            got = decode_samples(media)
            back = got["payload"]
            row = (
                got["n_bytes"], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media),
                hashlib.sha256(media).hexdigest(), feature(got)
            )
            rows.append((*row, media) if keep_media else row)
        return [ids, *map(list, zip(*rows))]

    id_type = df.schema[id_col].dataType.simpleString()
    kept = ", media binary" if keep_media else ""
    return map_text(
        df.select(id_col, text_col), run,
        f"{id_col} {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string{kept}"
    )


def op6_ogg(spark, sf_dir):
    """Query: every whole text of ``documents`` through an Ogg container."""
    return media_documents(docs(spark, sf_dir))
