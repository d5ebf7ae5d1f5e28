"""QR matrices and PNG images, from the public symbol specification."""

from __future__ import annotations

import base64
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship
from . import qr as Q
from .options import LogoOptions, QrOptions

# Error correction bytes of a block, by level and version 1-40.
EC_BYTES = {
    "L": "7 10 15 20 26 18 20 24 30 18 20 24 26 30 22 24 28 30 28 28 28 28 30 30 26 28 30 30 30 30 30 30 30 30 30 30 30 30 30 30",
    "M": "10 16 26 18 24 16 18 22 22 26 30 22 22 24 24 28 28 26 26 26 26 28 28 28 28 28 28 28 28 28 28 28 28 28 28 28 28 28 28 28",
    "Q": "13 22 18 26 18 24 18 22 20 24 28 26 24 20 30 24 28 28 26 30 28 30 30 30 30 28 30 30 30 30 30 30 30 30 30 30 30 30 30 30",
    "H": "17 28 22 16 22 28 26 26 24 28 24 28 22 24 24 30 28 28 26 28 30 24 30 30 30 30 30 30 30 30 30 30 30 30 30 30 30 30 30 30",
}
# Blocks, by level and version 1-40.
BLOCKS = {
    "L": "1 1 1 1 1 2 2 2 2 4 4 4 4 4 6 6 6 6 7 8 8 9 9 10 12 12 12 13 14 15 16 17 18 19 19 20 21 22 24 25",
    "M": "1 1 1 2 2 4 4 4 5 5 5 8 9 9 10 10 11 13 14 16 17 17 18 20 21 23 25 26 28 29 31 33 35 37 38 40 43 45 47 49",
    "Q": "1 1 2 2 4 4 6 6 8 8 8 10 12 16 12 17 16 18 21 20 23 23 25 27 29 34 34 35 38 40 43 45 48 51 53 56 59 62 65 68",
    "H": "1 1 2 4 4 4 5 6 8 8 11 11 16 16 18 16 19 21 25 25 25 34 30 32 35 37 40 42 45 48 51 54 57 60 63 66 70 74 77 81",
}
#: Format bits of the levels.
FORMAT_BITS = {"L": 1, "M": 0, "Q": 3, "H": 2}

_EXP = [1]
for _ in range(255):
    _EXP.append(_EXP[-1] * 2 ^ (0x11D if _EXP[-1] >= 128 else 0))
_LOG = {v: k for k, v in enumerate(_EXP[:255])}


def _mul(a: int, b: int) -> int:
    return _EXP[(_LOG[a] + _LOG[b]) % 255] if a and b else 0


@lru_cache(maxsize=None)
def _generator(n: int) -> tuple[int, ...]:
    g = [1]
    for k in range(n):
        g = [a ^ _mul(b, _EXP[k]) for a, b in zip([*g, 0], [0, *g])]
    return tuple(g[1:])


def error_bytes(data: list[int], n: int) -> list[int]:
    rest = [0] * n
    for d in data:
        lead, rest = d ^ rest[0], [*rest[1:], 0]
        rest = [r ^ _mul(g, lead) for r, g in zip(rest, _generator(n))]
    return rest


def raw_modules(version: int) -> int:
    n = (16 * version + 128) * version + 64
    if version >= 2:
        k = version // 7 + 2
        n -= (25 * k - 10) * k - 55
        n -= 36 if version >= 7 else 0
    return n


def data_bytes(version: int, level: str) -> int:
    return raw_modules(version) // 8 - int(EC_BYTES[level].split()[version - 1]) * int(BLOCKS[level].split()[version - 1])


def alignment(version: int) -> list[int]:
    if version == 1:
        return []
    k = version // 7 + 2
    step = 26 if version == 32 else (version * 4 + k * 2 + 1) // (k * 2 - 2) * 2
    return sorted([6, *(version * 4 + 10 - step * j for j in range(k - 1))])


def _codewords(payload: bytes, version: int, level: str) -> list[int]:
    room = data_bytes(version, level)
    bits = f"0100{len(payload):0{8 if version < 10 else 16}b}" + "".join(f"{b:08b}" for b in payload)
    bits += "0" * min(4, room * 8 - len(bits))
    bits += "0" * (-len(bits) % 8)
    data = [int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)]
    data += [(0xEC, 0x11)[k % 2] for k in range(room - len(data))]
    n, ec = int(BLOCKS[level].split()[version - 1]), int(EC_BYTES[level].split()[version - 1])
    short, long_ = divmod(room, n)
    blocks, at = [], 0
    for k in range(n):
        size = short + (k >= n - long_)
        blocks.append(data[at : at + size])
        at += size
    ecs = [error_bytes(b, ec) for b in blocks]
    return [b[k] for k in range(short + 1) for b in blocks if k < len(b)] + [e[k] for k in range(ec) for e in ecs]


def _bch(value: int, poly: int, bits: int) -> int:
    rest = value << bits
    while rest.bit_length() > bits:
        rest ^= poly << (rest.bit_length() - bits - 1)
    return value << bits | rest


def _skeleton(version: int) -> tuple[np.ndarray, np.ndarray]:
    n = 17 + 4 * version
    m, fixed = np.zeros((n, n), bool), np.zeros((n, n), bool)
    m[6, :], m[:, 6] = np.arange(n) % 2 == 0, np.arange(n) % 2 == 0
    fixed[6, :] = fixed[:, 6] = True
    y, x = np.mgrid[-4:5, -4:5]
    ring = np.maximum(abs(y), abs(x))
    for cy, cx in ((3, 3), (3, n - 4), (n - 4, 3)):
        for dy in range(-4, 5):
            for dx in range(-4, 5):
                if 0 <= cy + dy < n and 0 <= cx + dx < n:
                    m[cy + dy, cx + dx], fixed[cy + dy, cx + dx] = ring[dy + 4, dx + 4] not in (2, 4), True
    at = alignment(version)
    for cy in at:
        for cx in at:
            if (cy, cx) not in ((6, 6), (6, n - 7), (n - 7, 6)):
                m[cy - 2 : cy + 3, cx - 2 : cx + 3] = ring[2:7, 2:7] != 1
                fixed[cy - 2 : cy + 3, cx - 2 : cx + 3] = True
    fixed[8, :9] = fixed[:9, 8] = fixed[8, n - 8 :] = fixed[n - 8 :, 8] = True
    if version >= 7:
        bits = _bch(version, 0x1F25, 12)
        for k in range(18):
            a, b = n - 11 + k % 3, k // 3
            m[a, b] = m[b, a] = bits >> k & 1
            fixed[a, b] = fixed[b, a] = True
    return m, fixed


def _format(m: np.ndarray, level: str, mask: int) -> None:
    n, bits = len(m), _bch(FORMAT_BITS[level] << 3 | mask, 0x537, 10) ^ 0x5412
    bit = lambda k: bool(bits >> k & 1)
    for k in range(6):
        m[k, 8], m[8, 5 - k] = bit(k), bit(9 + k)
    m[7, 8], m[8, 8], m[8, 7] = bit(6), bit(7), bit(8)
    for k in range(8):
        m[8, n - 1 - k] = bit(k)
    for k in range(8, 15):
        m[n - 15 + k, 8] = bit(k)
    m[n - 8, 8] = True


MASKS = (
    lambda y, x: (y + x) % 2, lambda y, x: y % 2 + 0 * x, lambda y, x: x % 3 + 0 * y, lambda y, x: (y + x) % 3,
    lambda y, x: (y // 2 + x // 3) % 2, lambda y, x: y * x % 2 + y * x % 3, lambda y, x: (y * x % 2 + y * x % 3) % 2,
    lambda y, x: ((y + x) % 2 + y * x % 3) % 2,
)


#: Finder-like patterns, dark is 1.
_FINDERS = [np.array(list(map(int, p)), np.int8) for p in ("10111010000", "00001011101")]


def penalty(m: np.ndarray) -> int:
    score = 0
    for grid in (m.astype(np.int8), m.T.astype(np.int8)):
        # Rows one after the other, with a border of its own kind between them.
        row = np.pad(grid, ((0, 0), (0, 1)), constant_values=2).ravel()
        ends = np.append(np.flatnonzero(np.diff(row)), len(row) - 1)
        runs = np.diff(np.append(-1, ends))
        score += int((runs[(runs >= 5) & (row[ends] < 2)] - 2).sum())
        windows = np.lib.stride_tricks.sliding_window_view(grid, 11, axis=1)
        score += 40 * sum(int((windows == p).all(2).sum()) for p in _FINDERS)
    same = (m[1:, 1:] == m[:-1, 1:]) & (m[1:, 1:] == m[1:, :-1]) & (m[1:, 1:] == m[:-1, :-1])
    dark = int(m.sum()) * 20
    return score + 3 * int(same.sum()) + 10 * (int(np.ceil(abs(dark - m.size * 10) / m.size)) - 1)


def qr_matrix(payload: str, level: str = "M") -> np.ndarray:
    """Modules (True: dark) without quiet zone, in byte mode, the smallest version that fits."""
    data = payload.encode()
    version = next((v for v in range(1, 41) if len(data) + (2 if v < 10 else 3) <= data_bytes(v, level)), None)
    if version is None:
        raise ValueError(f"{len(data)} bytes do not fit into a symbol of level {level}")
    m, fixed = _skeleton(version)
    n, bits = len(m), "".join(f"{b:08b}" for b in _codewords(data, version, level))
    at, up = 0, True
    for right in range(n - 1, 0, -2):
        right -= right <= 6
        for y in range(n - 1, -1, -1) if up else range(n):
            for x in (right, right - 1):
                if not fixed[y, x] and at < len(bits):
                    m[y, x], at = bits[at] == "1", at + 1
        up = not up
    y, x = np.mgrid[:n, :n]
    tries = []
    for k, rule in enumerate(MASKS):
        t = m ^ ((rule(y, x) == 0) & ~fixed)
        _format(t, level, k)
        tries.append((penalty(t), k, t))
    return min(tries, key=lambda t: t[:2])[2]


def parse_colour(text: str) -> tuple[int, int, int, int]:
    x = text.strip().lstrip("#")
    x = "".join(c * 2 for c in x) if len(x) in (3, 4) else x
    x += "FF" if len(x) == 6 else ""
    if len(x) != 8:
        raise ValueError(f"not a colour: {text!r}")
    return tuple(bytes.fromhex(x))


def png(pixels: np.ndarray) -> bytes:
    """PNG of height x width x 4 bytes."""
    h, w, _ = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(
        b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
    ) + part(b"IDAT", zlib.compress(raw, 9)) + part(b"IEND", b"")


def shrink_weights(full: int, n: int) -> np.ndarray:
    """n x full: the share of each old pixel in each new one, where a new one covers one or more."""
    edge = np.arange(n)[:, None] * full / n
    old = np.arange(full)[None, :]
    return np.clip(np.minimum(edge + full / n, old + 1) - np.maximum(edge, old), 0, None) * n / full


def cubic_weights(full: int, n: int) -> np.ndarray:
    """n x full: Catmull-Rom weights of the four nearest old pixels; pixels beyond an edge repeat it."""
    out, at = np.zeros((n, full)), (np.arange(n) + 0.5) * full / n - 0.5
    for k in range(-1, 3):
        tap = np.floor(at).astype(int) + k
        t = np.abs(at - tap)
        w = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))
        np.add.at(out, (np.arange(n), np.clip(tap, 0, full - 1)), w)
    return out


def resized(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Height x width x 4, alpha multiplied in: pixels averaged by area, or cubic where a side grows."""
    weights = cubic_weights if w >= image.shape[1] or h >= image.shape[0] else shrink_weights
    out = np.einsum("yi,ijc,xj->yxc", weights(image.shape[0], h), image, weights(image.shape[1], w))
    alpha = np.clip(np.rint(out[..., 3:]), 0, 255)
    return np.concatenate([np.minimum(np.clip(np.rint(out[..., :3]), 0, 255), alpha), alpha], axis=2)


def rounded(w: int, h: int, colour: tuple[int, int, int, int], corner: float) -> np.ndarray:
    """A filled box, alpha multiplied in; corners are quarter circles of a share of the shorter side."""
    r = int(min(w, h) * min(max(corner, 0.0), 0.5))
    y, x = np.mgrid[:h, :w]
    dx, dy = x - np.clip(x, r, max(w - 1 - r, r)), y - np.clip(y, r, max(h - 1 - r, r))
    rgba = np.array([c * colour[3] / 255 for c in colour[:3]] + [colour[3]])
    return np.where((dx * dx + dy * dy > r * r)[..., None] & (r > 0), 0.0, rgba)


def over(below: np.ndarray, above: np.ndarray) -> None:
    """Draw one picture (alpha multiplied in) on the middle of another; what stands out is cut."""
    (h, w), (hb, wb) = above.shape[:2], below.shape[:2]
    y, x = int((hb - h) / 2), int((wb - w) / 2)
    ys, xs = slice(max(y, 0), min(y + h, hb)), slice(max(x, 0), min(x + w, wb))
    part = above[ys.start - y : ys.stop - y, xs.start - x : xs.stop - x]
    below[ys, xs] = part + below[ys, xs] * (1 - part[..., 3:] / 255)


def with_logo(pixels: np.ndarray, logo: LogoOptions) -> np.ndarray:
    """A logo fitted into a square in the middle (0.05 to 0.35 of the side), on a rounded pad if there is a colour for it."""
    if logo.width < 1 or logo.height < 1 or len(logo.pixels) != 4 * logo.width * logo.height:
        raise ValueError("the logo is not RGBA bytes of its width and height")
    side = len(pixels)
    image = np.frombuffer(logo.pixels, np.uint8).reshape(logo.height, logo.width, 4).astype(float)
    image[..., :3] *= image[..., 3:] / 255
    target = max(1, int(side * min(max(logo.proportion, 0.05), 0.35)))
    scale = min(target / logo.width, target / logo.height)
    w, h = max(1, round(logo.width * scale)), max(1, round(logo.height * scale))
    out = pixels.astype(float)
    out[..., :3] *= out[..., 3:] / 255
    if logo.background is not None:
        margin = max(0, logo.margin)
        over(out, rounded(w + 2 * margin, h + 2 * margin, parse_colour(logo.background), logo.corner))
    over(out, resized(image, w, h))
    alpha = out[..., 3:]
    out[..., :3] = np.where(alpha > 0, out[..., :3] * 255 / np.maximum(alpha, 1e-9), 0)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def render(matrix: np.ndarray, o: QrOptions = QrOptions()) -> tuple[bytes, int]:
    """PNG and its side in pixels; the quiet zone is 4 modules."""
    if o.quiet_zone:
        matrix = np.pad(matrix, 4)
    n = len(matrix)
    scale = max(1, o.size // n if o.size else o.pixels_per_module)
    palette = np.array([parse_colour(o.background), parse_colour(o.foreground)], np.uint8)
    pixels = palette[matrix.astype(np.uint8)].repeat(scale, 0).repeat(scale, 1)
    return png(with_logo(pixels, o.logo) if o.logo else pixels), n * scale


RESULT = "png binary, base64 string, data_uri string, payload string, width int, height int, correction string"


def qr_image(payload: Column, level: Column, options: QrOptions = QrOptions()) -> Column:
    """struct of the PNG, its encodings and its size; null for a null payload or one that fits no symbol."""
    ship()

    @F.pandas_udf(RESULT)
    def run(p: pd.Series, c: pd.Series) -> pd.DataFrame:
        rows = []
        for text, letter in zip(p, c):
            try:
                image, side = render(qr_matrix(text, letter), options)
                code = base64.b64encode(image).decode()
                rows.append((image, code, f"data:image/png;base64,{code}", text, side, side, letter))
            except (ValueError, AttributeError):
                rows.append((None,) * 7)
        out = pd.DataFrame(rows, columns=["png", "base64", "data_uri", "payload", "width", "height", "correction"])
        return out.astype({"width": "Int32", "height": "Int32"})

    return run(payload, level)


def qr_of(payload: Column, options: QrOptions = QrOptions(), recommended: str = "medium") -> Column:
    """``qr_image`` at the level that the options, a logo and the kind of content call for."""
    level = Q.correction(F.lit(options.correction).cast("string"), F.lit(options.logo is not None), F.lit(recommended))
    return qr_image(payload, Q.correction_letter(level), options)


def from_url(url: Column, options: QrOptions = QrOptions()) -> Column:
    return qr_of(Q.url(url), options)


def from_text(text: Column, options: QrOptions = QrOptions()) -> Column:
    return qr_of(Q.text(text), options)


def from_phone(number: Column, options: QrOptions = QrOptions()) -> Column:
    return qr_of(Q.phone(number), options)


def from_sms(number: Column, message: Column, options: QrOptions = QrOptions()) -> Column:
    return qr_of(Q.sms(number, message), options)


def from_wifi(ssid: Column, password: Column, kind: Column, hidden: Column, options: QrOptions = QrOptions()) -> Column:
    return qr_of(Q.wifi(ssid, password, kind, hidden), options)


def from_mail(to: Column, subject: Column, body: Column, options: QrOptions = QrOptions()) -> Column:
    return qr_of(Q.mail(to, subject, body), options)


def from_geo(lat: Column, lon: Column, options: QrOptions = QrOptions()) -> Column:
    return qr_of(Q.geo(lat, lon), options)


def from_message(app: Column, to: Column, message: Column, options: QrOptions = QrOptions()) -> Column:
    """app: whatsapp or telegram; a telegram link has no message."""
    return qr_of(
        F.when(F.lower(app) == "whatsapp", Q.whatsapp(to, message)).when(F.lower(app) == "telegram", Q.telegram(to)),
        options
    )
