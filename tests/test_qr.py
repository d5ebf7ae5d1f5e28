import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import qr as Q
from folioscope.functions import qr_image as I
from folioscope.functions.options import LogoOptions, QrOptions


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


L = F.lit


def test_payloads(spark):
    cases = [
        (Q.url(L("https://e.com")), "https://e.com"), (Q.url(L(" e.com ")), "http://e.com"), (Q.url(L(" ")), None),
        (Q.text(L("Hola")), "Hola"), (Q.text(L("")), None),
        (Q.phone(L("+50322500000")), "tel:+50322500000"), (Q.telegram(L("@some_user")), "https://t.me/some_user"),
        (Q.whatsapp(L("+503 2250-0000"), L("Hola")), "https://wa.me/50322500000?text=Hola"),
        (Q.whatsapp(L("x"), L("")), None), (Q.geo(L(13.6989), L(-89.1914)), "geo:13.6989,-89.1914"),
        (Q.geo(L(91.0), L(0.0)), None), (Q.geo(L(10.0), L(-0.0)), "geo:10,0"),
        (Q.geo(L("1.0000005").cast("decimal(20,12)"), L("-2.0000025").cast("decimal(20,12)")), "geo:1.000001,-2.000003"),
        (
            Q.crypto(L("ethereum"), L("0x71"), L("1").cast("decimal(38,18)"), L(None), L(None)),
            "ethereum:0x71?value=1000000000000000000"
        ),
        (Q.crypto(L("ethereum"), L("0x71"), L(None), L(None), L(None)), "ethereum:0x71"),
        (Q.crypto(L("bitcoin"), L("1B"), L("0.005"), L(None), L(None)), "bitcoin:1B?amount=0.005"),
        (Q.crypto(L("bitcoin"), L("1B"), L("-1"), L(None), L(None)), None),
        (Q.wifi(L("Casa;x"), L("Key1234"), L("WPA"), L(False)), "WIFI:T:WPA;S:Casa\\;x;P:Key1234;;"),
        (Q.wifi(L("a"), L(""), L("WPA"), L(False)), None),
        (Q.mecard(L("Ana"), L("Gil"), tel=L("+503")), "MECARD:N:Gil,Ana;TEL:+503;;"), (Q.mecard(L(" "), L(None)), None),
        (Q.otp(L("JBSW"), L("Org"), L("a@b.c")), "otpauth://totp/Org:a%40b.c?secret=JBSW&issuer=Org"),
    ]
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cases)]).first()
    assert list(row) == [w for _, w in cases]


def read(matrix, level):
    """Decode a symbol: format, mask, codewords; returns the text and checks every block's error bytes."""
    n = len(matrix)
    version = (n - 17) // 4
    bits = sum(bool(matrix[8, 5 - k] if k < 6 else 0) << (9 + k) for k in range(6))
    bits |= sum(
        bool(matrix[k, 8]) << k for k in range(6)
    ) | bool(matrix[7, 8]) << 6 | bool(matrix[8, 8]) << 7 | bool(matrix[8, 7]) << 8
    data = (bits ^ 0x5412) >> 10
    assert data >> 3 == I.FORMAT_BITS[level] and I._bch(data, 0x537, 10) ^ 0x5412 == bits
    _, fixed = I._skeleton(version)
    y, x = np.mgrid[:n, :n]
    plain = matrix ^ ((I.MASKS[data & 7](y, x) == 0) & ~fixed)
    stream, up = [], True
    for right in range(n - 1, 0, -2):
        right -= right <= 6
        for yy in range(n - 1, -1, -1) if up else range(n):
            stream += [int(plain[yy, xx]) for xx in (right, right - 1) if not fixed[yy, xx]]
        up = not up
    words = [int("".join(map(str, stream[k : k + 8])), 2) for k in range(0, len(stream) - 7, 8)]
    blocks, ec, room = int(I.BLOCKS[level].split()[version - 1]), int(
        I.EC_BYTES[level].split()[version - 1]
    ), I.data_bytes(version, level)
    short, longer = divmod(room, blocks)
    sizes = [short + (k >= blocks - longer) for k in range(blocks)]
    parts, at = [[] for _ in sizes], 0
    for k in range(short + 1):
        for b, size in enumerate(sizes):
            if k < size:
                parts[b].append(words[at])
                at += 1
    for k in range(ec):
        for b in range(blocks):
            parts[b].append(words[at])
            at += 1
    assert all(I.error_bytes(b[:-ec], ec) == b[-ec:] for b in parts)
    raw = "".join(f"{w:08b}" for b in parts for w in b[:-ec])
    head = 4 + (8 if version < 10 else 16)
    size = int(raw[4:head], 2)
    return bytes(int(raw[head + 8 * k : head + 8 * k + 8], 2) for k in range(size)).decode()


@pytest.mark.parametrize("level", "LMQH")
@pytest.mark.parametrize("size", [1, 14, 60, 300])
def test_matrix_reads_back(level, size):
    text = ("Añ" * size)[:size]
    assert read(I.qr_matrix(text, level), level) == text


def test_capacity():
    assert [I.data_bytes(40, level) - 3 for level in "LMQH"] == [2953, 2331, 1663, 1273]
    with pytest.raises(ValueError):
        I.qr_matrix("x" * 1274, "H")


def test_png():
    image, side = I.render(I.qr_matrix("hi", "M"), QrOptions(size=512, foreground="#0F172A"))
    assert image.startswith(b"\x89PNG") and side == 512 // 29 * 29
    at = image.index(b"IDAT")
    raw = zlib.decompress(image[at + 4 : at + 4 + int.from_bytes(image[at - 4 : at], "big")])
    assert len(raw) == side * (side * 4 + 1)


def slow_penalty(m):
    score, n = 0, len(m)
    for grid in (m, m.T):
        for row in grid:
            text = "".join("01"[int(v)] for v in row)
            score += sum(len(r) - 2 for r in re.findall("0{5,}|1{5,}", text))
            score += 40 * sum(text.startswith(p, k) for p in ("10111010000", "00001011101") for k in range(n))
    score += 3 * sum(
        len({bool(m[y + a, x + b]) for a in (0, 1) for b in (0, 1)}) == 1 for y in range(n - 1) for x in range(n - 1)
    )
    share = m.mean() * 100
    return score + 10 * max(math.ceil(abs(share - 50) / 5 - 1e-9) - 1, -1)


@pytest.mark.parametrize("seed", range(4))
def test_penalty(seed):
    m = np.random.default_rng(seed).random((25, 25)) < (0.3, 0.5, 0.7, 0.95)[seed]
    assert I.penalty(m) == slow_penalty(m)


def test_resize_weights():
    for full, n in ((10, 3), (7, 7), (100, 33), (5, 1)):
        w = I.shrink_weights(full, n)
        assert np.allclose(w.sum(1), 1) and np.allclose(w.sum(0), n / full)
    for full, n in ((3, 10), (4, 4), (1, 5)):
        assert np.allclose(I.cubic_weights(full, n).sum(1), 1)
    assert np.allclose(I.cubic_weights(4, 4), np.eye(4))


def pixels(image):
    at = image.index(b"IDAT")
    w, h = (int.from_bytes(image[k : k + 4], "big") for k in (16, 20))
    raw = np.frombuffer(
        zlib.decompress(image[at + 4 : at + 4 + int.from_bytes(image[at - 4 : at], "big")]), np.uint8
    ).reshape(h, 1 + 4 * w)
    return raw[:, 1:].reshape(h, w, 4)


def test_logo():
    red = LogoOptions(bytes([200, 10, 20, 255]) * 60, 10, 6, proportion=0.2, background="#FFEEDD", margin=4, corner=0.5)
    m = I.qr_matrix("logo", "H")
    plain, side = I.render(m, QrOptions(pixels_per_module=10))
    got, with_side = I.render(m, QrOptions(pixels_per_module=10, logo=red))
    a, b = pixels(plain), pixels(got)
    assert side == with_side == 290 and a.shape == b.shape
    # 58 x 35 pixels of the logo in the middle, on a pad of 4 more at each side; all else is as it was.
    changed = np.argwhere((a != b).any(2))
    assert (b[128:162, 117:173] == [200, 10, 20, 255]).all() and (b[125, 130:160] == [255, 238, 221, 255]).all()
    assert changed.min() >= 112 and changed.max() <= 178 and (b[:100] == a[:100]).all()
    # A clear logo without pad changes nothing; a half clear one mixes.
    clear = LogoOptions(bytes(4 * 9), 3, 3, background=None)
    assert (pixels(I.render(m, QrOptions(logo=clear))[0]) == pixels(I.render(m, QrOptions())[0])).all()
    half = LogoOptions(bytes([0, 0, 0, 128]) * 9, 3, 3, background="#FFFFFF", margin=0, corner=0)
    assert pixels(I.render(m, QrOptions(pixels_per_module=10, logo=half))[0])[145, 145].tolist() == [127, 127, 127, 255]
    with pytest.raises(ValueError):
        I.render(m, QrOptions(logo=LogoOptions(b"x", 2, 2)))


def test_shortcuts(spark):
    logo = QrOptions(logo=LogoOptions(bytes(16), 2, 2), pixels_per_module=2)
    cases = [
        (I.from_url(L("e.com")), "http://e.com", "M"), (I.from_text(L("x"), logo), "x", "H"),
        (I.from_text(L("x"), QrOptions(correction="low")), "x", "L"), (I.from_phone(L("5")), "tel:5", "M"),
        (I.from_sms(L("5"), L("hi")), "sms:5?body=hi", "M"),
        (I.from_wifi(L("net"), L("key"), L("WPA"), L(False)), "WIFI:T:WPA;S:net;P:key;;", "M"),
        (I.from_mail(L("a@b.c"), L(""), L("")), "mailto:a@b.c", "M"),
        (I.from_geo(L(1.5), L(2.0)), "geo:1.5,2", "M"),
        (I.from_message(L("WhatsApp"), L("+1 2"), L("")), "https://wa.me/12", "M"),
        (I.from_message(L("telegram"), L("@me"), L("")), "https://t.me/me", "M"),
    ]
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _, _) in enumerate(cases)]).first()
    assert [(r["payload"], r["correction"]) for r in row] == [(p, level) for _, p, level in cases]
    assert spark.range(1).select(I.from_url(L(" ")).alias("x")).first()["x"]["png"] is None


# Published values of the symbol standard: format strings by level and mask, version strings, alignment rows.
FORMATS = {
    "L": "111011111000100 111001011110011 111110110101010 111100010011101 110011000101111 110001100011000 110110001000001 110100101110110",
    "M": "101010000010010 101000100100101 101111001111100 101101101001011 100010111111001 100000011001110 100111110010111 100101010100000",
    "Q": "011010101011111 011000001101000 011111100110001 011101000000110 010010010110100 010000110000011 010111011011010 010101111101101",
    "H": "001011010001001 001001110111110 001110011100111 001100111010000 000011101100010 000001001010101 000110100001100 000100000111011",
}
VERSIONS = {7: "000111110010010100", 8: "001000010110111100", 9: "001001101010011001", 10: "001010010011010011"}
ALIGNMENT = {2: [6, 18], 7: [6, 22, 38], 14: [6, 26, 46, 66], 32: [6, 34, 60, 86, 112, 138], 40: [6, 30, 58, 86, 114, 142, 170]}


def test_published_values():
    for level, strings in FORMATS.items():
        for mask, bits in enumerate(strings.split()):
            assert f"{I._bch(I.FORMAT_BITS[level] << 3 | mask, 0x537, 10) ^ 0x5412:015b}" == bits
    assert {v: f"{I._bch(v, 0x1F25, 12):018b}" for v in VERSIONS} == VERSIONS
    assert {v: I.alignment(v) for v in ALIGNMENT} == ALIGNMENT
    # The worked example of a 1-M symbol: data words and their error words.
    assert I.error_bytes(
        [32, 91, 11, 120, 209, 114, 220, 77, 67, 64, 236, 17, 236, 17, 236, 17], 10
    ) == [196, 35, 39, 119, 235, 215, 231, 226, 93, 23]


@pytest.mark.parametrize("level, size", [("L", 2000), ("Q", 1600), ("H", 1200)])
def test_high_versions_read_back(level, size):
    """With a map of the fixed modules made here, and error words checked by the roots of the code."""
    text = "".join(chr(33 + k * 7 % 90) for k in range(size))
    m = I.qr_matrix(text, level)
    n, version = len(m), (len(m) - 17) // 4
    fixed = np.zeros((n, n), bool)
    fixed[:9, :9] = fixed[:9, n - 8 :] = fixed[n - 8 :, :9] = True
    fixed[6] = fixed[:, 6] = True
    for cy in I.alignment(version):
        for cx in I.alignment(version):
            if not ((cy < 9 and cx < 9) or (cy < 9 and cx > n - 9) or (cy > n - 9 and cx < 9)):
                fixed[cy - 2 : cy + 3, cx - 2 : cx + 3] = True
    fixed[: 6, n - 11 : n - 8] = fixed[n - 11 : n - 8, :6] = True
    bits = "".join(str(int(v)) for v in [*m[8, :6], m[8, 7], m[8, 8], m[7, 8], *m[5::-1, 8]])
    mask = FORMATS[level].split().index(bits)
    assert all(
        m[k, n - 11 + j] == m[n - 11 + j, k] == bool(
            int(f"{I._bch(version, 0x1F25, 12):018b}"[17 - 3 * k - j])
        ) for k in range(6) for j in range(3)
    )
    rule = [
        lambda i, j: (i + j) % 2, lambda i, j: i % 2, lambda i, j: j % 3, lambda i, j: (i + j) % 3,
        lambda i, j: (i // 2 + j // 3) % 2, lambda i, j: i * j % 2 + i * j % 3,
        lambda i, j: (i * j % 2 + i * j % 3) % 2, lambda i, j: ((i + j) % 2 + i * j % 3) % 2
    ][mask]
    stream, right, up = [], n - 1, True
    while right > 0:
        right -= right == 6
        for i in range(n - 1, -1, -1) if up else range(n):
            stream += [int(m[i, j]) ^ (rule(i, j) == 0) for j in (right, right - 1) if not fixed[i, j]]
        right, up = right - 2, not up
    words = [int("".join(map(str, stream[k : k + 8])), 2) for k in range(0, len(stream) - 7, 8)]
    blocks, ec = int(I.BLOCKS[level].split()[version - 1]), int(I.EC_BYTES[level].split()[version - 1])
    short, longer = divmod(len(words) - ec * blocks, blocks)
    parts = [
        [words[k * blocks + b] for k in range(short)] + (
            [words[short * blocks + b - (blocks - longer)]] if b >= blocks - longer else []
        ) for b in range(blocks)
    ]
    rest = words[short * blocks + longer :]
    power, log = [1], {}
    for k in range(255):
        log[power[-1]] = k
        power.append(power[-1] * 2 ^ (0x11D if power[-1] > 127 else 0))
    for b, data in enumerate(parts):
        whole = data + [rest[k * blocks + b] for k in range(ec)]
        for root in range(ec):
            value = 0
            for w in whole:
                value = (power[(log[value] + root) % 255] if value else 0) ^ w
            assert value == 0
    raw = "".join(f"{w:08b}" for data in parts for w in data)
    assert raw[:4] == "0100" and int(raw[4:20], 2) == size
    assert bytes(int(raw[20 + 8 * k : 28 + 8 * k], 2) for k in range(size)).decode() == text
