"""PDF, recognition and handwriting flows over engines that read made-up formats."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions.options import ConversionOptions, HandwritingOptions, OcrOptions
from folioscope.operators.pdf import pdf_markdown
from folioscope.sources import adapters as A
from folioscope.sources import recognition as R


class Pdf:
    """%PDF and JSON: pages of {text, images, ink} and blocks of lines."""

    def read(self, data):
        return json.loads(bytes(data)[4:])

    def page_count(self, data):
        return len(self.read(data)["pages"])

    def title(self, data):
        return self.read(data).get("title")

    def embedded_text(self, data):
        return [p.get("text", "") for p in self.read(data)["pages"]]

    def embedded_images(self, data, page):
        return [(x.encode(), w, h) for x, w, h in self.read(data)["pages"][page - 1].get("images", [])]

    def render(self, data, page, dpi):
        p = self.read(data)["pages"][page - 1]
        if p.get("broken"):
            raise ValueError("cannot draw")
        return json.dumps(p | {"dpi": dpi}).encode()

    def letters(self, data):
        for n, page in enumerate(self.read(data)["pages"], 1):
            for b, block in enumerate(page.get("blocks", [])):
                for k, line in enumerate(block["lines"]):
                    for w, word in enumerate(line.split(" ")):
                        for c, letter in enumerate(word):
                            yield {
                                "page": n, "block": b, "line": k, "word": w, "letter": c,
                                "point_size": block.get("size", 10.0), "is_bold": block.get("bold", False),
                                "text": letter
                            }


class Ocr:
    """Pictures are JSON too, or TIFFs with a page a line."""

    def recognize(self, image, languages):
        if bytes(image[:2]) == b"II":
            return [(x.decode(), 0.5) for x in bytes(image)[4:].split(b"\n") if x]
        p = json.loads(bytes(image))
        return [(p["says"], p.get("sure", 0.9))]

    def words(self, image, languages):
        return json.loads(bytes(image))["words"]


class Decoder:
    def decode(self, data):
        p = json.loads(bytes(data))
        if "w" not in p:
            return None
        x = np.full((p["h"], p["w"], 4), 255, np.uint8)
        for x0, y0, x1, y1, *rgb in p["boxes"]:
            x[y0:y1, x0:x1, :3] = rgb or 0
        return p["w"], p["h"], x.tobytes()


def files(spark, *rows):
    return spark.createDataFrame(
        [(k, p, bytearray(c)) if c is not None else (k, p, None) for k, (p, c) in enumerate(rows)],
        "doc_id long, path string, content binary"
    )


def pdf(**document):
    return b"%PDF" + json.dumps(document).encode()


REPORT = pdf(pages=[
    {"blocks": [
        {"lines": ["Yearly *report*"], "size": 20.0},
        {"lines": ["This year was a won-", "derful one for bees, and a socio-", "economic one.", "wonderful indeed"]},
        {"lines": ["Results"], "bold": True},
        {"lines": ["We count:", "- hives", "- bees", "1) first", "2) second", "1. again", "end of 10", "- 20 km"]},
    ]},
    {},
    {"blocks": [{"lines": ["• late item", "# not a heading"]}, {"lines": ["  "]}]},
])

EXPECTED = """# Yearly \\*report\\*

This year was a wonderful one for bees, and a socio-economic one. wonderful indeed

## Results

We count:

- hives
- bees

<!-- -->

1. first
2. second

<!-- -->

1. again

end of 10 - 20 km

- late item

\\# not a heading
"""


def test_pdf_markdown(spark):
    df = files(spark, ("a.pdf", REPORT), ("b.pdf", pdf(pages=[{}], title=" Given ")), ("c.pdf", b"%PDFnot json"), ("d.pdf", None))
    a, b, c, d = R.convert_pdfs(df, Pdf).orderBy("doc_id").collect()
    assert a["markdown"] == EXPECTED and a["title"] == "Yearly *report*" and a["warnings"] == [] and a["error"] is None
    assert (b["markdown"], b["title"], len(b["warnings"])) == ("", " Given ", 1)
    assert c["markdown"] is None and "JSONDecodeError" in c["error"] and "empty" in d["error"]
    marked = R.convert_pdfs(
        df.filter("doc_id < 2"), Pdf, ConversionOptions(include_page_markers=True, detect_headings=False)
    ).orderBy("doc_id").collect()
    assert marked[0]["markdown"].startswith(
        "<!-- Página 1 -->\n\nYearly \\*report\\*\n\nThis year"
    ) and "<!-- Página 2 -->\n\n<!-- Página 3 -->\n\n- late item" in marked[0]["markdown"]
    assert marked[1]["markdown"] == "<!-- Página 1 -->\n" and marked[0]["title"] is None
    assert R.convert_pdfs(df.limit(0), Pdf).count() == 0


def test_pdf_plain_pages(spark):
    letters = spark.createDataFrame([], A.LETTERS)
    plain = spark.createDataFrame([(1, 2, "  one li-\n\nne\n• x")], "doc_id long, page int, text string")
    got = pdf_markdown(letters, plain=plain).first()
    assert got["markdown"] == "one li-ne\n\n- x\n" and got["warnings"][0].startswith("layout analysis failed on page 2")


def test_recognise(spark):
    mixed = pdf(pages=[{"text": " long enough embedded text "}, {"text": "short", "says": "seen", "sure": 80}, {"says": "too"}])
    df = files(
        spark, ("a.pdf", mixed), ("b.bin", pdf(pages=[{"text": "only embedded text here"}])),
        ("c.png", b'{"says": "a picture"}'), ("d.tif", b"II*\0one\ntwo"),
        ("e.pdf", pdf(pages=[{"broken": True}])), ("f.txt", b"what"), ("g.png", b""), ("h.pdf", pdf(pages=[])),
        ("i.png", b"not json"), ("j.tif", b"II*\0"),
    )
    got = {r["doc_id"]: r for r in R.recognise(df, Pdf, Ocr).collect()}
    short = lambda k: (got[k]["text"], got[k]["pages"], round(got[k]["mean_confidence"], 3), got[k]["source_kind"])
    assert short(0) == ("long enough embedded text\n\nseen\n\ntoo", 3, 85.0, "mixed")
    assert short(1) == ("only embedded text here", 1, -1.0, "pdf_text") and short(2) == ("a picture", 1, 90.0, "image")
    assert short(3) == ("one\n\ntwo", 2, 50.0, "image") and short(7) == ("", 0, -1.0, "pdf_text")
    assert "cannot draw" in got[4]["error"] and got[5]["error"] == R.UNKNOWN and "empty" in got[6]["error"] and "JSONDecodeError" in got[8]["error"]
    every = R.recognise(df.filter("doc_id = 1"), Pdf, Ocr, OcrOptions(prefer_embedded=False)).first()
    assert "KeyError" in every["error"]  # nothing to recognise on it
    pages = R.recognise_pages(df.filter("doc_id = 0"), Pdf, Ocr).orderBy("page").collect()
    assert [(r["page"], r["from_embedded"]) for r in pages] == [(1, True), (2, False), (3, False)]


def test_embedded_images(spark):
    images = [
        ['{"says": "big"}', 300, 200], ['{"says": "small"}', 10, 10], ["junk", 500, 500], ['{"says": " "}', 300, 300],
        ['{"says": "second", "sure": 40}', 400, 400]
    ]
    df = files(spark, ("a.pdf", pdf(pages=[{}, {"images": images}])), ("b.pdf", pdf(pages=[{}])))
    got = R.recognise_embedded_images(df, Pdf, Ocr).orderBy("image_ix").collect()
    assert [(r["page"], r["image_ix"], r["text"], r["confidence"]) for r in got] == [(2, 1, "big", 90.0), (2, 4, "second", 40.0)]


def test_extract_text(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b'{"says": "words"}')
    (tmp_path / "y.txt").write_bytes(b"plain")
    assert R.extract_text(spark, str(tmp_path / "x.png"), Pdf, Ocr) == "words"
    with pytest.raises(ValueError):
        R.extract_text(spark, str(tmp_path / "y.txt"), Pdf, Ocr)


def test_scaled():
    x = np.zeros((30, 60, 4), np.uint8)
    x[:, 30:] = [10, 20, 30, 255]
    rgb, scale = R.scaled(60, 30, x.tobytes(), 20)
    assert rgb.shape == (10, 20, 3) and scale == pytest.approx(1 / 3) and (rgb[:, :10] == 255).all() and (rgb[:, 10:] == [10, 20, 30]).all()
    assert R.scaled(6, 3, x[:3, :6].tobytes(), 20)[1] == 1.0


@pytest.mark.parametrize("seed", range(5))
def test_threshold(seed):
    gray = np.random.default_rng(seed).integers(0, 256, (20, 20)).astype(np.uint8) // (seed + 1)
    best, at = -1, 127
    for t in range(256):
        low, high = gray[gray <= t].astype(float), gray[gray > t].astype(float)
        if len(low) and len(high) and len(low) * len(high) * (low.mean() - high.mean()) ** 2 > best * (1 + 1e-12):
            best, at = len(low) * len(high) * (low.mean() - high.mean()) ** 2, t
    assert R.threshold(gray) == at and R.threshold(np.full((3, 3), 9, np.uint8)) == 127


def page(boxes, words=(), w=1000, h=1000):
    """Black boxes on white, and a gray spot: ink is darker than the threshold, which falls on the darkest gray that is not white."""
    return {"w": w, "h": h, "boxes": [*boxes, [w - 9, h - 9, w - 5, h - 5, 40, 40, 40]], "words": list(words)}


def printed(n=20):
    """A line of equal letters."""
    return [[100 + 20 * k, 100, 112 + 20 * k, 116] for k in range(n)]


#: A wide and thin frame: much box, little ink, taller than letters.
SIGNATURE = [[300, 500, 500, 502], [300, 500, 302, 560], [498, 500, 500, 560], [300, 558, 500, 560]]


def test_handwriting(spark):
    word = lambda text, c, x, y, w, h: {"text": text, "confidence": c, "x": x, "y": y, "w": w, "h": h}
    sure, unsure = [word("printed", 95.0, 100, 100, 80, 16)], [
        word("scrawl", 20.0, 310, 700, 90, 30), word("more", 30.0, 410, 700, 60, 30)
    ]
    signed = page(printed() + SIGNATURE)
    df = files(
        spark, ("a.png", json.dumps(page(printed())).encode()),
        ("b.png", json.dumps(signed | {"words": unsure}).encode()),
        ("c.png", json.dumps(signed | {"words": sure}).encode()),
        ("d.pdf", pdf(pages=[page(printed()), signed | {"words": unsure}])), ("e.png", b'{"no": "size"}'),
        ("f.png", json.dumps(page([])).encode()), ("g.pdf", b"%PDF?"), ("h.txt", b"?"),
        ("i.png", json.dumps(page([[0, 0, 4, 4]], w=9, h=9)).encode()),
    )
    alone = {r["doc_id"]: r for r in R.detect_handwriting(df, Pdf, Decoder).collect()}
    assert [
        alone[k]["region_count"] for k in (0, 1, 2, 3, 5, 8)
    ] == [0, 1, 1, 1, 0, 0] and alone[1]["has_handwriting"] and not alone[0]["has_handwriting"]
    box = alone[1]["regions"][0]
    assert (
        box["x"], box["y"], box["w"], box["h"]
    ) == (300, 500, 200, 60) and alone[1]["max_score"] == pytest.approx(box["score"])
    assert alone[4]["error"] == "the image cannot be decoded" and "JSONDecodeError" in alone[6]["error"] and alone[7]["error"] == R.UNKNOWN
    seen = {r["doc_id"]: r for r in R.detect_handwriting(df, Pdf, Decoder, Ocr).collect()}
    # Words of low confidence make one region; what is surely printed clears its page.
    assert [seen[k]["region_count"] for k in (0, 1, 2, 3)] == [0, 2, 0, 2]
    assert {(r["x"], r["y"], r["w"], r["h"]) for r in seen[1]["regions"]} == {(300, 500, 200, 60), (310, 700, 160, 30)}
    quiet = R.detect_handwriting(df.filter("doc_id = 1"), Pdf, Decoder, options=HandwritingOptions(detect_strokes=False)).first()
    assert quiet["region_count"] == 0
    # A scaled page gives boxes of the original.
    half = R.detect_handwriting(
        df.filter("doc_id = 1"), Pdf, Decoder, options=HandwritingOptions(max_side=500)
    ).first()["regions"]
    assert half and abs(half[0]["x"] - 300) <= 2 and abs(half[0]["w"] - 200) <= 4
