"""Operators on hand-made tables: cases the driver tables don't have."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import markdown as M
from folioscope.operators import geometry as G
from folioscope.operators import layout as L
from folioscope.operators import ocr as O


def flood(ink, colour):
    """Connected components by flood fill."""
    seen, out = np.zeros_like(ink), []
    for y, x in zip(*np.nonzero(ink)):
        if seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = True
        while stack:
            cy, cx = stack.pop()
            cells.append((cy, cx))
            for ny in range(max(cy - 1, 0), min(cy + 2, ink.shape[0])):
                for nx in range(max(cx - 1, 0), min(cx + 2, ink.shape[1])):
                    if ink[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = True
                        stack.append((ny, nx))
        ys, xs = zip(*cells)
        out.append((min(xs), min(ys), max(xs), max(ys), len(cells), int(sum(colour[c] for c in cells))))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_components(seed):
    rng = np.random.default_rng(seed)
    shape = tuple(rng.integers(1, 30, 2))
    ink, colour = rng.random(shape) < rng.uniform(0.1, 0.6), rng.random(shape) < 0.3
    assert sorted(G.components_of(ink, colour)) == sorted(flood(ink, colour & ink))


def test_page_pipeline(spark):
    """Pixels to components, lines, words and scores of a drawn page."""
    ink = np.zeros((100, 300), np.uint8)
    for k in range(8):
        ink[40 + (k % 3) : 52 + 2 * (k % 2), 10 + 20 * k : 20 + 20 * k] = 1
    page = spark.createDataFrame(
        [(1, 0, 300, 100, bytearray(ink.tobytes()), bytearray(ink.tobytes()))],
        "doc_id long, page int, width int, height int, ink binary, colour binary"
    )
    comps = G.connected_components(page)
    assert comps.count() == 8
    glyphs = G.filter_glyphs(comps, F.lit(300), F.lit(100))
    words = G.split_words(G.group_lines(glyphs))
    scored = G.word_scores(words).collect()
    assert len(scored) == 1 and scored[0]["n"] == 8 and 0 <= scored[0]["score"] <= 100
    boxes = spark.createDataFrame(
        [(1, 0, 0, "a", 5.0, 10, 40, 10, 12), (1, 0, 1, "b", 5.0, 60, 0, 5, 5)],
        "doc_id long, page int, word int, text string, confidence float, x int, y int, w int, h int"
    )
    got = {r["word"]: r["colour"] for r in G.colour_fractions(page.withColumn("scale", F.lit(1.0)), boxes).collect()}
    assert got == {0: float(ink[40:52, 10:20].mean()), 1: 0.0}


def test_word_rows_and_otsu(spark):
    words = spark.createDataFrame(
        [(1, 0, k, "w", 10.0, x, y, 20, 20) for k, (x, y) in enumerate([(0, 0), (30, 4), (200, 2), (0, 50)])],
        "doc_id long, page int, word int, text string, confidence float, x int, y int, w int, h int"
    )
    got = G.word_regions(G.word_rows(words)).collect()
    assert sorted((r["row"], r["words"], r["x"], r["w"]) for r in got) == [(0, 1, 200, 20), (0, 2, 0, 50), (1, 1, 0, 20)]
    flat = spark.createDataFrame([(1, 200, 5)], "page int, gray int, n long")
    assert G.otsu(flat, ["page"]).first()["threshold"] == 127
    two = spark.createDataFrame([(1, 10, 50), (1, 240, 50)], "page int, gray int, n long")
    assert G.otsu(two, ["page"]).first()["threshold"] == 10
    assert spark.range(1).select(
        G.luminance(F.lit(255), F.lit(255), F.lit(255)), G.is_colourful(F.lit(200), F.lit(100), F.lit(120))
    ).first()[:] == (255, True)


def test_word_rows_of_many_pages(spark):
    """All pages of a task go through one loop, whatever the batches they arrive in; as page by page."""
    rng = np.random.default_rng(3)
    rows = [
        (d, p, k, int(rng.integers(0, 90)), int(rng.integers(0, 120)), 9, None if d in (7, 57) else int(rng.integers(4, 30)))
        for d in [None, *range(120)] for p in range(2) for k in range(int(rng.integers(1, 40)))
    ]
    words = spark.createDataFrame(rows, "doc_id long, page int, word int, x int, y int, w int, h int")
    want = {}
    for key in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == key]
        heights = sorted(r[6] for r in own if r[6] is not None)
        median = heights[len(own) // 2] if heights else None
        near, row, at = 6.0 if median is None else max(6.0, median * 0.7), -1, None
        for r in sorted(own, key=lambda r: (r[4] + (r[6] or 0) / 2, r[3], r[2])):
            y = float("nan") if r[6] is None else r[4] + r[6] / 2
            if at is not None and abs(y - at) <= near:
                at = (at + y) / 2
            else:
                row, at = row + 1, y
            want[r[:3]] = row, 30.0 if median is None else max(30.0, median * 3.0)
        if not heights:
            # Without heights no word has a centre: each is a row, by x and word.
            for k, r in enumerate(sorted(own, key=lambda r: (r[3], r[2]))):
                want[r[:3]] = k, 30.0
    bound = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(bound)
    spark.conf.set(bound, 7)
    try:
        out = G.word_rows(words)
        got = {(r["doc_id"], r["page"], r["word"]): (r["row"], r["gap_limit"]) for r in out.collect()}
    finally:
        spark.conf.set(bound, before)
    assert got == want
    # No call for each page: over small pages those were nearly all of the time.
    assert "InPandas" not in out._jdf.queryExecution().toString()


def test_overlaps(spark):
    boxes = spark.createDataFrame(
        [(1, 0, 0, 0, 0, 10, 10), (1, 0, 1, 2, 0, 10, 10), (1, 0, 2, 9, 9, 10, 10), (2, 0, 0, 0, 0, 10, 10)],
        "doc_id long, page int, k int, x int, y int, w int, h int"
    )
    assert sorted((r["doc_id"], r["k"]) for r in G.first_of_overlapping(boxes, ["k"]).collect()) == [(1, 0), (1, 2), (2, 0)]
    left = G.without_overlaps(boxes.filter("k > 0"), boxes.filter("k = 0"))
    assert [(r["doc_id"], r["k"]) for r in left.collect()] == [(1, 2)]


def test_dash_runs_and_keys(spark):
    lines = ["uno", "- no", "fin.", "- si", "- si", "x", "2) a", "• b", "3. c", "3. d", "• e"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "doc_id long, ix int, text string")
    got = [
        (r["ix"], r["list_key"]) for r in L.list_keys(
            L.classify_lines(df, ["ix"]).filter("kind is not null"), ["ix"]
        ).orderBy("ix").collect()
    ]
    assert got == [(3, "ul1"), (4, "ul1"), (6, "ol2"), (7, "ul3"), (8, "ol4"), (9, "ol5"), (10, "ul6")]


def test_paragraphs(spark):
    lines = ["la auto-", "móvil y socio-", "económico de 10", "- 20 km y sua­", "ve"]
    row = spark.createDataFrame(
        [(lines, ["automóvil"])], "l array<string>, w array<string>"
    ).select(L.join_lines(F.col("l"), F.col("w")).alias("p")).first()
    assert row["p"] == "la automóvil y socio-económico de 10 - 20 km y suave"


def test_blocks(spark):
    rows = [
        (1, 0, "a  ", False, None), (1, 1, "- x", True, "k"), (1, 2, " ", False, None), (1, 3, "- y", True, "k"),
        (1, 4, "- z", True, "j"), (2, 0, " ", False, None)
    ]
    df = spark.createDataFrame(rows, "doc_id long, block_ix int, text string, is_list_item boolean, list_key string")
    assert [tuple(r) for r in M.join_blocks(df).collect()] == [(1, "a\n\n- x\n- y\n\n<!-- -->\n\n- z\n")]


def test_ocr(spark):
    pages = spark.createDataFrame(
        [
            (1, 1, " embedded text of enough letters ", "x", 50.0), (1, 2, "short", "seen", 80.0),
            (2, 1, None, "y", 70.0), (3, 1, "embedded text of enough letters", None, None)
        ],
        "doc_id long, page int, embedded_text string, ocr_text string, ocr_confidence float"
    )
    got = {
        r["doc_id"]: (
            r["text"], r["mean_confidence"], r["source_kind"]
        ) for r in O.assemble_documents(O.choose_page_text(pages)).collect()
    }
    assert got == {
        1: ("embedded text of enough letters\n\nseen", 80.0, "mixed"), 2: ("y", 70.0, "pdf_ocr"),
        3: ("embedded text of enough letters", -1.0, "pdf_text")
    }
    assert O.pages_to_recognise(pages).count() == 2


def fold_lines(lines, words):
    """The rule of ``join_lines``, line after line on the text so far."""
    out = ""
    for line in lines:
        left, head = re.search(r"([^\W\d_]*)[-‐]\Z", out), re.match(r"[^\W\d_]*", line)[0]
        if out == "":
            out = line
        elif out.endswith("­"):
            out = out[:-1] + line
        elif left and line[:1].islower():
            out = (out[:-1] if (left[1] + head).lower() in words else out) + line
        else:
            out += " " + line
    return out


def test_join_lines_is_the_fold(spark):
    rng = random.Random(4)
    parts = ["Ab", "ab", "b", "c d", "X", "é", "", "7", ".", "ñ-o", "-"]
    rows = [
        (
            k,
            [
                "".join(
                    rng.choices(parts, k=rng.randint(0, 2))
                ) + rng.choice(["", "-", "-", "‐", "­"]) for _ in range(rng.randint(0, 9))
            ]
        ) for k in range(600)
    ]
    words = [x + y + z for x in ("ab", "b", "é") for y in ("ab", "b", "") for z in ("", "b", "é")]
    df = spark.createDataFrame([(*r, words) for r in rows], "k int, lines array<string>, words array<string>")
    got = {r["k"]: r["p"] for r in df.select("k", L.join_lines(F.col("lines"), F.col("words")).alias("p")).collect()}
    assert got == {k: fold_lines(lines, set(words)) for k, lines in rows}


def test_join_lines_is_linear(spark):
    lines = ["some words and a cut wo-", "rd that goes on"] * 20000
    df = spark.createDataFrame([(lines, ["word"])], "lines array<string>, words array<string>")
    assert df.select(
        L.join_lines(F.col("lines"), F.col("words")).alias("p")
    ).first()["p"].startswith("some words and a cut word that goes on some words")
