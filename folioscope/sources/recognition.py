"""Flows over engines: PDF to Markdown, text of PDFs and pictures, handwriting.

Engines see only what they must: pages without enough embedded text, embedded pictures of some size,
pages whose ink may be handwriting.  All else is the relational operators.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.options import ConversionOptions, HandwritingOptions, OcrOptions
from ..operators import geometry as G
from ..operators.ocr import assemble_documents, choose_page_text
from ..operators.pdf import pdf_markdown
from ..tables import stored
from . import adapters as A

UNKNOWN = "the format is not one of pdf, png, jpeg, tiff"


def convert_pdfs(
    df: DataFrame, factory: Callable[[], A.PdfEngine], options: ConversionOptions = ConversionOptions()
) -> DataFrame:
    """doc_id, markdown, title, warnings and error of PDF documents (doc_id, content)."""
    documents = A.pdf_documents(df, factory)
    pages = documents.filter("pages > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "pages")).alias("page"))
    out = pdf_markdown(A.pdf_letters(df, factory), documents.filter("error is null"), pages=pages, options=options)
    return documents.select("doc_id", "error").join(out, "doc_id", "left").select(
        "doc_id", "markdown", "title", "warnings", "error"
    )


def recognise_pages(
    df: DataFrame, pdf: Callable[[], A.PdfEngine], ocr: Callable[[], A.OcrEngine], options: OcrOptions = OcrOptions()
) -> DataFrame:
    """doc_id, page, text, confidence, from_embedded, kind (pdf or image) and error of every page.

    df: doc_id, content and perhaps path.  A page of a PDF with enough embedded text keeps it, with
    confidence -1; others are drawn and recognised.  A picture is a page, a TIFF as many as it has.
    """
    files = A.with_format(df)
    blank = files.filter("content is null or octet_length(content) = 0").select(
        "doc_id", F.lit("the document is empty").alias("error")
    )
    files = files.filter("octet_length(content) > 0")
    pdfs, pictures = files.filter("format = 'pdf'"), files.filter("format in ('png', 'jpeg', 'tiff')")
    odd = files.filter("format = 'unknown'").select("doc_id", F.lit(UNKNOWN).alias("error"))

    known = A.pdf_documents(pdfs, pdf)
    pages = known.filter("pages > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "pages")).alias("page"))
    texts = A.pdf_page_texts(pdfs, pdf) if options.prefer_embedded else A.pdf_page_texts(pdfs.limit(0), pdf)
    pages = pages.join(texts.select("doc_id", "page", "embedded_text"), ["doc_id", "page"], "left")
    chosen = choose_page_text(
        pages.withColumns({"ocr_text": F.lit(""), "ocr_confidence": F.lit(0.0).cast("float")}),
        options.min_embedded_chars
    )
    kept = chosen.filter("from_embedded").select(
        "doc_id", "page", "text", "confidence", "from_embedded", F.lit("pdf").alias("kind"),
        F.lit(None).cast("string").alias("error")
    )

    drawn = A.pdf_renders(pdfs.join(chosen.filter("not from_embedded").select("doc_id", "page"), "doc_id"), pdf, options.pdf_dpi)
    failed = drawn.filter("error is not null").select("doc_id", "page", "error")
    read = A.ocr_images(drawn.filter("error is null"), ocr, options.languages).filter("part = 1").withColumn("kind", F.lit("pdf"))
    single = A.ocr_images(
        pictures.withColumn("page", F.lit(1)), ocr, options.languages
    ).withColumn("page", F.col("part")).withColumn("kind", F.lit("image"))
    seen = read.unionByName(single)
    seen = seen.select(
        "doc_id", "page", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("confidence", F.lit(0.0)).cast("float").alias("confidence"), F.lit(False).alias("from_embedded"),
        "kind", "error"
    )

    def errors(rows: DataFrame, kind: str, page=F.lit(0)) -> DataFrame:
        return rows.select(
            "doc_id", page.alias("page"), F.lit("").alias("text"), F.lit(0.0).cast("float").alias("confidence"),
            F.lit(False).alias("from_embedded"), F.lit(kind).alias("kind"), "error"
        )

    out = kept.unionByName(seen).unionByName(errors(failed, "pdf", F.col("page")))
    return out.unionByName(
        errors(known.filter("error is not null"), "pdf")
    ).unionByName(errors(odd.unionByName(blank), "unknown"))


def recognise(
    df: DataFrame, pdf: Callable[[], A.PdfEngine], ocr: Callable[[], A.OcrEngine], options: OcrOptions = OcrOptions()
) -> DataFrame:
    """doc_id, text, pages, mean_confidence, source_kind and error of every document.

    source_kind: pdf_text, pdf_ocr or mixed, image for pictures; a document with any error has no text.
    A PDF without pages is pdf_text of no pages.
    """
    pages = recognise_pages(df, pdf, ocr, options)
    wrong = pages.filter("error is not null").groupBy("doc_id").agg(F.min_by("error", "page").alias("error"))
    pictures = pages.filter("kind = 'image'").select("doc_id", F.lit(True).alias("picture")).distinct()
    out = df.select("doc_id").distinct().join(wrong, "doc_id", "left").join(
        assemble_documents(pages.filter("page > 0")), "doc_id", "left"
    ).join(pictures, "doc_id", "left")
    fine = lambda c: F.when(F.col("error").isNull(), c)
    return out.select(
        "doc_id", fine(F.coalesce("text", F.lit(""))).alias("text"), fine(F.coalesce("pages", F.lit(0))).alias("pages"),
        fine(F.coalesce("mean_confidence", F.lit(-1.0).cast("float"))).alias("mean_confidence"),
        fine(F.when(F.col("picture"), "image").otherwise(F.coalesce("source_kind", F.lit("pdf_text")))).alias("source_kind"),
        "error",
    )


def recognise_embedded_images(
    df: DataFrame, pdf: Callable[[], A.PdfEngine], ocr: Callable[[], A.OcrEngine], options: OcrOptions = OcrOptions()
) -> DataFrame:
    """doc_id, page, image_ix, text, confidence of the pictures inside PDFs.

    Small ones are not looked at; those that can't be read or have no text are left out, so a page
    may have several rows or none.
    """
    images = A.pdf_images(df, pdf, options.min_image_pixels)
    # The engine's page number carries the picture's place.
    keyed = images.select("doc_id", F.col("page").alias("p"), "image_ix", F.struct("page", "image_ix").alias("k"), "content")
    read = A.per_document(
        keyed.select(F.col("doc_id"), "content", "p", "image_ix"), ocr,
        A.quiet(
            lambda e, data, page, ix: [
                {"page": int(page), "image_ix": int(ix), "text": t, "confidence": A.percent(c)} for t,
                c in e.recognize(data, options.languages)[:1]
            ]
        ),
        "doc_id long, page int, image_ix int, text string, confidence float", ("doc_id", "content", "p", "image_ix"),
    )
    return read.filter(F.trim(F.coalesce("text", F.lit(""))) != "")


def extract_text(
    spark: SparkSession, path: str, pdf: Callable[[], A.PdfEngine], ocr: Callable[[], A.OcrEngine],
    options: OcrOptions = OcrOptions()
) -> str:
    """The text of one file."""
    rows = spark.read.format("binaryFile").load(path).select(F.lit(0).cast("long").alias("doc_id"), "path", "content")
    got = recognise(rows, pdf, ocr, options).first()
    if got["error"]:
        raise ValueError(got["error"])
    return got["text"]


def scaled(width: int, height: int, rgba: bytes, max_side: int) -> tuple[np.ndarray, float]:
    """RGB of a picture on white, no side longer than ``max_side`` (nearest pixels), and the scale."""
    x = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)
    scale = min(1.0, max_side / max(width, height))
    w, h = max(1, round(width * scale)), max(1, round(height * scale))
    at = lambda n, full: np.minimum(((np.arange(n) + 0.5) * full / n).astype(int), full - 1)
    x = x[at(h, height)][:, at(w, width)].astype(np.int32)
    alpha = x[..., 3:]
    return (x[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255, scale


def threshold(gray: np.ndarray) -> int:
    """The first best split of the gray levels; 127 where there is one level only."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    wb, sb = np.cumsum(n), np.cumsum(n * np.arange(256))
    wf = wb[-1] - wb
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((wb > 0) & (wf > 0), wb * wf * (sb / wb - (sb[-1] - sb) / wf) ** 2, -1)
    return int(between.argmax()) if between.max() > 0 else 127


INK = "doc_id long, page int, width int, height int, scale double, ink binary, colour binary"


def ink_pages(pictures: DataFrame, decoder: Callable[[], A.ImageDecoder], max_side: int = 1600) -> DataFrame:
    """Ink and colour masks of pictures (doc_id, page, content); pages that are too small, empty or full have no ink."""

    def each(d: A.ImageDecoder, data: bytes, page: int) -> list[dict]:
        got = d.decode(data)
        if got is None:
            return []
        rgb, scale = scaled(*got, max_side)
        gray = ((rgb * [77, 150, 29]).sum(2) >> 8).astype(np.uint8)
        colour = rgb.max(2) - rgb.min(2) > 60
        ink = gray < threshold(gray)
        if min(ink.shape) < 10 or not 0.002 <= ink.mean() <= 0.5:
            ink = np.zeros_like(ink)
        return [
            {
                "page": int(page), "width": ink.shape[1], "height": ink.shape[0], "scale": scale, "ink": ink.tobytes(),
                "colour": colour.tobytes()
            }
        ]

    return A.per_document(pictures, decoder, A.quiet(each), INK, ("doc_id", "content", "page"))


def ink_candidates(pages: DataFrame, o: HandwritingOptions = HandwritingOptions()) -> tuple[DataFrame, DataFrame]:
    """Regions (doc_id, page, x, y, w, h, score) in the pixels of the original, and doc_id, page, max_score.

    Connected strokes come first, then words of irregular shape; of two that overlap the earlier stays.
    """
    # What pixels yield is small and read several times; it is written, so that pixels are scanned once.
    comps = stored(G.connected_components(pages), "components")
    size = pages.select(*G.PAGE, "width", "height", "scale")
    placed = comps.join(size, G.PAGE)
    glyphs = G.filter_glyphs(placed, F.col("width"), F.col("height"))
    median = glyphs.groupBy(*G.PAGE).agg(F.count("*").alias("glyphs"), G.upper_median(F.col("h")).alias("letter_h"))
    strokes = G.stroke_scores(placed.join(median, G.PAGE), F.col("width"), F.col("height"), F.col("letter_h"), o)
    strokes = strokes.select(
        *G.PAGE, F.lit(0).alias("rank"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("word"), "comp", "x", "y",
        "w", "h", "score"
    )
    enough = glyphs.join(
        median.filter(F.col("glyphs") >= o.min_glyphs).select(*G.PAGE), G.PAGE, "left_semi"
    ).select(*comps.columns, "w", "h", "cx", "cy")
    words = G.word_scores(G.split_words(G.group_lines(enough)), o)
    words = words.select(*G.PAGE, F.lit(1).alias("rank"), "line", "word", F.lit(0).alias("comp"), "x", "y", "w", "h", "score")
    both = (strokes.unionByName(words) if o.detect_strokes else words).join(size, G.PAGE)
    both = both.withColumns({c: (F.col(c) / F.col("scale")).cast("int") for c in ("x", "y", "w", "h")})
    best = both.groupBy(*G.PAGE).agg(F.max("score").alias("max_score"))
    kept = G.first_of_overlapping(
        both.filter(F.col("score") >= o.min_score).drop("width", "height", "scale"), ["rank", "line", "word", "comp"]
    )
    return kept.select(*G.PAGE, "x", "y", "w", "h", "score"), best


def detect_handwriting(
    df: DataFrame, pdf: Callable[[], A.PdfEngine], decoder: Callable[[], A.ImageDecoder],
    ocr: Callable[[], A.OcrEngine] | None = None, options: HandwritingOptions = HandwritingOptions()
) -> DataFrame:
    """doc_id, has_handwriting, region_count, max_score, regions and error of documents (doc_id, content, perhaps path).

    Pages of PDFs are drawn; a picture (a TIFF too) is one page.  With an engine, pages with
    candidates are recognised: printed text clears a page, words of low confidence add regions.
    Masks, components, candidates and words are tables in the shared folder until their ``scope`` closes.
    """
    files = A.with_format(df)
    pdfs, pictures = files.filter("format = 'pdf'"), files.filter("format in ('png', 'jpeg', 'tiff')")
    known = A.pdf_documents(pdfs, pdf)
    pages = known.filter("pages > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "pages")).alias("page"))
    drawn = A.pdf_renders(pdfs.join(pages, "doc_id"), pdf, options.pdf_dpi)
    seen = drawn.filter("error is null").select("doc_id", "page", "content").unionByName(
        pictures.select("doc_id", F.lit(1).alias("page"), "content")
    )
    masks = stored(ink_pages(seen, decoder, options.max_side), "masks")
    geometry, best = (stored(x, "candidates") for x in ink_candidates(masks, options))

    regions = geometry
    if ocr is not None and options.corroborate:
        # The engine sees pages with candidates only.
        words = stored(
            A.ocr_words(seen.join(geometry.select(*G.PAGE).distinct(), G.PAGE, "left_semi"), ocr, options.languages),
            "words"
        )
        coloured = G.colour_fractions(masks, words)
        low = G.low_confidence_words(
            coloured.join(masks.select(*G.PAGE, (F.col("height") / F.col("scale")).alias("page_h")), G.PAGE),
            F.col("page_h"), options
        )
        found = G.word_regions(G.word_rows(low.select(*words.columns, "colour"))).select(*G.PAGE, "x", "y", "w", "h", "score")
        regions = G.page_regions(geometry, found, G.mean_confidence(words), options)

    per_page = regions.groupBy(*G.PAGE).agg(
        F.array_sort(F.collect_list(F.struct("y", "x", "w", "h", "score"))).alias("regions"),
        F.max("score").alias("top")
    )
    every = masks.select(*G.PAGE).join(per_page, G.PAGE, "left").join(best, G.PAGE, "left")
    every = every.select(
        *G.PAGE, F.coalesce("regions", F.array().cast(per_page.schema["regions"].dataType)).alias("regions"),
        F.coalesce("top", "max_score", F.lit(0.0)).alias("max_score")
    )
    out = G.document_rollup(every, options)
    wrong = drawn.filter("error is not null").groupBy("doc_id").agg(F.min("error").alias("error")).unionByName(
        known.filter("error is not null").select("doc_id", "error")
    )
    wrong = wrong.unionByName(files.filter("format = 'unknown'").select("doc_id", F.lit(UNKNOWN).alias("error")))
    wrong = wrong.unionByName(
        pictures.join(masks.select("doc_id").distinct(), "doc_id", "left_anti").select(
            "doc_id", F.lit("the image cannot be decoded").alias("error")
        )
    )
    rows = df.select("doc_id").distinct().join(wrong, "doc_id", "left").join(out, "doc_id", "left")
    fine = lambda c: F.when(F.col("error").isNull(), c)
    return rows.select(
        "doc_id", fine(F.coalesce("has_handwriting", F.lit(False))).alias("has_handwriting"),
        fine(F.coalesce("region_count", F.lit(0))).alias("region_count"),
        fine(F.coalesce("max_score", F.lit(0.0))).alias("max_score"), "regions", "error"
    )
