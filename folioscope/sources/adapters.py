"""Interfaces for engines that are not part of the library: PDF parsers, recognisers, image decoders.

An adapter is made once for each worker process by a factory, so native engines are pooled by cores.
What it yields is the input of the layout, OCR and geometry operators; the flows over them are in
``sources.recognition``.  One document that an engine cannot read gives a row with ``error`` where a
function has that column, and no rows where it has not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import detect_format
from ..session import ship


class PdfEngine(Protocol):
    """Pages count from 1.  ``letters`` yields the columns of LETTERS but doc_id, blocks in reading order."""

    def page_count(self, data: bytes) -> int: ...
    def title(self, data: bytes) -> str | None: ...
    def embedded_text(self, data: bytes) -> list[str]: ...
    def embedded_images(self, data: bytes, page: int) -> list[tuple[bytes, int, int]]: ...
    def render(self, data: bytes, page: int, dpi: int) -> bytes: ...
    def letters(self, data: bytes) -> Iterator[dict]: ...


class OcrEngine(Protocol):
    """``recognize`` gives a text and a confidence (0 to 1 or to 100) for each image in a file: one, or a page each of a TIFF."""

    def recognize(self, image: bytes, languages: str) -> list[tuple[str, float]]: ...
    def words(self, image: bytes, languages: str) -> Iterator[dict]: ...


class ImageDecoder(Protocol):
    """Width, height and RGBA bytes of the first image in a file; None where it cannot be read."""

    def decode(self, data: bytes) -> tuple[int, int, bytes] | None: ...


_engines: dict[Callable, object] = {}


def engine(factory: Callable):
    """The engine of this worker process."""
    if factory not in _engines:
        _engines[factory] = factory()
    return _engines[factory]


DOCUMENTS = "doc_id long, pages int, title string, error string"
LETTERS = "doc_id long, page int, block int, line int, word int, letter int, point_size double, is_bold boolean, text string"
PAGES = "doc_id long, page int, embedded_text string, ocr_text string, ocr_confidence float"
IMAGES = "doc_id long, page int, image_ix int, content binary, width int, height int"
WORDS = "doc_id long, page int, word int, text string, confidence float, x int, y int, w int, h int"
TEXTS = "doc_id long, page int, part int, text string, confidence float, error string"


def per_document(
    df: DataFrame, factory: Callable, each: Callable, schema: str, columns: tuple[str, ...] = ("doc_id", "content")
) -> DataFrame:
    """Rows that ``each(engine, *columns after doc_id)`` yields for each row of ``df``, document by document."""
    ship(df.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = engine(factory)
        for pdf in batches:
            for doc, *values in zip(*(pdf[c] for c in columns)):
                rows = [{"doc_id": doc, **row} for row in each(own, *values)]
                if rows:
                    yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return df.select(*columns).mapInPandas(run, schema)


def quiet(each: Callable) -> Callable:
    """``each`` without the documents it fails on."""

    def run(*args):
        try:
            return list(each(*args))
        except Exception:  # an engine may raise anything; pdf_documents says so
            return []

    return run


def percent(confidence: float) -> float:
    return confidence * 100 if confidence <= 1 else confidence


def pdf_documents(df: DataFrame, factory: Callable[[], PdfEngine]) -> DataFrame:
    """Page count and title of PDF documents (doc_id, content), or why one can't be read."""

    def each(e: PdfEngine, data: bytes | None) -> list[dict]:
        try:
            if not data:
                raise ValueError("the document is empty")
            return [{"pages": e.page_count(data), "title": e.title(data)}]
        except Exception as x:
            return [{"error": f"{type(x).__name__}: {x}"}]

    return per_document(df, factory, each, DOCUMENTS)


def pdf_letters(df: DataFrame, factory: Callable[[], PdfEngine]) -> DataFrame:
    """The letters table of PDF documents (doc_id, content)."""
    return per_document(df, factory, quiet(lambda e, data: e.letters(data)), LETTERS)


def pdf_page_texts(df: DataFrame, factory: Callable[[], PdfEngine]) -> DataFrame:
    """The pages table with embedded text; recognised text is null."""
    return per_document(
        df, factory,
        quiet(lambda e, data: [{"page": k, "embedded_text": t} for k, t in enumerate(e.embedded_text(data), 1)]), PAGES
    )


def pdf_images(df: DataFrame, factory: Callable[[], PdfEngine], min_pixels: int = 0) -> DataFrame:
    """Embedded images of ``min_pixels`` or more by page; ``image_ix`` counts from 1 those that are kept."""

    def each(e: PdfEngine, data: bytes) -> Iterator[dict]:
        for page in range(1, e.page_count(data) + 1):
            kept = [x for x in e.embedded_images(data, page) if x[0] and x[1] * x[2] >= min_pixels]
            for k, (content, width, height) in enumerate(kept, 1):
                yield {"page": page, "image_ix": k, "content": content, "width": width, "height": height}

    return per_document(df, factory, quiet(each), IMAGES)


def pdf_renders(df: DataFrame, factory: Callable[[], PdfEngine], dpi: int) -> DataFrame:
    """Pictures of single pages: df has doc_id, content, page; result doc_id, page, content, error."""

    def each(e: PdfEngine, data: bytes, page: int) -> list[dict]:
        try:
            return [{"page": int(page), "content": e.render(data, int(page), dpi)}]
        except Exception as x:
            return [{"page": int(page), "error": f"{type(x).__name__}: {x}"}]

    return per_document(df, factory, each, "doc_id long, page int, content binary, error string", ("doc_id", "content", "page"))


def ocr_images(df: DataFrame, factory: Callable[[], OcrEngine], languages: str = "spa") -> DataFrame:
    """Text and confidence of pictures (doc_id, page, content): ``part`` counts the images in a file from 1."""

    def each(e: OcrEngine, data: bytes | None, page: int) -> list[dict]:
        try:
            found = e.recognize(data, languages)
            return [
                {"page": int(page), "part": k, "text": text or "", "confidence": percent(c)} for k,
                (text, c) in enumerate(found, 1)
            ]
        except Exception as x:
            return [{"page": int(page), "part": 1, "error": f"{type(x).__name__}: {x}"}]

    return per_document(df, factory, each, TEXTS, ("doc_id", "content", "page"))


def ocr_words(df: DataFrame, factory: Callable[[], OcrEngine], languages: str = "spa") -> DataFrame:
    """The words table of pictures (doc_id, content, and page; 1 where there is no such column)."""
    pictures = df if "page" in df.columns else df.withColumn("page", F.lit(1))
    each = quiet(lambda e, data, page: [{"page": int(page), "word": k, **w} for k, w in enumerate(e.words(data, languages))])
    return per_document(pictures, factory, each, WORDS, ("doc_id", "content", "page"))


def with_format(df: DataFrame) -> DataFrame:
    """Add ``format``: pdf, png, jpeg, tiff or unknown, by the first bytes, else by ``path``."""
    return df.withColumn("format", detect_format(F.col("content"), F.col("path") if "path" in df.columns else F.lit("")))
