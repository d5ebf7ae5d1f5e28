"""Recognised text of pages, assembled into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, trim_ws


def choose_page_text(pages: DataFrame, least: int = 16) -> DataFrame:
    """``text``, ``confidence`` and ``from_embedded`` of every page.

    pages: doc_id, page, embedded_text, ocr_text, ocr_confidence.  Embedded text of at least
    ``least`` characters other than white space is taken, trimmed, with confidence -1.
    """
    embedded = F.length(F.regexp_replace(F.coalesce(F.col("embedded_text"), F.lit("")), f"[{WS}]", "")) >= least
    return pages.select(
        "doc_id", "page",
        F.when(embedded, trim_ws(F.col("embedded_text"))).otherwise(F.coalesce(F.col("ocr_text"), F.lit(""))).alias("text"),
        F.when(embedded, F.lit(-1.0)).otherwise(F.col("ocr_confidence").cast("double")).cast("float").alias("confidence"),
        embedded.alias("from_embedded"),
    )


def pages_to_recognise(pages: DataFrame, least: int = 16) -> DataFrame:
    """Pages without enough embedded text: the only ones an engine has to see."""
    return pages.filter(F.length(F.regexp_replace(F.coalesce(F.col("embedded_text"), F.lit("")), f"[{WS}]", "")) < least)


def assemble_documents(pages: DataFrame) -> DataFrame:
    """Text in page order, pages, mean confidence of recognised pages (-1 without) and kind of source."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    out = pages.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"), F.count("*").alias("pages"),
        F.coalesce(
            F.avg(F.when(~F.col("from_embedded"), F.col("confidence").cast("double"))), F.lit(-1.0)
        ).cast("float").alias("mean_confidence"),
        F.bool_or("from_embedded").alias("e"), F.bool_or(~F.col("from_embedded")).alias("o"),
    )
    return out.withColumn(
        "source_kind", F.when(F.col("e") & F.col("o"), "mixed").when(F.col("o"), "pdf_ocr").otherwise("pdf_text")
    ).drop("e", "o")


def large_images(images: DataFrame, least_pixels: int = 40_000) -> DataFrame:
    """Embedded images worth recognising."""
    return images.filter(F.col("width").cast("long") * F.col("height").cast("long") >= least_pixels)
