"""Markdown of PDF documents from their layout tables.

A parser (``sources.adapters.PdfEngine``) yields letters; everything from there on is here: lines and
blocks, headings by size and weight, paragraphs with cut words joined, lists, page markers, title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import collapse_whitespace, escape_inline, escape_line_start, join_blocks
from ..functions.options import ConversionOptions
from ..functions.text import trim_ws
from . import layout as L

LINE = [*L.BLOCK, "line"]


def text_lines(letters: DataFrame) -> DataFrame:
    """doc_id, page, block, line, text: words joined by a space; blank lines go."""
    joined = lambda by, between: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(by, "text"))), lambda x: x["text"]), between
    )
    words = letters.groupBy(*LINE, "word").agg(joined("letter", "").alias("text"))
    lines = words.groupBy(*LINE).agg(joined("word", " ").alias("text"))
    return lines.withColumn("text", trim_ws(F.col("text"))).filter("text <> ''")


def plain_lines(pages: DataFrame) -> DataFrame:
    """The lines of pages (doc_id, page, text) whose layout could not be read: one block without sizes."""
    split = pages.select("doc_id", "page", F.lit(0).alias("block"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return split.withColumn("text", trim_ws(F.col("text"))).filter("text <> ''")


def _levels(letters: DataFrame, lines: DataFrame, o: ConversionOptions) -> DataFrame:
    """doc_id, page, block, text and ``heading_level`` of every block."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    blocks = lines.groupBy(*L.BLOCK).agg(F.array_join(ordered, " ").alias("text"), F.count("*").alias("n_lines"))
    if not o.detect_headings:
        return blocks.withColumn("heading_level", F.lit(0))
    stats = L.block_stats(letters)
    blocks = blocks.join(stats, L.BLOCK, "left").na.fill(0, ["avg_size", "word_count"]).na.fill(False, ["mostly_bold"])
    none = blocks.select("doc_id").distinct().join(letters, "doc_id", "left_anti").select(
        "doc_id", F.lit(0.0).alias("body_size"), F.lit(0.0).alias("bold_ratio")
    )
    return L.heading_levels(blocks, L.document_stats(letters).unionByName(none)).select(*L.BLOCK, "text", "heading_level")


def _paragraphs(body: DataFrame, lines: DataFrame) -> DataFrame:
    """Runs of lines that are no items, joined; the words of all lines of a document tell which hyphens go."""
    runs = body.filter("kind is null").groupBy("doc_id", "page", "block", "run").agg(
        F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines")
    )
    runs = runs.groupBy("doc_id").agg(
        F.collect_list(
            F.struct(
                "page", "block", F.col("lines")[0]["line"].alias("line"),
                F.transform("lines", lambda x: x["text"]).alias("lines")
            )
        ).alias("runs")
    )
    words = lines.groupBy("doc_id").agg(F.collect_list("text").alias("all")).select(
        "doc_id", L.vocabulary(F.col("all")).alias("words")
    )
    joined = F.transform(
        "runs",
        lambda p: F.struct(
            p["page"].alias("page"), p["block"].alias("block"), p["line"].alias("line"),
            L.join_lines(p["lines"], F.col("words")).alias("text")
        )
    )
    return runs.join(words, "doc_id").select("doc_id", F.explode(joined).alias("p")).select("doc_id", "p.*")


def pdf_markdown(
    letters: DataFrame, documents: DataFrame | None = None, plain: DataFrame | None = None,
    pages: DataFrame | None = None, options: ConversionOptions = ConversionOptions()
) -> DataFrame:
    """doc_id, ``markdown``, ``title`` and ``warnings`` of every document.

    letters: doc_id, page, block, line, word, letter, point_size, is_bold, text, blocks numbered in
    reading order; documents: doc_id and perhaps ``title`` from the file's properties, so that
    documents without letters are not lost; plain: doc_id, page, text of pages whose layout could
    not be read; pages: doc_id, page of all pages, for page markers of pages without text.
    """
    lines = text_lines(letters)
    letters = letters.join(lines.select(*LINE), LINE, "left_semi")
    if plain is not None:
        lines = lines.unionByName(plain_lines(plain))
    levels = _levels(letters, lines, options)
    body = lines.join(
        levels.filter("heading_level = 0").select(*L.BLOCK), L.BLOCK
    ).withColumn("__block", F.struct("page", "block"))
    body = L.classify_lines(body, ["line"], start="__block")
    items = F.col("kind").isNotNull().cast("int")
    body = body.withColumn("run", F.sum(items).over(L.Window.partitionBy("doc_id", "__block").orderBy("line")))

    place = lambda line: F.struct(F.col("page").alias("p"), F.col("block").alias("b"), line.alias("l"))
    no_list = [F.lit(False).alias("is_list_item"), F.lit(None).cast("string").alias("list_key")]
    heads = levels.filter("heading_level > 0").withColumn("text", collapse_whitespace(F.col("text")))
    heads = heads.select(
        "doc_id", place(F.lit(0)).alias("block_ix"),
        F.concat(F.expr("repeat('#', heading_level)"), F.lit(" "), escape_inline(F.col("text"))).alias("text"),
        *no_list, F.col("text").alias("heading")
    )
    none = F.lit(None).cast("string").alias("heading")
    texts = _paragraphs(body, lines).select(
        "doc_id", place(F.col("line")).alias("block_ix"),
        escape_line_start(escape_inline(trim_ws(F.col("text")))).alias("text"), *no_list, none
    )
    keyed = L.list_keys(body.filter("kind is not null"), ["page", "block", "line"])
    mark = F.when(F.col("kind") == "ul", "- ").otherwise(F.concat(F.regexp_extract("text", L.NUMBERED, 1), F.lit(". ")))
    listed = keyed.select(
        "doc_id", place(F.col("line")).alias("block_ix"),
        F.concat(mark, escape_inline(trim_ws(F.col("item")))).alias("text"), F.lit(True).alias("is_list_item"),
        "list_key", none
    )
    blocks = heads.unionByName(texts).unionByName(listed)
    if options.include_page_markers:
        every = (pages if pages is not None else lines).select("doc_id", "page").distinct()
        # Fixed value: the marker.
        marker = F.concat(F.lit("<!-- Página "), F.col("page").cast("string"), F.lit(" -->"))
        blocks = blocks.unionByName(
            every.select(
                "doc_id",
                F.struct(F.col("page").alias("p"), F.lit(-1).alias("b"), F.lit(0).alias("l")).alias("block_ix"),
                marker.alias("text"), *no_list, none
            )
        )

    found = blocks.filter("heading is not null").groupBy("doc_id").agg(F.min_by("heading", "block_ix").alias("heading"))
    known = documents if documents is not None else lines.select("doc_id").distinct()
    given = F.nullif(trim_ws(F.col("title")), F.lit("")) if "title" in known.columns else F.lit(None).cast("string")
    named = known.select(
        "doc_id", F.when(given.isNotNull(), F.col("title") if "title" in known.columns else given).alias("given")
    )
    out = named.join(join_blocks(blocks), "doc_id", "left").join(found, "doc_id", "left").join(
        letters.select("doc_id", F.lit(True).alias("read")).distinct(), "doc_id", "left"
    )
    warnings = F.array(
        F.when(F.col("read").isNull(), "no text can be extracted; the document is probably scanned and needs recognition")
    )
    if plain is not None:
        failed = plain.groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("failed"))
        out = out.join(failed, "doc_id", "left")
        each = F.transform(
            "failed",
            lambda p: F.concat(F.lit("layout analysis failed on page "), p.cast("string"), F.lit("; its text is plain"))
        )
        warnings = F.concat(F.coalesce(each, F.array().cast("array<string>")), warnings)
    return out.select(
        "doc_id", F.coalesce("markdown", F.lit("")).alias("markdown"), F.coalesce("given", "heading").alias("title"),
        F.array_compact(warnings).alias("warnings")
    )
