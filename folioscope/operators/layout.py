"""Headings, dehyphenation and lists from page layout tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, let

# List markers.
BULLET = rf"\A[{WS}]*[•◦▪●‣∙·○♦][{WS}]*([^{WS}].*)\z"
DASH = rf"\A[{WS}]*-[{WS}]+([^{WS}].*)\z"
NUMBERED = rf"\A[{WS}]*(\p{{Nd}}{{1,3}})[.)][{WS}]+([^{WS}].*)\z"
BLOCK = ["doc_id", "page", "block"]


def block_stats(letters: DataFrame) -> DataFrame:
    """Mean size (of positive ones), word, letter and bold counts of each block; mostly bold from 80 % on."""
    stats = letters.groupBy(*BLOCK).agg(
        F.coalesce(F.avg(F.when(F.col("point_size") > 0, F.col("point_size"))), F.lit(0.0)).alias("avg_size"),
        F.count_distinct("line", "word").alias("word_count"), F.count("*").alias("letter_count"),
        F.sum(F.col("is_bold").cast("long")).alias("bold_count"),
    )
    return stats.withColumn("mostly_bold", F.col("bold_count") >= F.col("letter_count") * F.lit(0.8))


def document_stats(letters: DataFrame) -> DataFrame:
    """Median letter size (the mean of the middle two) and share of bold letters of each document."""
    return letters.groupBy("doc_id").agg(
        F.coalesce(F.median(F.when(F.col("point_size") > 0, F.col("point_size"))), F.lit(0.0)).alias("body_size"),
        (F.sum(F.col("is_bold").cast("long")) / F.count("*")).alias("bold_ratio"),
    )


def heading_levels(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """``heading_level`` of every block: 0 for body text.

    blocks: doc_id, page, block, text, n_lines, word_count, avg_size, mostly_bold; documents:
    doc_id, body_size, bold_ratio.  Larger sizes, rounded to half points (banker's), rank first;
    bold lines of body size come one level below, or at 2 without larger ones.
    """
    df = blocks.join(documents, "doc_id")
    text = F.rtrim(F.col("text"))
    plain = (
        F.col("n_lines").between(1, 2)
    )& (F.col("word_count") <= 20) & text.rlike(r"[^.:;,]\z") & ~text.rlike(BULLET) & ~text.rlike(DASH) & (F.col("body_size") > 0)
    large = F.col("avg_size") >= F.col("body_size") * F.lit(1.15)
    by_size = plain & large
    by_bold = plain & ~large & ~text.rlike(NUMBERED) & F.col("mostly_bold") & (F.col("bold_ratio") < 0.5) & (F.col("n_lines") == 1) & (F.col("word_count") <= 12) & (
        F.col("avg_size") >= F.col("body_size") * F.lit(0.95)
    )
    df = df.withColumn("s", F.when(by_size, F.bround(F.col("avg_size") * 2) / 2)).withColumn("b", by_bold)
    w = Window.partitionBy("doc_id").orderBy(F.col("s").desc_nulls_last())
    df = df.withColumn("r", F.dense_rank().over(w))
    sizes = F.coalesce(F.max(F.when(F.col("s").isNotNull(), F.col("r"))).over(Window.partitionBy("doc_id")), F.lit(0))
    bold_level = F.when(sizes == 0, 2).otherwise(F.least(sizes + 1, F.lit(6)))
    return df.withColumn(
        "heading_level",
        F.when(F.col("s").isNotNull(), F.least("r", F.lit(6))).when(F.col("b"), bold_level).otherwise(0)
    ).drop("s", "b", "r")


def vocabulary(lines: Column) -> Column:
    """Distinct lower-case words of three letters or more of an array of lines."""
    words = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}{3,})"), 1)))
    return F.array_distinct(words)


def join_lines(lines: Column, words: Column) -> Column:
    """One paragraph of an array of lines.

    A soft hyphen at a line end goes; another hyphen before a lower-case letter goes if the word
    it splits is in ``words`` and stays without a space if not; all else is joined by a space.

    A border is decided by the letters and hyphen that end what stands before it (of several lines,
    where a word is cut more than once) and by the next line; the text is put together at the end.
    """
    stem = lambda t: F.regexp_replace(t, "[-‐\u00ad]\\z", "")
    merged = lambda t, x: F.concat(F.lower(stem(t)), F.lower(x["head"]))
    hyphen = lambda t, x: t.rlike(r"[-‐]\z") & x["low"]

    def seen(x: Column) -> Column:
        return F.struct(
            x.alias("x"), F.regexp_extract(x, "(\\p{L}*[-‐\u00ad]?)\\z", 1).alias("tail"),
            F.regexp_extract(x, r"\A(\p{L}*)", 1).alias("head"), x.rlike(r"\A\p{Ll}").alias("low"),
        )

    def decide(own: Column, known: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            word = merged(acc["tail"], x)
            empty = acc["only"] & (acc["tail"] == "")
            whole = F.array_contains(known, word) | (acc["cut"] & F.array_contains(words, word))
            cut = ~empty & (acc["tail"].endswith("\u00ad") | (hyphen(acc["tail"], x) & whole))
            joint = F.when(empty, "e").when(cut, "c").when(hyphen(acc["tail"], x), "k").otherwise("s")
            bare = F.length(x["tail"]) == F.length(x["x"])
            goes_on = cut & bare
            return F.struct(
                F.when(goes_on, F.concat(stem(acc["tail"]), x["tail"])).otherwise(x["tail"]).alias("tail"),
                ((empty & bare) | (goes_on & acc["only"])).alias("only"),
                goes_on.alias("cut"), F.concat(acc["joints"], joint).alias("joints"),
            )

        start = F.struct(F.lit("").alias("tail"), F.lit(True).alias("only"), F.lit(False).alias("cut"), F.lit("").alias("joints"))
        return F.split(F.aggregate(own, start, add)["joints"], "")

    def joined(own: Column) -> Column:
        after = F.slice(own, F.lit(2), F.size(own))
        split = F.array_compact(F.zip_with(own, after, lambda a, b: F.when(hyphen(a["tail"], b), merged(a["tail"], b))))
        joints = let(F.array_intersect(words, split), lambda known: decide(own, known))

        def piece(x: Column, joint: Column) -> Column:
            text = F.coalesce(x["x"], F.lit(""))
            return F.when(
                joint == "c", F.substring(text, F.lit(1), F.length(text) - 1)
            ).when(joint == "s", F.concat(text, F.lit(" "))).otherwise(text)

        return F.array_join(F.zip_with(own, F.slice(joints, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), piece), "")

    return let(F.transform(lines, seen), joined)


def classify_lines(lines: DataFrame, order: list[str], doc: str = "doc_id", start: str | None = None) -> DataFrame:
    """``kind`` (ul, ol or null), ``number`` and ``item`` text of every line.

    A dash is a list marker only when it doesn't continue a sentence: the paragraph before it is
    empty or ends in one of . : ; ! ?  ``start`` names a column that is constant within a block.
    """
    text = F.col("text")
    df = lines.withColumns({
        "bullet": F.regexp_extract(text, BULLET, 1), "dash": F.regexp_extract(text, DASH, 1),
        "numbered": F.regexp_extract(text, NUMBERED, 2),
        "num": F.nullif(F.regexp_extract(text, NUMBERED, 1), F.lit("")).cast("int"),
    })
    block = [doc, *([start] if start else [])]
    w = Window.partitionBy(*block).orderBy(*order)
    is_dash = (F.col("dash") != "") & (F.col("bullet") == "")
    sure = (F.col("bullet") != "") | (F.col("numbered") != "")
    df = df.withColumn("run", F.sum(F.when(is_dash, 0).otherwise(1)).over(w))
    r = Window.partitionBy(*block, "run").orderBy(*order)
    # Of a run of dashes after a line: the first whose line before ends a sentence, and all after it, are items.
    head = F.first(F.when(is_dash, F.lit(True)).otherwise(sure)).over(r)
    ended = F.coalesce(
        F.max(F.when(text.rlike(r"[.:;!?]\z"), 1).otherwise(0)).over(r.rowsBetween(Window.unboundedPreceding, -1)) == 1,
        F.lit(False)
    )
    df = df.withColumn("is_item", F.when(is_dash, head | ended).otherwise(sure))
    kind = F.when(F.col("is_item"), F.when((F.col("numbered") != "") & ~is_dash & (F.col("bullet") == ""), "ol").otherwise("ul"))
    item = F.when(F.col("bullet") != "", F.col("bullet")).when(is_dash, F.col("dash")).otherwise(F.col("numbered"))
    return df.withColumn("kind", kind).withColumn(
        "number", F.when(F.col("kind") == "ol", F.col("num"))
    ).withColumn("item", F.when(F.col("is_item"), F.rtrim(item))).drop("bullet", "dash", "numbered", "num", "run", "is_item")


def list_keys(items: DataFrame, order: list[str], doc: str = "doc_id") -> DataFrame:
    """``list_key`` of classified items: a new list where the kind changes or a number does not grow.

    Bullets between two numbers don't reset the last number.
    """
    w = Window.partitionBy(doc).orderBy(*order)
    prior = F.coalesce(F.last("number", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = (~F.col("kind").eqNullSafe(F.lag("kind").over(w))) | ((F.col("kind") == "ol") & (F.col("number") <= prior))
    df = items.withColumn("new", new.cast("int"))
    return df.withColumn("list_key", F.concat("kind", F.sum("new").over(w).cast("string"))).drop("new")


def title(headings: DataFrame, order: list[str], metadata: Column | None = None) -> DataFrame:
    """Title of each document: the metadata's unless blank, else the first heading's text."""
    first = F.min_by("text", F.struct(*order))
    given = F.max(metadata) if metadata is not None else F.lit(None).cast("string")
    return headings.groupBy("doc_id").agg(F.coalesce(F.when(F.trim(given) != "", given), first).alias("title"))


def merge_islands(segments: DataFrame, same: list[str], order: str, doc: str = "doc_id") -> DataFrame:
    """Neighbouring segments that agree in ``same`` become one, texts joined."""
    w = Window.partitionBy(doc).orderBy(order)
    now, before = F.struct(*same), F.lag(F.struct(*same)).over(w)
    df = segments.withColumn("island", F.sum((~now.eqNullSafe(before)).cast("int")).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "")
    return df.groupBy(doc, "island", *same).agg(text.alias("text"))
