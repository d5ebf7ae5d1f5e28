"""Queries of the layout and OCR operators over lines of ``documents``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.markdown import join_blocks
from ..operators import layout as L
from ..operators import ocr as O
from .common import table

#: Markers put before every line by its number, so the list rules have work.
_MARK = ["", "• ", "- ", "", "@. ", "@) ", "- "]
_MARK_SQL = "(list_value({}))[CAST(ix % 7 AS INTEGER) + 1]".format(", ".join(map(repr, _MARK)))


def _lines(spark, sf_dir):
    """doc_id, ix, line: the non-blank lines of every document, numbered from 0."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "").alias("lines")
    )
    return rows.select("doc_id", F.posexplode("lines").alias("ix", "line"))


_LINES = "lines AS (SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS ix, unnest(l) AS line FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents) AS q)"


def _marked(spark, sf_dir):
    mark = F.element_at(F.array(*map(F.lit, _MARK)), (F.col("ix") % 7 + 1).cast("int"))
    number = ((F.col("ix") * 5 + F.col("doc_id")) % 11 + 1).cast("string")
    return _lines(spark, sf_dir).select(
        "doc_id", "ix", F.concat(F.replace(mark, F.lit("@"), number), F.trim("line")).alias("text")
    )


_MARKED = f"{_LINES}, marked AS (SELECT doc_id, ix, replace({_MARK_SQL}, '@', CAST((ix * 5 + doc_id) % 11 + 1 AS VARCHAR)) || trim(line) AS text FROM lines)"


def _letters(spark, sf_dir):
    """A letter row for each word of each line, with a size and weight by line number."""
    words = _lines(spark, sf_dir).select("doc_id", "ix", F.posexplode(F.split(F.trim("line"), " +")).alias("word", "w"))
    size = F.when(F.col("ix") % 5 == 0, 14.0 + F.col("ix") % 3).otherwise(10.0 + (F.col("word") % 2) / 4.0)
    return words.select(
        "doc_id", (F.col("ix") / 20).cast("int").alias("page"), F.col("ix").alias("block"), F.lit(0).alias("line"),
        "word", F.lit(0).alias("letter"), size.alias("point_size"), (F.col("ix") % 6 == 1).alias("is_bold")
    )


_LETTERS = (
    _LINES + ", words AS (SELECT doc_id, ix, CAST(unnest(range(0, len(w))) AS INTEGER) AS word FROM (SELECT doc_id, ix, regexp_split_to_array(trim(line), ' +') AS w FROM lines) AS q), "
    "letters AS (SELECT doc_id, ix // 20 AS page, ix AS block, word, CASE WHEN ix % 5 = 0 THEN CAST(14.0 + ix % 3 AS DOUBLE) ELSE CAST(10.0 AS DOUBLE) + (word % 2) / CAST(4.0 AS DOUBLE) END AS point_size, ix % 6 = 1 AS is_bold FROM words), "
    "stats AS (SELECT doc_id, page, block, avg(CASE WHEN point_size > 0 THEN point_size END) AS avg_size, count(DISTINCT word) AS word_count, count(*) AS letter_count, CAST(sum(CAST(is_bold AS INTEGER)) AS BIGINT) AS bold_count FROM letters GROUP BY ALL)"
)


def layout_block_stats(spark, sf_dir):
    return L.block_stats(_letters(spark, sf_dir)).select(
        "doc_id", "page", "block", F.round("avg_size", 6).alias("avg_size"), "word_count", "letter_count", "bold_count",
        "mostly_bold"
    )


def layout_document_stats(spark, sf_dir):
    return L.document_stats(_letters(spark, sf_dir)).select(
        "doc_id", F.round("body_size", 6).alias("body_size"), F.round("bold_ratio", 6).alias("bold_ratio")
    )


def _blocks(spark, sf_dir):
    letters = _letters(spark, sf_dir)
    # Lines without their last mark, so some qualify as headings.
    text = F.when(F.col("ix") % 2 == 0, F.regexp_replace("line", "[.:;, ]+$", "")).otherwise(F.col("line"))
    lines = _lines(spark, sf_dir).select("doc_id", F.col("ix").alias("block"), text.alias("text"), F.lit(1).alias("n_lines"))
    return L.block_stats(letters).join(lines, ["doc_id", "block"]), L.document_stats(letters)


def heading_levels(spark, sf_dir):
    return L.heading_levels(*_blocks(spark, sf_dir)).select("doc_id", "page", "block", "heading_level")


def layout_titles(spark, sf_dir):
    found = L.heading_levels(*_blocks(spark, sf_dir)).filter("heading_level > 0")
    return L.title(found, ["page", "block"])


_HEADINGS = (
    f"WITH {_LETTERS}, docs AS (SELECT doc_id, median(CASE WHEN point_size > 0 THEN point_size END) AS body_size, avg(CAST(is_bold AS DOUBLE)) AS bold_ratio FROM letters GROUP BY doc_id), "
    "b AS (SELECT s.*, d.body_size, d.bold_ratio, CASE WHEN l.ix % 2 = 0 THEN regexp_replace(l.line, '[.:;, ]+$', '') ELSE l.line END AS text FROM stats s JOIN docs d ON s.doc_id = d.doc_id JOIN lines l ON l.doc_id = s.doc_id AND l.ix = s.block), "
    "c AS (SELECT *, word_count <= 20 AND regexp_matches(rtrim(text), '[^.:;,]\\z') AND NOT regexp_matches(rtrim(text), '\\A\\s*[•◦▪●‣∙·○♦]\\s*\\S') AND NOT regexp_matches(rtrim(text), '\\A\\s*-\\s+\\S') AS plain FROM b), "
    "e AS (SELECT *, CASE WHEN plain AND avg_size >= body_size * CAST(1.15 AS DOUBLE) THEN round_even(avg_size * 2, 0) / 2 END AS s, "
    "plain AND avg_size < body_size * CAST(1.15 AS DOUBLE) AND NOT regexp_matches(rtrim(text), '\\A\\s*[0-9]{1,3}[.)]\\s+\\S') AND bold_count >= letter_count * CAST(0.8 AS DOUBLE) AND bold_ratio < 0.5 AND word_count <= 12 AND avg_size >= body_size * CAST(0.95 AS DOUBLE) AS bold FROM c), "
    "r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY s DESC NULLS LAST) AS r FROM e), "
    "z AS (SELECT *, coalesce(max(CASE WHEN s IS NOT NULL THEN r END) OVER (PARTITION BY doc_id), 0) AS sizes FROM r), "
    "h AS (SELECT doc_id, page, block, text, CAST(CASE WHEN s IS NOT NULL THEN least(r, 6) WHEN bold THEN CASE WHEN sizes = 0 THEN 2 ELSE least(sizes + 1, 6) END ELSE 0 END AS INTEGER) AS heading_level FROM z) "
)


def vocabulary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(L.vocabulary(F.split("text", "\n", -1))).alias("word"))


def _hyphenated():
    """Lines cut inside words: before every ' th' with a hyphen, before 'in' with a soft one."""
    return F.split(
        F.replace(
            F.replace(F.replace(F.col("text"), F.lit("tion"), F.lit("ti-\non")), F.lit(" th"), F.lit("-\nth")),
            F.lit("ing"), F.lit("i­\nng")
        ),
        "\n", -1
    )


_HYPHENATED = "string_split(replace(replace(replace(text, 'tion', 'ti-' || chr(10) || 'on'), ' th', '-' || chr(10) || 'th'), 'ing', 'i' || chr(173) || chr(10) || 'ng'), chr(10))"


def dehyphenate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.filter(_hyphenated(), lambda x: x != "").alias("lines"),
        L.vocabulary(F.split("text", "\n", -1)).alias("words")
    )
    return rows.select("doc_id", L.join_lines(F.col("lines"), F.col("words")).alias("paragraph"))


def list_islands(spark, sf_dir):
    items = L.classify_lines(_marked(spark, sf_dir), ["ix"]).filter("kind is not null")
    return L.list_keys(items, ["ix"]).select("doc_id", "ix", "kind", "number", "item", "list_key")


def block_separators(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    # A turn can occur once only in a document's order: the role breaks ties.
    blocks = c.groupBy(F.col("conv_id").alias("doc_id"), "turn", "role").agg(F.max("text").alias("text")).select(
        "doc_id", F.struct("turn", "role").alias("block_ix"),
        F.when(F.col("turn") % 5 == 4, "  ").otherwise(F.concat(F.trim("text"), F.lit("  "))).alias("text"),
        (F.col("turn") % 4 != 0).alias("is_list_item"),
        F.concat(F.lit("k"), (F.col("turn") / 2).cast("int").cast("string")).alias("list_key"),
    )
    return join_blocks(blocks)


def merged_segments(spark, sf_dir):
    segments = _lines(spark, sf_dir).select(
        "doc_id", "ix", F.col("line").alias("text"), (F.col("ix") % 4 < 2).alias("bold"),
        (F.length("line") % 3 == 0).alias("italic")
    )
    return L.merge_islands(segments, ["bold", "italic"], "ix").select(
        "doc_id", F.col("island").cast("long").alias("island"), "bold", "italic", "text"
    )


def ocr_page_rollup(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    pages = lines.select(
        "doc_id", F.col("ix").alias("page"),
        F.when(F.col("ix") % 3 != 1, F.concat(F.lit(" "), "line")).alias("embedded_text"),
        F.concat(F.lit("ocr "), "line").alias("ocr_text"),
        (F.lit(60) + F.length("line") % 40).cast("float").alias("ocr_confidence")
    )
    out = O.assemble_documents(O.choose_page_text(pages))
    return out.select(
        "doc_id", "text", "pages", F.round(F.col("mean_confidence").cast("double"), 3).alias("mean_confidence"),
        "source_kind"
    )


def ocr_large_images(spark, sf_dir):
    images = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") * 9).alias("width"), (F.col("p_partkey") % 400).cast("int").alias("height")
    )
    return O.large_images(images)


QUERIES = {
    f.__name__: f for f in (
        layout_block_stats, layout_document_stats, heading_levels, layout_titles, vocabulary, dehyphenate, list_islands,
        block_separators, merged_segments, ocr_page_rollup, ocr_large_images
    )
}

SQL = {
    "layout_block_stats": f"WITH {_LETTERS} SELECT doc_id, page, block, round(avg_size, 6) AS avg_size, word_count, letter_count, bold_count, bold_count >= letter_count * CAST(0.8 AS DOUBLE) AS mostly_bold FROM stats",
    "layout_document_stats": f"WITH {_LETTERS} SELECT doc_id, round(median(CASE WHEN point_size > 0 THEN point_size END), 6) AS body_size, round(avg(CAST(is_bold AS DOUBLE)), 6) AS bold_ratio FROM letters GROUP BY doc_id",
    "heading_levels": _HEADINGS + "SELECT doc_id, page, block, heading_level FROM h",
    "layout_titles": _HEADINGS + "SELECT doc_id, arg_min(text, page * 1000000 + block) AS title FROM h WHERE heading_level > 0 GROUP BY doc_id",
    "vocabulary": "SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}{3,}')) AS word FROM documents",
    "dehyphenate": f"""
WITH d AS (SELECT doc_id, list_filter({_HYPHENATED}, lambda x: x <> '') AS l, list_distinct(regexp_extract_all(lower(text), '\\p{{L}}{{3,}}')) AS words FROM documents)
SELECT doc_id, coalesce(list_reduce(l, lambda acc, x: CASE
  WHEN acc[-1:] = chr(173) THEN left(acc, -1) || x
  WHEN regexp_matches(acc, '[-‐]\\z') AND regexp_matches(x, '\\A\\p{{Ll}}') THEN
    CASE WHEN list_contains(words, lower(regexp_extract(acc, '(\\p{{L}}*)[-‐]\\z', 1) || regexp_extract(x, '\\A(\\p{{L}}*)', 1))) THEN left(acc, -1) || x ELSE acc || x END
  ELSE acc || ' ' || x END), '') AS paragraph FROM d""",
    "list_islands": f"""
WITH {_MARKED},
p AS (SELECT *, regexp_extract(text, '\\A\\s*[•◦▪●‣∙·○♦]\\s*(\\S.*)\\z', 1) AS bullet, regexp_extract(text, '\\A\\s*-\\s+(\\S.*)\\z', 1) AS dash, regexp_extract(text, '\\A\\s*([0-9]{{1,3}})[.)]\\s+(\\S.*)\\z', 2) AS numbered,
  TRY_CAST(regexp_extract(text, '\\A\\s*([0-9]{{1,3}})[.)]\\s+(\\S.*)\\z', 1) AS INTEGER) AS num FROM marked),
q AS (SELECT *, dash <> '' AND bullet = '' AS is_dash, bullet <> '' OR numbered <> '' AS sure, regexp_matches(text, '[.:;!?]\\z') AS ended FROM p),
r AS (SELECT *, sum(CASE WHEN is_dash THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ix) AS run FROM q),
s AS (SELECT *, first(CASE WHEN is_dash THEN true ELSE sure END) OVER (PARTITION BY doc_id, run ORDER BY ix) AS head,
  coalesce(bool_or(ended) OVER (PARTITION BY doc_id, run ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past FROM r),
t AS (SELECT *, CASE WHEN is_dash THEN head OR past ELSE sure END AS is_item FROM s),
u AS (SELECT doc_id, ix, CASE WHEN numbered <> '' AND NOT is_dash AND bullet = '' THEN 'ol' ELSE 'ul' END AS kind, num, rtrim(CASE WHEN bullet <> '' THEN bullet WHEN is_dash THEN dash ELSE numbered END) AS item FROM t WHERE is_item),
v AS (SELECT *, CASE WHEN kind = 'ol' THEN num END AS number FROM u),
w AS (SELECT *, coalesce(last_value(number IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior, lag(kind) OVER (PARTITION BY doc_id ORDER BY ix) AS before FROM v)
SELECT doc_id, ix, kind, number, item, kind || CAST(sum(CASE WHEN kind IS DISTINCT FROM before OR (kind = 'ol' AND number <= prior) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ix) AS VARCHAR) AS list_key FROM w""",
    "block_separators": """
WITH c AS (SELECT conv_id AS doc_id, turn, role, max(text) AS text FROM conversations GROUP BY ALL),
b AS (SELECT doc_id, turn, role, trim(text) AS text, turn % 4 <> 0 AS item, turn // 2 AS key FROM c WHERE turn % 5 <> 4 AND trim(text) <> ''),
w AS (SELECT *, row_number() OVER o AS rn, item AND lag(item) OVER o AS both_, lag(key) OVER o AS before FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY turn, role)),
s AS (SELECT *, CASE WHEN rn = 1 THEN '' WHEN both_ THEN CASE WHEN key = before THEN chr(10) ELSE chr(10) || chr(10) || '<!-- -->' || chr(10) || chr(10) END ELSE chr(10) || chr(10) END || text AS part FROM w)
SELECT doc_id, string_agg(part, '' ORDER BY turn, role) || chr(10) AS markdown FROM s GROUP BY doc_id""",
    "merged_segments": f"""
WITH {_LINES}, s AS (SELECT doc_id, ix, line AS text, ix % 4 < 2 AS bold, length(line) % 3 = 0 AS italic FROM lines),
w AS (SELECT *, CASE WHEN lag(ix) OVER o IS NULL OR bold <> lag(bold) OVER o OR italic <> lag(italic) OVER o THEN 1 ELSE 0 END AS new FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY ix)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ix) AS island FROM w)
SELECT doc_id, CAST(island AS BIGINT) AS island, bold, italic, string_agg(text, '' ORDER BY ix) AS text FROM g GROUP BY doc_id, island, bold, italic""",
    "ocr_page_rollup": f"""
WITH {_LINES}, p AS (SELECT doc_id, ix AS page, CASE WHEN ix % 3 <> 1 THEN ' ' || line END AS e, 'ocr ' || line AS o, 60 + length(line) % 40 AS c FROM lines),
q AS (SELECT *, length(regexp_replace(coalesce(e, ''), '\\s', '', 'g')) >= 16 AS emb FROM p),
r AS (SELECT doc_id, page, emb, CASE WHEN emb THEN trim(e) ELSE o END AS text, c FROM q)
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text, count(*) AS pages, round(CAST(CAST(coalesce(avg(CASE WHEN NOT emb THEN c END), -1) AS FLOAT) AS DOUBLE), 3) AS mean_confidence,
  CASE WHEN bool_or(emb) AND bool_or(NOT emb) THEN 'mixed' WHEN bool_or(NOT emb) THEN 'pdf_ocr' ELSE 'pdf_text' END AS source_kind FROM r GROUP BY doc_id""",
    "ocr_large_images": "SELECT p_partkey, p_size * 9 AS width, CAST(p_partkey % 400 AS INTEGER) AS height FROM part WHERE p_size * 9 * (p_partkey % 400) >= 40000",
}
