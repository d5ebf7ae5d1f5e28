"""Queries of the text functions over ``documents``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as T
from ..functions.options import CleanerOptions, NormalizeOptions
from .common import noisy, noisy_sql, table

_D = "documents"
_WS = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LF = "chr(10)"


def _noisy_docs(spark, sf_dir):
    return table(spark, sf_dir, _D).select("doc_id", "lang", noisy(F.col("text"), F.col("doc_id")).alias("t"))


def _tokens_sql(text: str, factor: str = "1.0") -> str:
    return f"CAST(ceil(greatest(length({text}) / CAST(4.0 AS DOUBLE), len(regexp_extract_all({text}, '[^{_WS}]+')) * CAST(0.75 AS DOUBLE)) * CAST({factor} AS DOUBLE)) AS INTEGER)"


def _normal_sql(text: str, most: int | None = 2, tabs: bool = True) -> str:
    x = f"regexp_replace({text}, '\\r\\n?', {_LF}, 'g')"
    x = f"regexp_replace({x}, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    x = x if tabs else f"replace({x}, chr(9), '')"
    x = f"regexp_replace({x}, '[\\x{{A0}}\\x{{1680}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}\\t ]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' ?\\n ?', {_LF}, 'g')"
    x = f"regexp_replace({x}, '\\n{{{most + 1},}}', repeat({_LF}, {most}), 'g')" if most else x
    return f"regexp_replace({x}, '\\A[ \\n]+|[ \\n]+\\z', '', 'g')"


def _stage(
    name: str, steps: list[tuple[str, str]], select: str,
    table: str = f"SELECT doc_id, lang, {noisy_sql()} AS t FROM documents"
) -> str:
    """A query as a row of named steps, each adding a column to the one before."""
    out, last = f"WITH s0 AS ({table})", "s0"
    for k, (column, expr) in enumerate(steps, 1):
        out, last = f"{out}, s{k} AS (SELECT *, {expr} AS {column} FROM {last})", f"s{k}"
    return f"{out} SELECT {select} FROM {last}"


def tokens_estimate(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, _D).select(
        "doc_id", T.count_words(t).alias("words"), T.estimate_tokens(t).alias("tokens"),
        T.estimate_tokens(t, "cl100k").alias("tokens_cl100k")
    )


def tokens_from_chars(spark, sf_dir):
    n = F.col("n_chars") - 100
    return table(spark, sf_dir, _D).select(
        "doc_id", T.estimate_tokens_from_length(n).alias("tokens"),
        T.estimate_tokens_from_length(n, "cl100k").alias("tokens_cl100k")
    )


def normalize_text(spark, sf_dir):
    return _noisy_docs(spark, sf_dir).select("doc_id", T.normalize_text(F.col("t")).alias("normalized"))


def normalize_metrics(spark, sf_dir):
    m = T.normalize_with_metrics(F.col("t"))
    return _noisy_docs(spark, sf_dir).select("doc_id", m.alias("m")).select(
        "doc_id", "m.original_chars", "m.result_chars", "m.saved_chars",
        F.round("m.reduction_pct", 6).alias("reduction_pct")
    )


def tokens_saved_by_lang(spark, sf_dir):
    """Flagship: what normalisation saves, by language."""
    rows = _noisy_docs(spark, sf_dir).select("lang", "t", T.normalize_text(F.col("t")).alias("n"))
    one = rows.select(
        "lang", T.utf16_length(F.col("t")).alias("a"), T.utf16_length(F.col("n")).alias("b"),
        T.estimate_tokens(F.col("t")).alias("ta"), T.estimate_tokens(F.col("n")).alias("tb")
    )
    return one.groupBy("lang").agg(
        F.count("*").alias("documents"), F.sum("a").alias("chars_before"), F.sum("b").alias("chars_after"),
        F.sum("ta").alias("tokens_before"), F.sum("tb").alias("tokens_after"),
        F.round(F.sum(F.col("a") - F.col("b")) * F.lit(100.0) / F.sum("a"), 6).alias("reduction_pct"),
    )


def clean_pagination(spark, sf_dir):
    return _noisy_docs(spark, sf_dir).select("doc_id", T.normalize_pagination(T.line_feeds(F.col("t"))).alias("cleaned"))


def clean_artifacts(spark, sf_dir):
    return _noisy_docs(spark, sf_dir).select("doc_id", T.remove_artifacts(F.col("t")).alias("cleaned"))


def clean_blank_lines(spark, sf_dir):
    return _noisy_docs(spark, sf_dir).select("doc_id", T.compact_blank_lines(T.line_feeds(F.col("t"))).alias("cleaned"))


def clean_full(spark, sf_dir):
    return _noisy_docs(spark, sf_dir).select("doc_id", T.clean_markdown(F.col("t")).alias("cleaned"))


def _page_line_sql() -> str:
    date = T.PRINT_DATE.replace(r"\p{Nd}", "[0-9]").replace("'", "''")
    line = T.PAGE_LINE.replace(r"\p{Nd}", "[0-9]")
    bare = f"regexp_replace(regexp_replace(x, '(?i){date}', ' ', 'g'), '(?i)car[áa]tula', ' ', 'g')"
    return f"CASE WHEN regexp_matches(x, '[0-9]') THEN regexp_extract({bare}, '(?i){line}', 1) ELSE '' END"


def _paginate_sql(text: str) -> str:
    """Over a column of lines: the line, or its marker."""
    first = f"list_position(list_transform({text}, lambda x: regexp_matches(x, '[^{_WS}]')), true)"
    nl = "chr(10)"
    lead = f"'**[Página ' || pg || ']**' || {nl} || {nl} || '---' || {nl}"
    full = f"{nl} || '---' || {nl} || {nl} || {lead}"
    pairs = f"list_transform({text}, lambda x, i: struct_pack(x := x, i := i, pg := {_page_line_sql()}))"
    pick = f"CASE WHEN r.pg <> '' THEN CASE WHEN r.i = {first} THEN {lead.replace('pg', 'r.pg')} ELSE {full.replace('pg', 'r.pg')} END ELSE r.x END"
    return f"array_to_string(list_transform({pairs}, lambda r: {pick}), {nl})"


_LINES = f"string_split(regexp_replace(t, '\\r\\n?', {_LF}, 'g'), {_LF})"
_ARTIFACTS = "regexp_replace(regexp_replace(@x, '<!--[" + _WS + "]*-->', '', 'g'), '_{6,}', '', 'g')"
_BLANKS = "regexp_replace(regexp_replace(@x, '(?m)^[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"


def escape_inline(spark, sf_dir):
    return _noisy_docs(spark, sf_dir).select("doc_id", M.escape_inline(F.col("t")).alias("escaped"))


def escape_line_start(spark, sf_dir):
    return _noisy_docs(spark, sf_dir).select("doc_id", M.escape_line_start(T.line_feeds(F.col("t"))).alias("escaped"))


def table_cell(spark, sf_dir):
    return _noisy_docs(spark, sf_dir).select("doc_id", M.table_cell(F.concat(F.lit(" a|b "), "t")).alias("cell"))


def collapse_ws(spark, sf_dir):
    return _noisy_docs(spark, sf_dir).select("doc_id", M.collapse_whitespace(F.col("t")).alias("collapsed"))


def html_text_normalize(spark, sf_dir):
    return _noisy_docs(spark, sf_dir).select("doc_id", M.html_text(F.col("t")).alias("text_node"))


_STYLES = [
    "display: none", "opacity:0", "opacity: 0.5", "max-height:0px;color:red", "font-size:1px !important", "color:red",
    "VISIBILITY: Hidden", "font-size:10px", "opacity:0%", ""
]


def html_style_hidden(spark, sf_dir):
    styles = F.array(*map(F.lit, _STYLES))
    rows = table(spark, sf_dir, _D).select(
        "doc_id", F.element_at(styles, (F.col("doc_id") % len(_STYLES) + 1).cast("int")).alias("style")
    )
    return rows.select("doc_id", "style", M.hidden_style(F.col("style")).alias("hidden"))


_NAMES = ["a/b.PDF", " Report.Docx ", "html", ".HTM", "", "x.jpe", "scan.tiff", "noext", "c.tar.gz", "page.JPEG"]
_HEADS = ["25504446", "89504E47", "FFD8FFE0", "49492A00", "4D4D002A", "00000000", "2550", "FFD8", "49494949", "3C68746D"]


def format_detect(spark, sf_dir):
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), ((F.col("doc_id") / k).cast("long") % 10 + 1).cast("int"))
    rows = table(spark, sf_dir, _D).select("doc_id", pick(_NAMES, 1).alias("name"), pick(_HEADS, 10).alias("head"))
    return rows.select(
        "doc_id", "name", "head", M.normalize_extension(F.col("name")).alias("extension"),
        M.detect_format(F.unhex("head"), F.trim("name")).alias("format")
    )


def confidence_percent(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(M.to_percent(F.col("value") / 50), 6).alias("percent"))


_MIMES = [
    "image/png", "IMAGE/JPEG", "image/gif", "image/x-emf", "image/wmf", "text/plain", "image/svg+xml", "image/bmp",
    "image/tiff", "image/jpg"
]


def image_extensions(spark, sf_dir):
    mime = F.element_at(F.array(*map(F.lit, _MIMES)), (F.col("doc_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, _D).select("doc_id", mime.alias("mime")).select(
        "doc_id", "mime", M.image_extension(F.col("mime")).alias("extension")
    )


def _case(column: str, table: dict[str, str], other: str) -> str:
    return f"CASE {' '.join(f'WHEN {column} = {k!r} THEN {v!r}' for k, v in table.items())} ELSE {other!r} END"


def _pick(xs: list[str], key: str) -> str:
    return f"(list_value({', '.join(map(repr, xs))}))[CAST({key} % 10 AS INTEGER) + 1]"


_trim = lambda x: f"regexp_replace({x}, '\\A[{_WS}]+|[{_WS}]+\\z', '', 'g')"

def normalize_options(spark, sf_dir):
    options = {
        "one_feed": NormalizeOptions(max_newlines=1), "all_feeds": NormalizeOptions(collapse_newlines=False),
        "no_tabs": NormalizeOptions(spaces_per_tab=0)
    }
    return _noisy_docs(spark, sf_dir).select("doc_id", *[T.normalize_text(F.col("t"), o).alias(n) for n, o in options.items()])


def clean_options(spark, sf_dir):
    options = {
        "no_pagination": CleanerOptions(normalize_pagination=False),
        "with_artifacts": CleanerOptions(remove_artifacts=False),
        "with_blanks": CleanerOptions(compact_blank_lines=False)
    }
    return _noisy_docs(spark, sf_dir).select("doc_id", *[T.clean_markdown(F.col("t"), o).alias(n) for n, o in options.items()])


def html_blank_lines(spark, sf_dir):
    spaced = F.concat(
        F.lit("\n \n"),
        F.replace(F.replace("text", F.lit(". "), F.lit(". \t\r\n\n \n\n\n")), F.lit(", "), F.lit(",  \n")),
        F.lit(" \n\n")
    )
    return table(spark, sf_dir, "documents").select("doc_id", M.compact_html_blanks(spaced).alias("out"))


_STYLE_NAMES = [
    "Heading 1", "heading2", "Título 3", "TITULO  4", "titre 5", "Überschrift 6", "Title", " subtitle ", "Heading 10",
    "Normal", "ttulo7", "berschrift 8", "heading 0", "my heading 1"
]


def heading_style_names(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _STYLE_NAMES)), (F.col("s_suppkey") % len(_STYLE_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("style")).withColumn(
        "level", M.heading_level_of_style(F.col("style"))
    )


QUERIES = {f.__name__: f for f in (
    tokens_estimate, tokens_from_chars, normalize_text, normalize_metrics, tokens_saved_by_lang, clean_pagination,
    clean_artifacts, clean_blank_lines, clean_full,
    escape_inline, escape_line_start, table_cell, collapse_ws, html_text_normalize, html_style_hidden, format_detect,
    confidence_percent, image_extensions, html_blank_lines, heading_style_names, normalize_options, clean_options,
)}

SQL = {
    "html_blank_lines": """
WITH a AS (SELECT doc_id, chr(10) || ' ' || chr(10) || replace(replace(text, '. ', '. ' || chr(9) || chr(13) || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || chr(10)), ', ', ',  ' || chr(10)) || ' ' || chr(10) || chr(10) AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '[ \\t]+\\n', chr(10), 'g'), '[ \\t]+$', '') AS t FROM a)
SELECT doc_id, trim(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS out FROM b""",
    "heading_style_names": f"""
WITH s AS (SELECT s_suppkey, (list_value({', '.join(map(repr, _STYLE_NAMES))}))[CAST(s_suppkey % {len(_STYLE_NAMES)} AS INTEGER) + 1] AS style FROM supplier)
SELECT s_suppkey, style, CASE lower(trim(style)) WHEN 'title' THEN 1 WHEN 'subtitle' THEN 2
  ELSE TRY_CAST(regexp_extract(style, '(?i)^(?:heading|t[ií]?tulo|ttulo|titre|berschrift|überschrift)\\s*([1-9])$', 1) AS INTEGER) END AS level FROM s""",
    "tokens_estimate": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{_WS}]+')) AS INTEGER) AS words, {_tokens_sql('text')} AS tokens, {_tokens_sql('text', '1.1')} AS tokens_cl100k FROM documents",
    "tokens_from_chars": "SELECT doc_id, " + ", ".join(
        f"CAST(CASE WHEN n_chars - 100 <= 0 THEN 0 ELSE ceil((n_chars - 100) / CAST(4.0 AS DOUBLE) * CAST({f} AS DOUBLE)) END AS INTEGER) AS {n}" for f,
        n in (("1.0", "tokens"), ("1.1", "tokens_cl100k"))
    ) + " FROM documents",
    "normalize_text": _stage("n", [("normalized", _normal_sql("t"))], "doc_id, normalized"),
    "normalize_metrics": _stage(
        "n", [("n", _normal_sql("t")), ("a", "length(t)"), ("b", "length(n)")],
        "doc_id, CAST(a AS INTEGER) AS original_chars, CAST(b AS INTEGER) AS result_chars, CAST(a - b AS INTEGER) AS saved_chars, round((a - b) * CAST(100.0 AS DOUBLE) / a, 6) AS reduction_pct"
    ),
    "tokens_saved_by_lang": _stage("n", [("n", _normal_sql("t")), ("a", "length(t)"), ("b", "length(n)"), ("ta", _tokens_sql("t")), ("tb", _tokens_sql("n"))],
        "lang, count(*) AS documents, CAST(sum(a) AS BIGINT) AS chars_before, CAST(sum(b) AS BIGINT) AS chars_after, CAST(sum(ta) AS BIGINT) AS tokens_before, CAST(sum(tb) AS BIGINT) AS tokens_after, round(CAST(sum(a - b) AS BIGINT) * CAST(100.0 AS DOUBLE) / CAST(sum(a) AS BIGINT), 6) AS reduction_pct") + " GROUP BY lang",
    "clean_pagination": _stage("c", [("l", _LINES), ("cleaned", _paginate_sql("l"))], "doc_id, cleaned"),
    "clean_artifacts": _stage("c", [("cleaned", _ARTIFACTS.replace("@x", "t"))], "doc_id, cleaned"),
    "clean_blank_lines": _stage(
        "c", [("l", f"regexp_replace(t, '\\r\\n?', {_LF}, 'g')"), ("cleaned", _BLANKS.replace("@x", "l"))],
        "doc_id, cleaned"
    ),
    "normalize_options": _stage(
        "n",
        [("one_feed", _normal_sql("t", 1)), ("all_feeds", _normal_sql("t", None)), ("no_tabs", _normal_sql("t", tabs=False))],
        "doc_id, one_feed, all_feeds, no_tabs"
    ),
    "clean_options": _stage("c", [
        ("u", f"regexp_replace(t, '\\r\\n?', {_LF}, 'g')"), ("ua", _ARTIFACTS.replace("@x", "u")),
        ("ub", _BLANKS.replace("@x", "ua")), ("l", _LINES), ("p", _paginate_sql("l")),
        ("pb", _BLANKS.replace("@x", "p")), ("pa", _ARTIFACTS.replace("@x", "p")),
    ], f"doc_id, trim(ub, {_LF}) AS no_pagination, trim(pb, {_LF}) AS with_artifacts, trim(pa, {_LF}) AS with_blanks"),
    "clean_full": _stage(
        "c",
        [("l", _LINES), ("p", _paginate_sql("l")), ("a", _ARTIFACTS.replace("@x", "p")), ("b", _BLANKS.replace("@x", "a"))],
        f"doc_id, trim(b, {_LF}) AS cleaned"
    ),
    "escape_inline": _stage("e", [("escaped", r"regexp_replace(t, '([\\`*_\[\]<>~])', '\\\1', 'g')")], "doc_id, escaped"),
    "escape_line_start": _stage(
        "e", [("l", _LINES)],
        "doc_id, array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '\\A[" + _WS + "]*[0-9]{1,9}[.)]([" + _WS + "]|\\z)') THEN regexp_replace(x, '\\A([" + _WS + r"]*[0-9]{1,9})([.)])', '\1\\\2') WHEN regexp_matches(x, '\A[ \t]*(?:>|[#+*\-](?:[ \t]|\z)|-[- \t]*\z|=[= \t]*\z)') THEN regexp_replace(x, '\A([ \t]*)', '\1\\') ELSE x END), chr(10)) AS escaped"
    ),
    "table_cell": _stage(
        "c", [("c", "' a|b ' || t")],
        "doc_id, " + _trim("replace(regexp_replace(c, '\\r\\n|\\r|\\n', '<br>', 'g'), '|', '\\|')") + " AS cell"
    ),
    "collapse_ws": _stage("c", [("c", f"regexp_replace(t, '[{_WS}]+', ' ', 'g')")], f"doc_id, {_trim('c')} AS collapsed"),
    "html_text_normalize": _stage(
        "h",
        [("h", "regexp_replace(t, '[\\x{34F}\\x{AD}\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}\\x{180E}]', '', 'g')")],
        f"doc_id, regexp_replace(h, '[{_WS}]+', ' ', 'g') AS text_node"
    ),
    "html_style_hidden": f"WITH s AS (SELECT doc_id, {_pick(_STYLES, 'doc_id')} AS style FROM documents), c AS (SELECT *, lower(replace(style, ' ', '')) AS z FROM s) SELECT doc_id, style, regexp_matches(z, 'display:none|visibility:hidden|mso-hide:all') OR len(list_filter(string_split(z, ';'), lambda p: regexp_matches(replace(p, '!important', ''), '\\A(?:opacity:0|max-height:0|font-size:0|font-size:1px)(?:px|%)?\\z'))) > 0 AS hidden FROM c",
    "format_detect": f"WITH s AS (SELECT doc_id, {_pick(_NAMES, 'doc_id')} AS name, {_pick(_HEADS, '(doc_id // 10)')} AS head FROM documents), e AS (SELECT *, lower(regexp_extract(trim(name), '(\\.[^./\\\\]+)\\z', 1)) AS e, lower(trim(name)) AS low FROM s) "
        "SELECT doc_id, name, head, CASE WHEN low = '' THEN '' WHEN e <> '' THEN e WHEN starts_with(low, '.') THEN low ELSE '.' || low END AS extension, "
        + "CASE " + " ".join(
            f"WHEN length(head) >= 8 AND starts_with(head, '{k}') THEN '{v}'" for k, v in M.SIGNATURES.items()
        )+ " " + " ".join(f"WHEN e = '{k}' THEN '{v}'" for k, v in M.EXTENSIONS.items()) + " ELSE 'unknown' END AS format FROM e",
    "confidence_percent": "SELECT event_id, round(CASE WHEN value / 50 <= 1 THEN value / 50 * 100 ELSE value / 50 END, 6) AS percent FROM events",
    "image_extensions": f"WITH s AS (SELECT doc_id, {_pick(_MIMES, 'doc_id')} AS mime FROM documents) SELECT doc_id, mime, {_case('lower(mime)', M.IMAGE_EXTENSIONS, '.bin')} AS extension FROM s",
}
