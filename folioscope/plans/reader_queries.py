"""Queries of the Word, HTML and PDF readers: documents are written from ``conversations``, read back and compared with SQL over the same turns."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions.options import ConversionOptions
from ..operators.pdf import pdf_markdown
from ..sources.registry import convert_binary, docx_images as images_of
from .common import table

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"


def _run(text: str, props: str = "") -> str:
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def _paragraph(runs: str, props: str = "") -> str:
    return f"<w:p><w:pPr>{props}</w:pPr>{runs}</w:p>"


def _turn(turn: int, text: str) -> str:
    """A heading, a paragraph that starts in bold, a bullet or a numbered item, by the number of the turn."""
    if turn % 4 == 0:
        return _paragraph(_run(text), f'<w:pStyle w:val="H{turn % 3 + 1}"/>')
    if turn % 4 == 1:
        first, _, rest = text.partition(" ")
        return _paragraph(_run(first, "<w:b/>") + (_run(" " + rest) if rest else ""))
    return _paragraph(_run(text), f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{turn % 4 - 1}"/></w:numPr>')


def _package(body: str, pictures: list[bytes]) -> bytes:
    rels = "".join(f'<Relationship Id="{k}" Type="{_R}/{k}" Target="{k}.xml"/>' for k in ("styles", "numbering"))
    rels += "".join(f'<Relationship Id="p{k}" Type="{_R}/image" Target="media/{k}.png"/>' for k in range(len(pictures)))
    parts = {
        "[Content_Types].xml": '<Types><Default Extension="png" ContentType="image/png"/></Types>',
        "_rels/.rels": f'<Relationships><Relationship Id="d" Type="{_R}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f"<Relationships>{rels}</Relationships>",
        "word/document.xml": f'<w:document xmlns:w="{_W}" xmlns:r="{_R}" xmlns:a="{_A}" xmlns:wp="{_WP}"><w:body>{body}</w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{_W}">' + "".join(
            f'<w:style w:styleId="H{k}"><w:name w:val="heading {k}"/></w:style>' for k in (1, 2, 3)
        ) + "</w:styles>",
        "word/numbering.xml": f'<w:numbering xmlns:w="{_W}">' + "".join(
            f'<w:abstractNum w:abstractNumId="{k}"><w:lvl w:ilvl="0"><w:numFmt w:val="{f}"/></w:lvl></w:abstractNum>' for k,
            f in ((1, "bullet"), (2, "decimal"))
        ) + "".join(f'<w:num w:numId="{k}"><w:abstractNumId w:val="{k}"/></w:num>' for k in (1, 2)) + "</w:numbering>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
        for k, data in enumerate(pictures):
            z.writestr(f"word/media/{k}.png", data)
    return out.getvalue()


def _documents(spark, sf_dir, pictures: bool):
    """doc_id, path, content: a Word document for each conversation, of its turns' words or of pictures."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    words = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    turns = c.select(
        "conv_id", F.struct(F.col("turn").cast("int").alias("turn"), words.alias("text")).alias("t")
    ).filter("t.text <> ''")
    turns = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list("t")).alias("turns"))

    @F.pandas_udf("binary")
    def write(all_turns: pd.Series) -> pd.Series:
        out = []
        for turns in all_turns:
            if pictures:
                shown = [t for t in turns if t["turn"] % 3 == 1]
                body = "".join(
                    _paragraph(
                        f'<w:r><w:drawing><wp:inline><wp:docPr descr="turn"/><a:blip r:embed="p{k}"/></wp:inline></w:drawing></w:r>'
                    ) for k in range(len(shown))
                )
                out.append(_package(body, [t["text"].encode() for t in shown]))
            else:
                out.append(_package("".join(_turn(t["turn"], t["text"]) for t in turns), []))
        return pd.Series(out)

    return turns.select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"),
        write("turns").alias("content")
    )


def docx_to_markdown(spark, sf_dir):
    return convert_binary(_documents(spark, sf_dir, False)).select("doc_id", "markdown", "title")


def docx_images(spark, sf_dir):
    return images_of(_documents(spark, sf_dir, True), key="doc_id").select(
        "doc_id", "image_ix", "name", F.sha2("image", 256).alias("image_sha256")
    )


def html_documents(spark, sf_dir):
    """HTML bytes by file name: headings, paragraphs, lists, quotes, tables and hidden parts, by the number of the turn."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    t, first = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), F.split("t", " ")[0]
    tag = lambda name, inner: F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name.split()[0]}>"))
    kind = F.col("turn") % 6
    level = (F.col("turn") % 5 + 1).cast("string")
    part = (
        F.when(kind == 0, F.concat(F.lit("<h"), level, F.lit(">"), F.col("t"), F.lit("</h"), level, F.lit(">")))
        .when(
            kind == 1,
            F.concat(F.lit("<p><b>"), first, F.lit("</b>&nbsp;<em>x</em><br>\n "), F.col("t"), F.lit("<script>no()</script>"))
        )
        .when(
            kind == 2, tag("ul", F.concat(tag("li", F.col("t")), F.lit("<li hidden>no</li><li>more")))
        ).when(kind == 3, tag("ol", F.concat(tag("li", F.col("t")), tag("li", first))))
        .when(kind == 4, tag("blockquote", tag("p", F.col("t"))))
        .otherwise(
            tag(
                'table class="x"',
                F.concat(
                    tag("tr", F.concat(tag("th", first), F.lit("<th>b"))),
                    tag("tr", F.concat(F.lit("<td>"), F.col("t"), F.lit("<td> c | d "))),
                    F.lit("<tr style='display: none'><td>no<td>no</tr>")
                )
            )
        )
    )
    rows = c.select("conv_id", F.col("turn").cast("int").alias("turn"), t.alias("t")).filter("t <> ''").select(
        F.col("conv_id").alias("doc_id"), "turn", part.alias("part"), "t"
    )
    docs = rows.groupBy("doc_id").agg(
        F.min_by("t", "turn").alias("t"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n").alias("body")
    )
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><title> "), F.col("t"),
        F.lit("\n</title><style>p{}</style></head><body><!-- no -->"), F.col("body"), F.lit("</body></html>")
    )
    files = docs.select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".HTML")).alias("path"),
        F.encode(page, "UTF-8").alias("content")
    )
    return convert_binary(files).select("doc_id", "markdown", "title")


#: A last block that makes body letters the most frequent, and holds the word that is cut elsewhere.
_BODY = "alpha" + " body" * 150


def pdf_documents(spark, sf_dir):
    """Letters of pages of four turns: a large first word, a cut word, a bullet and a numbered line; page markers are on."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    t = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    c = c.select(
        F.col("conv_id").cast("long").alias("doc_id"), F.col("turn").cast("int").alias("turn"), t.alias("t")
    ).filter("t <> ''")
    kind = F.col("turn") % 4
    lines = (
        F.when(kind == 0, F.array(F.split("t", " ")[0])).when(
            kind == 1, F.array(F.lit("zeta al-"), F.concat(F.lit("pha "), F.col("t")))
        )
        .when(kind == 2, F.array(F.concat(F.lit("• "), F.col("t")))).otherwise(
            F.array(F.concat(F.col("turn").cast("string"), F.lit(") "), F.col("t")))
        )
    )
    blocks = c.select(
        "doc_id", (F.floor(F.col("turn") / 4) + 1).cast("int").alias("page"), F.col("turn").alias("block"),
        F.when(kind == 0, 20.0).otherwise(10.0).alias("point_size"), lines.alias("lines")
    )
    last = c.select("doc_id").distinct().select(
        "doc_id", F.lit(1_000_000).alias("page"), F.lit(0).alias("block"), F.lit(10.0).alias("point_size"),
        F.array(F.lit(_BODY)).alias("lines")
    )
    words = blocks.unionByName(last).select("doc_id", "page", "block", "point_size", F.posexplode("lines").alias("line", "x")).select(
        "doc_id", "page", "block", "point_size", "line", F.posexplode(F.split("x", " ")).alias("word", "x")
    )
    letters = words.select(
        "doc_id", "page", "block", "point_size", "line", "word", F.lit(False).alias("is_bold"),
        F.posexplode(F.split("x", "")).alias("letter", "text")
    )
    return pdf_markdown(letters, options=ConversionOptions(include_page_markers=True)).select(
        "doc_id", "markdown", "title", F.size("warnings").alias("warnings")
    )


_TURNS = """
c AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS turn, trim(regexp_replace(max(text), '[^A-Za-z]+', ' ', 'g')) AS t FROM conversations GROUP BY conv_id, turn),
b AS (SELECT * FROM c WHERE t <> '')"""

QUERIES = {f.__name__: f for f in (docx_to_markdown, docx_images, html_documents, pdf_documents)}

SQL = {
    "docx_to_markdown": f"""
WITH {_TURNS},
m AS (SELECT *, turn % 4 >= 2 AS item, CASE turn % 4 WHEN 0 THEN repeat('#', turn % 3 + 1) || ' ' || t
  WHEN 1 THEN '**' || split_part(t, ' ', 1) || '**' || substring(t, length(split_part(t, ' ', 1)) + 1) WHEN 2 THEN '- ' || t ELSE '1. ' || t END AS block FROM b),
w AS (SELECT *, lag(item) OVER o AS item_before, lag(turn % 4) OVER o AS kind_before, row_number() OVER o AS rn FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY turn)),
s AS (SELECT *, CASE WHEN rn = 1 THEN '' WHEN item AND item_before THEN CASE WHEN kind_before = turn % 4 THEN chr(10) ELSE chr(10) || chr(10) || '<!-- -->' || chr(10) || chr(10) END ELSE chr(10) || chr(10) END || block AS part FROM w)
SELECT doc_id, string_agg(part, '' ORDER BY turn) || chr(10) AS markdown, arg_min(t, turn) FILTER (WHERE turn % 4 = 0) AS title FROM s GROUP BY doc_id""",
    "html_documents": f"""
WITH {_TURNS},
f AS (SELECT *, split_part(t, ' ', 1) AS first FROM b),
m AS (SELECT *, CASE turn % 6 WHEN 0 THEN repeat('#', turn % 5 + 1) || ' ' || t WHEN 1 THEN '**' || first || '** *x*' || chr(10) || t WHEN 2 THEN '- ' || t || chr(10) || '- more'
  WHEN 3 THEN '1. ' || t || chr(10) || '2. ' || first WHEN 4 THEN '> ' || t || chr(10) || '>' ELSE '| ' || first || ' | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || t || ' | c \\| d |' END AS block FROM f),
w AS (SELECT *, lag(turn % 6) OVER o AS before, row_number() OVER o AS rn FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY turn)),
s AS (SELECT *, CASE WHEN rn = 1 THEN '' WHEN turn % 6 IN (2, 3) AND before IN (2, 3) THEN chr(10) || chr(10) || '<!-- -->' || chr(10) || chr(10) ELSE chr(10) || chr(10) END || block AS part FROM w)
SELECT doc_id, string_agg(part, '' ORDER BY turn) AS markdown, arg_min(t, turn) AS title FROM s GROUP BY doc_id""",
    "pdf_documents": f"""
WITH {_TURNS},
m AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, turn // 4 + 1 AS page, turn AS block, turn % 4 AS kind, CASE turn % 4 WHEN 0 THEN '# ' || split_part(t, ' ', 1) WHEN 1 THEN 'zeta alpha ' || t WHEN 2 THEN '- ' || t ELSE turn || '. ' || t END AS text, t FROM b),
every AS (
  SELECT doc_id, page, block, kind, text FROM m UNION ALL SELECT DISTINCT doc_id, 1000000, 0, 1, '{_BODY}' FROM m
  UNION ALL SELECT DISTINCT doc_id, page, -1, 1, '<!-- Página ' || page || ' -->' FROM m UNION ALL SELECT DISTINCT doc_id, 1000000, -1, 1, '<!-- Página 1000000 -->' FROM m),
w AS (SELECT *, lag(kind) OVER o AS before, row_number() OVER o AS rn FROM every WINDOW o AS (PARTITION BY doc_id ORDER BY page, block)),
s AS (SELECT *, CASE WHEN rn = 1 THEN '' WHEN kind >= 2 AND before >= 2 THEN chr(10) || chr(10) || '<!-- -->' || chr(10) || chr(10) ELSE chr(10) || chr(10) END || text AS part FROM w),
h AS (SELECT doc_id, arg_min(split_part(t, ' ', 1), block) AS title FROM m WHERE kind = 0 GROUP BY doc_id)
SELECT s.doc_id, string_agg(part, '' ORDER BY page, block) || chr(10) AS markdown, any_value(h.title) AS title, CAST(0 AS INTEGER) AS warnings FROM s LEFT JOIN h ON s.doc_id = h.doc_id GROUP BY s.doc_id""",
    "docx_images": f"""
WITH {_TURNS},
p AS (SELECT doc_id, t, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS INTEGER) AS image_ix FROM b WHERE turn % 3 = 1)
SELECT doc_id, image_ix, 'imagen-' || lpad(CAST(image_ix AS VARCHAR), 3, '0') || '.png' AS name, sha256(t) AS image_sha256 FROM p""",
}
