"""Queries of the geometry operators over boxes derived from ``lineitem`` and ``events``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from .common import table

#: A page of 900 by 600 for every seven orders; a component for each line item.
_COMPS_SQL = """
li AS (SELECT CAST(l_orderkey // 7 AS BIGINT) AS doc_id, 0 AS page, CAST((l_orderkey % 7) * 10 + l_linenumber AS INTEGER) AS comp, CAST(l_orderkey % 7 AS INTEGER) AS line,
  CAST(l_linenumber * 30 + CAST(l_quantity AS INTEGER) % 13 + CASE WHEN l_linenumber > 4 THEN 60 ELSE 0 END AS INTEGER) AS min_x, CAST((l_orderkey % 7) * 80 + l_suppkey % 5 AS INTEGER) AS min_y,
  CAST(8 + l_partkey % 17 + CASE WHEN l_partkey % 10 = 0 THEN 120 ELSE 0 END AS INTEGER) AS w, CAST(6 + l_partkey % 12 + CASE WHEN l_partkey % 10 = 0 THEN 20 ELSE 0 END AS INTEGER) AS h FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) AS q),
comps AS (SELECT doc_id, page, comp, line, min_x, min_y, min_x + w - 1 AS max_x, min_y + h - 1 AS max_y, CAST(w * h // 4 AS INTEGER) AS pixels, CAST(w * h // 4 * (comp % 3) // 4 AS INTEGER) AS colorful, w, h,
  min_x + (w - 1) / CAST(2.0 AS DOUBLE) AS cx, min_y + (h - 1) / CAST(2.0 AS DOUBLE) AS cy FROM li)
"""


def _components(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        *[F.max(c).alias(c) for c in ("l_quantity", "l_partkey", "l_suppkey")]
    )
    ln, part, order = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_orderkey")
    df = li.select(
        (order / 7).cast("long").alias("doc_id"), F.lit(0).alias("page"),
        ((order % 7) * 10 + ln).cast("int").alias("comp"), (order % 7).cast("int").alias("line"),
        (ln * 30 + F.col("l_quantity").cast("int") % 13 + F.when(ln > 4, 60).otherwise(0)).cast("int").alias("min_x"),
        ((order % 7) * 80 + F.col("l_suppkey") % 5).cast("int").alias("min_y"),
        (8 + part % 17 + F.when(part % 10 == 0, 120).otherwise(0)).cast("int").alias("w"),
        (6 + part % 12 + F.when(part % 10 == 0, 20).otherwise(0)).cast("int").alias("h"),
    )
    area = (F.col("w") * F.col("h") / 4).cast("int")
    return df.select(
        "doc_id", "page", "comp", "line", "min_x", "min_y", (F.col("min_x") + F.col("w") - 1).alias("max_x"),
        (F.col("min_y") + F.col("h") - 1).alias("max_y"), area.alias("pixels"),
        (area * (F.col("comp") % 3) / 4).cast("int").alias("colorful")
    )


def _round(*columns: str):
    return [F.round(c, 5).alias(c) for c in columns]


def otsu_threshold(spark, sf_dir):
    gray = F.abs(F.floor(F.col("value") * 3)).cast("int") % 256
    h = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 97).alias("page"), gray.alias("gray")
    ).groupBy("page", "gray").agg(F.count("*").alias("n"))
    return G.otsu(h, ["page"]).select("page", "threshold", *_round("ink_ratio"), "empty")


def glyph_filter(spark, sf_dir):
    return G.filter_glyphs(
        _components(spark, sf_dir), F.lit(900), F.lit(600)
    ).select("doc_id", "page", "comp", "w", "h", "median_h")


def split_words(spark, sf_dir):
    return G.split_words(G.with_sizes(_components(spark, sf_dir))).select(
        "doc_id", "page", "line", "comp", F.col("word").cast("long").alias("word")
    )


def word_scores(spark, sf_dir):
    # Whole lines count as words here: only then have enough glyphs.
    glyphs = G.with_sizes(_components(spark, sf_dir)).withColumn("word", F.lit(0))
    out = G.word_scores(glyphs)
    return out.select("doc_id", "page", "line", "n", *_round("height_cv", "baseline", "gap_cv", "score"), "x", "y", "w", "h")


def stroke_scores(spark, sf_dir):
    out = G.stroke_scores(_components(spark, sf_dir), F.lit(900), F.lit(600), F.lit(12))
    return out.select("doc_id", "page", "comp", "x", "y", "w", "h", *_round("score"))


def box_overlap_anti(spark, sf_dir):
    boxes = _components(spark, sf_dir).select(
        "doc_id", "page", "comp", F.col("min_x").alias("x"), F.col("min_y").alias("y"),
        (F.col("max_x") - F.col("min_x") + 1).alias("w"), (F.col("max_y") - F.col("min_y") + 1).alias("h")
    )
    return G.without_overlaps(boxes.filter("comp % 2 = 0"), boxes.filter("comp % 2 = 1"))


_WORDS_SQL = _COMPS_SQL + ", words AS (SELECT doc_id, page, comp AS word, CASE WHEN comp % 9 = 0 THEN ' ' ELSE 'w' || comp END AS text, CAST(comp * 7 % 100 - 5 AS FLOAT) AS confidence, min_x AS x, min_y AS y, w, h, CAST(comp % 3 AS DOUBLE) / 8 AS colour, line AS row, CAST(30.0 AS DOUBLE) AS gap_limit FROM comps)"


def _words(spark, sf_dir):
    c = G.with_sizes(_components(spark, sf_dir))
    return c.select(
        "doc_id", "page", F.col("comp").alias("word"),
        F.when(F.col("comp") % 9 == 0, " ").otherwise(F.concat(F.lit("w"), F.col("comp").cast("string"))).alias("text"),
        (F.col("comp") * 7 % 100 - 5).cast("float").alias("confidence"), F.col("min_x").alias("x"),
        F.col("min_y").alias("y"), "w", "h", ((F.col("comp") % 3) / 8.0).alias("colour"), F.col("line").alias("row"),
        F.lit(30.0).alias("gap_limit")
    )


def low_confidence_words(spark, sf_dir):
    return G.low_confidence_words(_words(spark, sf_dir), F.lit(600)).select("doc_id", "page", "word", "text", "confidence")


def word_regions(spark, sf_dir):
    out = G.word_regions(G.low_confidence_words(_words(spark, sf_dir), F.lit(600)))
    return out.select(
        "doc_id", "page", "row", F.col("run").cast("long").alias("run"), "words", "x", "y", "w", "h", *_round("score")
    )


def page_mean_confidence(spark, sf_dir):
    return G.mean_confidence(_words(spark, sf_dir)).select("doc_id", "page", *_round("mean_confidence"))


def page_decision(spark, sf_dir):
    words = _words(spark, sf_dir)
    strokes = G.stroke_scores(
        _components(spark, sf_dir), F.lit(900), F.lit(600), F.lit(12)
    ).select("doc_id", "page", "x", "y", "w", "h", "score")
    found = G.word_regions(G.low_confidence_words(words, F.lit(600))).select("doc_id", "page", "x", "y", "w", "h", "score")
    return G.page_regions(strokes, found, G.mean_confidence(words)).select("doc_id", "page", "x", "y", "w", "h", *_round("score"))


def document_handwriting(spark, sf_dir):
    strokes = G.stroke_scores(_components(spark, sf_dir), F.lit(900), F.lit(600), F.lit(12))
    pages = strokes.withColumn("page", F.col("comp") % 2).groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("x", "y", "w", "h"))).alias("regions"), F.max("score").alias("max_score")
    )
    return G.document_rollup(pages).select(
        "doc_id", F.col("region_count").cast("long").alias("region_count"), *_round("max_score"), "has_handwriting"
    )


def word_rows(spark, sf_dir):
    words = _words(spark, sf_dir).drop("row", "gap_limit")
    return G.word_rows(words).select("doc_id", "page", "word", "row", F.round("gap_limit", 5).alias("gap_limit"))


def line_groups(spark, sf_dir):
    return G.group_lines(G.with_sizes(_components(spark, sf_dir).drop("line"))).select("doc_id", "page", "comp", "line")


def first_regions(spark, sf_dir):
    boxes = _components(spark, sf_dir).select(
        "doc_id", "page", "comp", F.col("min_x").alias("x"), (F.col("min_y") % 80).alias("y"),
        (F.col("max_x") - F.col("min_x") + 1).alias("w"), (F.col("max_y") - F.col("min_y") + 1).alias("h")
    )
    return G.first_of_overlapping(boxes, ["comp"])


QUERIES = {
    f.__name__: f for f in (
        otsu_threshold, glyph_filter, split_words, word_scores, stroke_scores, box_overlap_anti, low_confidence_words,
        word_regions, page_mean_confidence, page_decision, document_handwriting, line_groups, word_rows, first_regions
    )
}


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


_STROKES = (
    ", st AS (SELECT *, CAST(w AS DOUBLE) / h AS aspect, CAST(pixels AS DOUBLE) / (w * h) AS density, CASE WHEN pixels > 0 THEN CAST(colorful AS DOUBLE) / pixels ELSE 0 END AS colour FROM comps "
    "WHERE w >= 16 AND h >= 5 AND w <= 900 * CAST(0.85 AS DOUBLE) AND h <= 600 * CAST(0.18 AS DOUBLE) AND h >= 12 * CAST(1.4 AS DOUBLE)), "
    "sc AS (SELECT *, 100 * " + _clamp(
        f"CAST(0.5 AS DOUBLE) * {_clamp('(aspect - 1.5) / 2.5')} + CAST(0.3 AS DOUBLE) * CASE WHEN density <= 0.12 THEN {_clamp('(density - 0.015) / 0.045')} ELSE 1 - {_clamp('(density - 0.12) / 0.3')} END + CAST(0.2 AS DOUBLE) * {_clamp('(CAST(w AS DOUBLE) / 900 - 0.018) / 0.142')}"
    )
    + " AS score FROM st WHERE aspect BETWEEN 1.5 AND 8.0 AND density BETWEEN 0.015 AND 0.42 AND colour <= 0.35), "
    "strokes AS (SELECT doc_id, page, comp, min_x AS x, min_y AS y, w, h, score FROM sc WHERE score >= 55)"
)
_LOW = ", low AS (SELECT * FROM words WHERE trim(text) <> '' AND confidence >= 0 AND confidence < 55 AND w >= 8 AND h >= 8 AND h <= 72 AND colour <= 0.15)"
_REGIONS = (
    ", g AS (SELECT *, CASE WHEN x - lag(x + w) OVER (PARTITION BY doc_id, page, row ORDER BY x, word) > gap_limit THEN 1 ELSE 0 END AS new FROM low), "
    "r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, row ORDER BY x, word) AS run FROM g), "
    "regions AS (SELECT doc_id, page, row, CAST(run AS BIGINT) AS run, count(*) AS words, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, least(greatest(100 - avg(CAST(confidence AS DOUBLE)), 0), 100) AS score FROM r GROUP BY doc_id, page, row, run)"
)
_OVERLAP = (
    "least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x) > 0 AND least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y) > 0 AND "
    "CAST(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x) AS DOUBLE) * (least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) >= least({a}.w * {a}.h, {b}.w * {b}.h) * 0.5"
)

#: Glyph after glyph of each page; lines are lists of sums and counts.
_LINE_GROUPS = f"""
WITH RECURSIVE {_COMPS_SQL},
g AS (SELECT doc_id, page, comp, cy, row_number() OVER (PARTITION BY doc_id, page ORDER BY cy, comp) AS rn, count(*) OVER (PARTITION BY doc_id, page) AS n FROM comps),
t AS (SELECT doc_id, page, greatest(CAST(4.0 AS DOUBLE), list_sort(list(CAST(h AS DOUBLE)))[count(*) // 2 + 1] * CAST(0.6 AS DOUBLE)) AS tolerance FROM comps GROUP BY doc_id, page),
r AS (
  SELECT doc_id, page, rn, comp, CAST(1 AS BIGINT) AS k, [cy] AS sums, [CAST(1 AS DOUBLE)] AS counts FROM g WHERE rn = 1
  UNION ALL
  SELECT doc_id, page, rn, comp, k,
    CASE WHEN k <= len(sums) THEN list_transform(sums, lambda s, i: CASE WHEN i = k THEN s + cy ELSE s END) ELSE list_append(sums, cy) END,
    CASE WHEN k <= len(counts) THEN list_transform(counts, lambda s, i: CASE WHEN i = k THEN s + 1 ELSE s END) ELSE list_append(counts, CAST(1 AS DOUBLE)) END
  FROM (
    SELECT *, CAST(CASE WHEN list_min(far) <= tolerance THEN list_position(far, list_min(far)) ELSE len(far) + 1 END AS BIGINT) AS k FROM (
      SELECT g.doc_id, g.page, g.rn, g.comp, g.cy, t.tolerance, r.sums, r.counts, list_transform(list_zip(r.sums, r.counts), lambda z: abs(z[1] / z[2] - g.cy)) AS far
      FROM r JOIN g ON g.doc_id = r.doc_id AND g.page = r.page AND g.rn = r.rn + 1 JOIN t ON t.doc_id = g.doc_id AND t.page = g.page) AS a) AS b)
SELECT doc_id, page, comp, CAST(k - 1 AS INTEGER) AS line FROM r"""

#: Word after word of each page; a row is known by its moving middle.
_WORD_ROWS = f"""
WITH RECURSIVE {_WORDS_SQL},
g AS (SELECT doc_id, page, word, y + h / CAST(2.0 AS DOUBLE) AS cy, row_number() OVER (PARTITION BY doc_id, page ORDER BY y + h / CAST(2.0 AS DOUBLE), x, word) AS rn FROM words),
t AS (SELECT doc_id, page, list_sort(list(CAST(h AS DOUBLE)))[count(*) // 2 + 1] AS median FROM words GROUP BY doc_id, page),
r AS (
  SELECT doc_id, page, rn, word, 0 AS row, cy AS middle FROM g WHERE rn = 1
  UNION ALL
  SELECT doc_id, page, rn, word, CASE WHEN near THEN row ELSE row + 1 END, CASE WHEN near THEN (middle + cy) / 2 ELSE cy END FROM (
    SELECT g.*, r.row, r.middle, abs(g.cy - r.middle) <= greatest(CAST(6.0 AS DOUBLE), t.median * CAST(0.7 AS DOUBLE)) AS near
    FROM r JOIN g ON g.doc_id = r.doc_id AND g.page = r.page AND g.rn = r.rn + 1 JOIN t ON t.doc_id = g.doc_id AND t.page = g.page) AS q)
SELECT r.doc_id, r.page, r.word, CAST(r.row AS INTEGER) AS row, round(greatest(t.median * 3, 30), 5) AS gap_limit FROM r JOIN t ON t.doc_id = r.doc_id AND t.page = r.page"""

_FIRST_REGIONS = f"""
WITH RECURSIVE {_COMPS_SQL},
b AS (SELECT doc_id, page, comp, min_x AS x, CAST(min_y % 80 AS INTEGER) AS y, max_x - min_x + 1 AS w, max_y - min_y + 1 AS h, row_number() OVER (PARTITION BY doc_id, page ORDER BY comp) AS rn FROM comps),
r AS (
  SELECT doc_id, page, rn, comp, x, y, w, h, true AS taken, [{{'x': x, 'y': y, 'w': w, 'h': h}}] AS kept FROM b WHERE rn = 1
  UNION ALL
  SELECT doc_id, page, rn, comp, x, y, w, h, taken, CASE WHEN taken THEN list_append(kept, {{'x': x, 'y': y, 'w': w, 'h': h}}) ELSE kept END FROM (
    SELECT b.doc_id, b.page, b.rn, b.comp, b.x, b.y, b.w, b.h, r.kept, len(list_filter(r.kept, lambda a:
        least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y) AND least(a.w * a.h, b.w * b.h) > 0
        AND CAST((least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS DOUBLE) >= least(a.w * a.h, b.w * b.h) * CAST(0.65 AS DOUBLE))) = 0 AS taken
    FROM r JOIN b ON b.doc_id = r.doc_id AND b.page = r.page AND b.rn = r.rn + 1) AS q)
SELECT doc_id, page, comp, x, y, w, h FROM r WHERE taken"""

SQL = {
    "line_groups": _LINE_GROUPS,
    "first_regions": _FIRST_REGIONS,
    "word_rows": _WORD_ROWS,
    "otsu_threshold": """
WITH h AS (SELECT user_id % 97 AS page, CAST(abs(floor(value * 3)) AS INTEGER) % 256 AS gray, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT *, CAST(sum(n) OVER r AS DOUBLE) AS wb, CAST(sum(gray * n) OVER r AS DOUBLE) AS sb, CAST(sum(n) OVER p AS DOUBLE) AS w, CAST(sum(gray * n) OVER p AS DOUBLE) AS s FROM h WINDOW r AS (PARTITION BY page ORDER BY gray), p AS (PARTITION BY page)),
b AS (SELECT page, gray, wb * (w - wb) * (sb / wb - (s - sb) / (w - wb)) * (sb / wb - (s - sb) / (w - wb)) AS v FROM c WHERE wb < w),
t AS (SELECT page, gray AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY page ORDER BY v DESC, gray) = 1),
u AS (SELECT h.page, coalesce(t.threshold, 127) AS threshold, h.gray, h.n FROM h LEFT JOIN t ON h.page = t.page),
i AS (SELECT page, threshold, CAST(sum(CASE WHEN gray < threshold THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS k FROM u GROUP BY page, threshold)
SELECT page, threshold, round(k, 5) AS ink_ratio, NOT (k BETWEEN 0.002 AND 0.5) AS empty FROM i""",
    "glyph_filter": f"""
WITH {_COMPS_SQL}, m AS (SELECT doc_id, page, list_sort(list(h))[count(*) // 2 + 1] AS median_h FROM comps WHERE h >= 4 AND h <= 100 AND w <= 450 GROUP BY doc_id, page)
SELECT c.doc_id, c.page, comp, w, h, median_h FROM comps c JOIN m ON c.doc_id = m.doc_id AND c.page = m.page
WHERE h >= greatest(4, median_h * CAST(0.4 AS DOUBLE)) AND h <= median_h * 3 AND w <= 450 AND pixels >= 8""",
    "split_words": f"""
WITH {_COMPS_SQL}, g AS (SELECT *, min_x - lag(max_x) OVER (PARTITION BY doc_id, page, line ORDER BY min_x, comp) AS gap FROM comps),
m AS (SELECT doc_id, page, line, list_sort(list(h))[count(*) // 2 + 1] AS mh, coalesce(list_sort(list(greatest(gap, 0)) FILTER (WHERE gap IS NOT NULL))[count(gap) // 2 + 1], 0) AS mg FROM g GROUP BY ALL)
SELECT g.doc_id, g.page, g.line, comp, CAST(sum(CASE WHEN gap > greatest(mh * CAST(1.2 AS DOUBLE), mg * CAST(2.5 AS DOUBLE) + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc_id, g.page, g.line ORDER BY min_x, comp) AS BIGINT) AS word
FROM g JOIN m ON g.doc_id = m.doc_id AND g.page = m.page AND g.line = m.line""",
    "word_scores": f"""
WITH {_COMPS_SQL}, m AS (SELECT doc_id, page, line, count(*) AS n, list_sort(list(h))[count(*) // 2 + 1] AS mh FROM comps GROUP BY ALL HAVING count(*) >= 6),
g AS (SELECT c.*, m.n, min_x - lag(max_x) OVER (PARTITION BY c.doc_id, c.page, c.line ORDER BY min_x, comp) AS step, h >= mh * CAST(0.6 AS DOUBLE) AND h <= mh * CAST(1.5 AS DOUBLE) AS near FROM comps c JOIN m ON c.doc_id = m.doc_id AND c.page = m.page AND c.line = m.line),
b AS (SELECT *, near OR sum(CAST(near AS INTEGER)) OVER (PARTITION BY doc_id, page, line) < 3 AS body FROM g),
f AS (SELECT doc_id, page, line, n, count(*) FILTER (WHERE body) AS bn, avg(h) FILTER (WHERE body) AS mean_h, stddev_pop(h) FILTER (WHERE body) AS sd_h, sum(cx) FILTER (WHERE body) AS sx, CAST(sum(max_y) FILTER (WHERE body) AS DOUBLE) AS sy,
  sum(cx * cx) FILTER (WHERE body) AS sxx, sum(cx * max_y) FILTER (WHERE body) AS sxy, min(min_x) AS x, min(min_y) AS y, max(max_x) AS x2, max(max_y) AS y2,
  CASE WHEN count(*) FILTER (WHERE step > 0) >= 2 THEN stddev_pop(step) FILTER (WHERE step > 0) / avg(step) FILTER (WHERE step > 0) ELSE 0 END AS gap_cv FROM b GROUP BY doc_id, page, line, n),
s AS (SELECT *, CASE WHEN abs(bn * sxx - sx * sx) < 1e-6 THEN 0 ELSE (bn * sxy - sx * sy) / (bn * sxx - sx * sx) END AS slope FROM f),
l AS (SELECT *, (sy - slope * sx) / bn AS level FROM s),
w AS (SELECT b.doc_id, b.page, b.line, sqrt(avg(power(b.max_y - (slope * b.cx + level), 2)) FILTER (WHERE b.body)) AS rms FROM b JOIN l ON b.doc_id = l.doc_id AND b.page = l.page AND b.line = l.line GROUP BY ALL),
z AS (SELECT l.*, sd_h / mean_h AS height_cv, rms / mean_h AS baseline FROM l JOIN w ON l.doc_id = w.doc_id AND l.page = w.page AND l.line = w.line)
SELECT doc_id, page, line, n, round(height_cv, 5) AS height_cv, round(baseline, 5) AS baseline, round(gap_cv, 5) AS gap_cv, x, y, x2 - x + 1 AS w, y2 - y + 1 AS h,
  round(100 * {_clamp(f"CAST(0.5 AS DOUBLE) * {_clamp('(height_cv - 0.28) / 0.27')} + CAST(0.4 AS DOUBLE) * {_clamp('(baseline - 0.06) / 0.16')} + CAST(0.1 AS DOUBLE) * {_clamp('(gap_cv - 0.7) / 0.8')}")}, 5) AS score FROM z""",
    "stroke_scores": f"WITH {_COMPS_SQL} {_STROKES} SELECT doc_id, page, comp, x, y, w, h, round(score, 5) AS score FROM strokes",
    "box_overlap_anti": f"""
WITH {_COMPS_SQL}, b AS (SELECT doc_id, page, comp, min_x AS x, min_y AS y, w, h FROM comps)
SELECT * FROM b AS g WHERE comp % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b AS a WHERE a.comp % 2 = 1 AND a.doc_id = g.doc_id AND a.page = g.page AND {_OVERLAP.format(a='g', b='a')})""",
    "low_confidence_words": f"WITH {_WORDS_SQL} {_LOW} SELECT doc_id, page, word, text, confidence FROM low",
    "word_regions": f"WITH {_WORDS_SQL} {_LOW} {_REGIONS} SELECT doc_id, page, row, run, words, x, y, w, h, round(score, 5) AS score FROM regions",
    "page_mean_confidence": f"WITH {_WORDS_SQL} SELECT doc_id, page, round(coalesce(avg(CAST(confidence AS DOUBLE)) FILTER (WHERE trim(text) <> '' AND confidence >= 0), -1), 5) AS mean_confidence FROM words GROUP BY doc_id, page",
    "page_decision": f"""
WITH {_WORDS_SQL} {_STROKES} {_LOW} {_REGIONS},
conf AS (SELECT doc_id, page, coalesce(avg(CAST(confidence AS DOUBLE)) FILTER (WHERE trim(text) <> '' AND confidence >= 0), -1) AS c FROM words GROUP BY doc_id, page),
geo AS (SELECT s.doc_id, s.page, x, y, w, h, score FROM strokes s JOIN conf ON s.doc_id = conf.doc_id AND s.page = conf.page WHERE c < 78),
wr AS (SELECT doc_id, page, x, y, w, h, score FROM regions r WHERE EXISTS (SELECT 1 FROM geo WHERE geo.doc_id = r.doc_id AND geo.page = r.page)),
res AS (SELECT * FROM wr UNION ALL SELECT * FROM geo AS g WHERE NOT EXISTS (SELECT 1 FROM wr AS a WHERE a.doc_id = g.doc_id AND a.page = g.page AND {_OVERLAP.format(a='g', b='a')}))
SELECT doc_id, page, x, y, w, h, round(score, 5) AS score FROM res""",
    "document_handwriting": f"WITH {_COMPS_SQL} {_STROKES} SELECT doc_id, count(*) AS region_count, round(max(score), 5) AS max_score, count(*) >= 1 AS has_handwriting FROM strokes GROUP BY doc_id",
}
