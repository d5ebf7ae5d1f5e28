"""Boilerplate lines by site-relative frequency, in DataFrame operations only.

A line is boilerplate of a site when it stands on more than a given share of the site's pages.
Lines are counted by 96-bit hash, once for each page; only lines on several pages leave the
aggregation.  While the boilerplate table is small it is broadcast and page texts are not shuffled;
beyond that pages meet it by site, and Spark splits the pages of a large site over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import docs, prepare, stored

#: Rows up to which the boilerplate table is broadcast (about 40 bytes each); beyond it, pages are joined by key.
BROADCAST_ROWS = 100_000


#: White space of ASCII; a line of nothing else is blank.
BLANK = "[ \\t\\n\\x0B\\f\\r]*"


def host(url: Column) -> Column:
    """The site of a page by its address: the host in lower case; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _site(site: Column) -> Column:
    """A null site is a site of its own."""
    return F.struct(site.isNull().alias("n"), F.coalesce(site.cast("string"), F.lit("")).alias("s"))


def boilerplate_lines(df: DataFrame, site: Column, text: Column, max_ratio: float, min_pages: int) -> DataFrame:
    """``site`` (struct), ``k`` (line key), ``n_pages`` and ``site_pages`` of every boilerplate line.

    Blank lines are never boilerplate.  The number of such lines of a site is at most the mean
    number of its lines a page over ``max_ratio``.
    """
    pages = df.select(_site(site).alias("site"), text.alias("t"))
    totals = pages.groupBy("site").agg(F.count("*").alias("site_pages"))
    lines = pages.select(
        "site", F.explode(F.array_distinct(F.split("t", "\n", -1))).alias("line")
    ).filter(~F.col("line").rlike(f"\\A{BLANK}\\z"))
    counted = lines.groupBy(
        "site", line_key(F.col("line")).alias("k")
    ).agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    return counted.join(totals, "site").filter(F.col("n_pages") > F.col("site_pages") * F.lit(max_ratio))


def drop_boilerplate(
    df: DataFrame, site: str | Column = "source", text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 3
) -> DataFrame:
    """``df`` with boilerplate lines removed from the text, and ``n_lines``, ``n_dropped``.

    Every row stays, with all its other columns; columns of ``df`` named n_lines or n_dropped are
    replaced.  A null text stays null with 0 lines; an empty one stays empty.  Repeated rows count
    as pages of their own.  Rows of a null site form one site.  site: a column by name, or any
    expression, such as ``host(F.col("url"))``.
    """
    prepare(df.sparkSession)
    site = F.col(site) if isinstance(site, str) else site
    found = boilerplate_lines(df, site, F.col(text_col), max_ratio, min_pages).select("site", "k")
    rows = df.withColumn("__fs_site", _site(site)).withColumn("__fs_lines", F.split(text_col, "\n", -1))
    kept_table = found.groupBy("site").agg(F.collect_list("k").alias("__fs_drop")).withColumnRenamed("site", "__fs_at")
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        kept_table = F.broadcast(kept_table)
    else:
        kept_table = stored(kept_table, "boilerplate")
    joined = rows.join(kept_table, F.col("__fs_site") == F.col("__fs_at"), "left")
    keep = F.when(F.col("__fs_drop").isNull(), F.col("__fs_lines")).otherwise(
        F.filter("__fs_lines", lambda x: ~F.array_contains(F.col("__fs_drop"), line_key(x)))
    )
    out = joined.withColumn("__fs_kept", keep)
    return (
        out.withColumn(
            text_col,
            F.when(F.size("__fs_kept") == F.size("__fs_lines"), F.col(text_col)).otherwise(F.array_join("__fs_kept", "\n"))
        )
        .withColumn("n_lines", F.when(F.col("__fs_lines").isNull(), 0).otherwise(F.size("__fs_lines")))
        .withColumn("n_dropped", F.col("n_lines") - F.when(F.col("__fs_kept").isNull(), 0).otherwise(F.size("__fs_kept")))
        .drop("__fs_site", "__fs_at", "__fs_lines", "__fs_drop", "__fs_kept")
    )


def op2_lines(spark, sf_dir):
    """Query: documents without the boilerplate lines of their source."""
    out = drop_boilerplate(docs(spark, sf_dir))
    return out.select(
        "doc_id", "source", F.col("text").alias("clean_text"), F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped")
    )


OP2_SQL = """
WITH pages AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS site_pages FROM documents GROUP BY source),
each AS (SELECT source, unnest(list_distinct(lines)) AS line FROM pages),
counted AS (SELECT source, line, count(*) AS n_pages FROM each WHERE NOT regexp_full_match(line, '[ \t\n\x0B\f\r]*') GROUP BY source, line),
found AS (
  SELECT c.source, list(c.line) AS drops FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n_pages >= 3 AND c.n_pages > t.site_pages * CAST(0.05 AS DOUBLE) GROUP BY c.source),
kept AS (
  SELECT p.doc_id, p.source, p.lines, CASE WHEN f.drops IS NULL THEN p.lines ELSE list_filter(p.lines, lambda x: NOT list_contains(f.drops, x)) END AS rest
  FROM pages p LEFT JOIN found f ON p.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, source, array_to_string(rest, chr(10)) AS clean_text, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines), 0) - coalesce(len(rest), 0) AS BIGINT) AS n_dropped
FROM kept
"""
