"""License scans, in DataFrame operations only: exact phrases, and a set-similarity join of texts with templates.

A template is found where some run of at most twice as many consecutive words as it has, wherever
its lines end, holds at least the threshold's share of the template's distinct words and all its
telling ones (by which it differs from its like).  Words are ordered by the number of texts that
hold them, rarest first; a text can only hold such a run when it has one of the template's first
(size - needed + 1) words (prefix), has at least as many template words as needed (length), and has
enough words left after the first one they share (position).  What passes is verified run by run.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import docs, prepare, stored

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_IN, _OUT = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"

#: Templates: label, the words of a usual notice, and its telling words.  Several may share a label.
TEMPLATES: list[tuple[str, str, str]] = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache"),
    ("mit", "released under the mit license", ""),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "2"),
    ("cc-by", "licensed under cc by 4 0", ""),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ""),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ""),
    ("public-domain", "this work is dedicated to the public domain", ""),
    ("all-rights-reserved", "all rights reserved", ""),
]


def _phrase(phrase: str) -> str:
    return f"{_OUT}+".join(phrase.split())


def _any(phrases) -> str:
    return f"(?i)(?<!{_IN})(?:{'|'.join(map(_phrase, phrases))})(?!{_IN})"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{_IN}+")), F.lit(0)).cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and ``base`` (array of labels) of a text."""
    anywhere = _any(PHRASES)
    has = F.coalesce(text.rlike(anywhere), F.lit(False))
    # No phrase ends as another (or itself) begins, so matches never overlap and counting them counts all places.
    ahead = "(?si)\\A(.*{lazy})(?<!{i})(?:{p})(?!{i})"
    first, last = (F.regexp_extract(text, ahead.format(lazy=z, i=_IN, p="|".join(map(_phrase, PHRASES))), 1) for z in ("?", ""))
    labels = F.array(*[F.when(text.rlike(_any([p])), F.lit(label)) for p, label in PHRASES.items()])
    return {
        "n_words": word_count(text),
        "n_base": F.when(has, F.regexp_count(text, F.lit(anywhere))).otherwise(0).cast("long"),
        "first_word": F.when(has, word_count(first)),
        "last_word": F.when(has, word_count(last)),
        "base": F.when(has, F.array_compact(labels)).otherwise(F.array().cast("array<string>")),
    }


@dataclass(frozen=True)
class Template:
    """One template: its distinct words, how many of them a run must hold, and how long a run may be."""

    label: str
    words: list[str]
    telling: list[str]
    need: int
    width: int


def template_sets(templates: list[tuple[str, str, str]], threshold: float) -> list[Template]:
    return [
        Template(
            label, w := sorted(set(text.split())), sorted(set(telling.split())), math.ceil(threshold * len(w)),
            2 * len(text.split())
        ) for label,
        text, telling in templates
    ]


def lowered(text: Column) -> Column:
    """Lower case of A-Z for what follows: the two other characters whose lower case is in a-z are made one that no template has."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u00ff")), F.lit("\u0130"), F.lit("\u00ff")))


def words_of(text: Column) -> Column:
    """All words in order, perhaps with an empty one at either end."""
    return F.split(lowered(text), f"{_OUT}+")


def text_key(text: Column) -> Column:
    """The hash of a text; null where there is none."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def match_templates(
    df: DataFrame, text: Column, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = 0.85
) -> DataFrame:
    """``h`` (hash of the text), ``label`` and ``containment``: the best run of each text and label.

    Two passes over the texts: one counts the texts that hold each template word, the other joins
    prefixes with the template index, which has one row for each prefix word of each template (a
    fixed, small table), and verifies what passes.  No text is shuffled.
    """
    spark = df.sparkSession
    sets = template_sets(templates, threshold)
    vocabulary = sorted({w for t in sets for w in t.words})
    least = min(t.need for t in sets)
    known = F.array(*map(F.lit, vocabulary))
    texts = df.select(text.alias("t")).filter(F.col("t").isNotNull())
    own = F.array_intersect(words_of(F.col("t")), known)
    counted = {
        r["w"]: r["n"] for r in texts.select(F.explode(own).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    }
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    index = []
    for k, t in enumerate(sets):
        ranks = sorted(rank[w] for w in t.words)
        index += [
            (r, k, t.label, i, len(ranks), t.need, ranks, t.words, t.telling, t.width) for i,
            r in enumerate(ranks[: len(ranks) - t.need + 1])
        ]
    small = spark.createDataFrame(
        index,
        "word int, template int, label string, i int, size int, need int, ranks array<int>, words array<string>, telling array<string>, width int"
    )
    to_rank = F.create_map([F.lit(x) for pair in rank.items() for x in pair])
    # No lambda before the explode: the optimizer would split the text again for each of its calls.
    split = texts.select(
        text_key(F.col("t")).alias("h"), words_of(F.col("t")).alias("run")
    ).select("h", "run", F.array_intersect("run", known).alias("own")).filter(F.size("own") >= least)
    split = split.select("h", "run", F.explode(F.array("own")).alias("own")).select(
        "h", "run", F.array_sort(F.transform("own", lambda w: F.element_at(to_rank, w))).alias("own")
    )
    pairs = split.select("h", "run", "own", F.posexplode("own").alias("j", "word")).join(F.broadcast(small), "word")
    # Length, position, and of the prefix words that both have, the first only.
    pairs = pairs.filter(
        (F.size("own") >= F.col("need")) & (
            1 + F.least(F.col("size") - F.col("i") - 1, F.size("own") - F.col("j") - 1) >= F.col("need")
        )
    )
    pairs = pairs.filter(
        (F.size(F.array_intersect("own", "ranks")) >= F.col("need")) & ~F.arrays_overlap(
            F.slice("own", F.lit(1), F.col("j")), F.slice("ranks", F.lit(1), F.col("i"))
        )
    )
    starts = F.filter(F.sequence(F.lit(1), F.size("run")), lambda p: F.array_contains(F.col("words"), F.element_at("run", p)))

    def held(p: Column) -> Column:
        found = F.array_intersect(F.slice("run", p, F.col("width")), F.col("words"))
        return F.when(F.size(F.array_except("telling", found)) == 0, F.size(found)).otherwise(0)

    best = pairs.select("h", "label", "need", "size", F.array_max(F.transform(starts, held)).alias("both")).filter("both >= need")
    return best.groupBy("h", "label").agg(F.max(F.col("both") / F.col("size")).alias("containment"))


def scan_licenses(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES,
    threshold: float = 0.85
) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row.

    Null text counts as empty: no words, no labels, null first and last word, score 0.  score is 1
    with a base phrase, else the largest containment.  Repeated and null ids pass through; equal
    texts get equal results, as labels belong to a text's hash.  Other columns are not read.
    """
    prepare(df.sparkSession)
    text = F.col(text_col)
    found = match_templates(df, text, templates, threshold).groupBy("h").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best")
    )
    # Written before it is joined, so that Spark knows its size and can split the rows of one much repeated text.
    found = stored(
        found.select(F.col("h").alias("__fs_at"), F.col("more").alias("__fs_more"), F.col("best").alias("__fs_best")),
        "licenses"
    )
    base = base_columns(text)
    rows = df.select(F.col(id_col), text_key(text).alias("__fs_h"), *[c.alias(f"__fs_{n}") for n, c in base.items()])
    joined = rows.join(found, F.col("__fs_h") == F.col("__fs_at"), "left")
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    more = F.coalesce(F.col("__fs_more"), F.array().cast("array<string>"))
    return joined.select(
        id_col, *[F.col(f"__fs_{n}").alias(n) for n in ("n_words", "n_base", "first_word", "last_word")],
        join(F.col("__fs_base")).alias("base_labels"),
        join(F.concat("__fs_base", more)).alias("labels"),
        F.when(F.col("__fs_n_base") > 0, 1.0).otherwise(F.coalesce(F.col("__fs_best"), F.lit(0.0))).alias("score"),
    )


def op8_licenses(spark, sf_dir):
    """Query: every whole text of ``documents``."""
    return scan_licenses(docs(spark, sf_dir))


def licenses_sql(templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = 0.85) -> str:
    """``scan_licenses`` in DuckDB SQL: every run that starts with a template word, against every template."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    sets = ", ".join(
        f"({k}, '{t.label}', {t.words!r}, CAST({t.telling!r} AS VARCHAR[]), {t.need}, {t.width})" for k,
        t in enumerate(template_sets(templates, threshold))
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {low} AS t FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(t, {word}) AS words FROM d),
phrases(p, label) AS (VALUES {phrases}),
places AS (
  SELECT w.rid, unnest(list_filter(range(1, len(w.words) + 1), lambda i: w.words[i:i + len(p) - 1] = p)) AS pos, label
  FROM w, phrases WHERE list_has_all(w.words, p)),
base AS (SELECT rid, count(*) AS n_base, min(pos) - 1 AS first_word, max(pos) - 1 AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY rid),
templates(id, label, words, telling, need, width) AS (VALUES {sets}),
able AS (SELECT w.rid, w.words AS run, t.* FROM w, templates t WHERE len(list_intersect(w.words, t.words)) >= t.need),
runs AS (SELECT rid, id, label, words, telling, need, unnest(list_transform(list_filter(range(1, len(run) + 1), lambda i: list_contains(words, run[i])), lambda i: run[i:i + width - 1])) AS r FROM able),
hits AS (
  SELECT rid, label, len(list_intersect(r, words)) / CAST(len(words) AS DOUBLE) AS containment
  FROM runs WHERE len(list_intersect(r, words)) >= need AND list_has_all(r, telling)),
more AS (SELECT rid, list(DISTINCT label) AS labels, max(containment) AS best FROM hits GROUP BY rid)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN CAST(1.0 AS DOUBLE) ELSE coalesce(best, CAST(0.0 AS DOUBLE)) END AS score
FROM w LEFT JOIN base b ON w.rid = b.rid LEFT JOIN more m ON w.rid = m.rid
"""
