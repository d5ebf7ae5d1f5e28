"""Handwriting analytics over tables of pixels, ink components and recognised words.

Relational steps are aggregations and windows by page; steps whose outcome depends on the order of
arrival run as one Arrow function a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.options import HandwritingOptions

PAGE = ["doc_id", "page"]


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _scaled(c: Column, low: float, high: float) -> Column:
    return _clamp((c - F.lit(low)) / F.lit(high - low))


def upper_median(c: Column) -> Column:
    """Element n // 2 of the sorted values."""
    return F.try_element_at(F.array_sort(F.collect_list(c)), (F.floor(F.count(c) / 2) + 1).cast("int"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright((F.lit(77) * r + F.lit(150) * g + F.lit(29) * b).cast("int"), 8)


def is_colourful(r: Column, g: Column, b: Column, spread: int = 60) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b) > spread


def otsu(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """``threshold`` and ``ink_ratio`` of each page from (keys, gray, n); the first best split wins.

    127 where only one level occurs.  Ink is darker than the threshold.  ``empty`` marks pages with
    too little or too much ink.
    """
    run = Window.partitionBy(*keys).orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    h = histogram.withColumns({
        "wb": F.sum("n").over(run), "sb": F.sum(F.col("gray") * F.col("n")).over(run),
        "w": F.sum("n").over(all_), "s": F.sum(F.col("gray") * F.col("n")).over(all_),
    })
    mb, mf = F.col("sb") / F.col("wb"), (F.col("s") - F.col("sb")) / F.nullif(F.col("w") - F.col("wb"), F.lit(0))
    h = h.withColumn(
        "between",
        F.when(F.col("wb") < F.col("w"), F.col("wb").cast("double") * (F.col("w") - F.col("wb")) * (mb - mf) * (mb - mf))
    )
    best = h.groupBy(*keys).agg(
        F.coalesce(F.max_by("gray", F.struct("between", -F.col("gray"))), F.lit(127)).alias("t"),
        F.max("between").alias("m")
    )
    best = best.select(*keys, F.when(F.col("m").isNull(), 127).otherwise(F.col("t")).alias("threshold"))
    out = histogram.join(best, keys).groupBy(*keys, "threshold").agg(
        (F.sum(F.when(F.col("gray") < F.col("threshold"), F.col("n")).otherwise(0)) / F.sum("n")).alias("ink_ratio")
    )
    return out.withColumn("empty", ~F.col("ink_ratio").between(0.002, 0.5))


def connected_components(pages: DataFrame) -> DataFrame:
    """8-connected ink components of each page (doc_id, page, width, height, ink binary, colour binary).

    One page is one task's work: rows are merged run by run with a union-find over runs.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf.itertuples():
                ink = np.frombuffer(p.ink, np.uint8).reshape(p.height, p.width) > 0
                colour = np.frombuffer(p.colour, np.uint8).reshape(p.height, p.width) > 0
                out += [(p.doc_id, p.page, k, *c) for k, c in enumerate(components_of(ink, colour))]
            yield pd.DataFrame(out, columns=["doc_id", "page", "comp", "min_x", "min_y", "max_x", "max_y", "pixels", "colorful"])

    return pages.mapInPandas(
        run, "doc_id long, page int, comp int, min_x int, min_y int, max_x int, max_y int, pixels int, colorful int"
    )


def components_of(ink: np.ndarray, colour: np.ndarray) -> list[tuple[int, ...]]:
    """(min_x, min_y, max_x, max_y, pixels, colourful) by first pixel in reading order."""
    runs, parent, above = [], [], []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for y in range(ink.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ink[y].view(np.int8), [0]])))
        here = []
        for a, b in zip(edge[::2], edge[1::2] - 1):
            k = len(runs)
            runs.append((int(a), int(b), y, int(np.count_nonzero(colour[y, a : b + 1]))))
            parent.append(k)
            for j in above:
                if runs[j][0] <= b + 1 and runs[j][1] >= a - 1:
                    i, m = sorted((find(j), find(k)))
                    parent[m] = i
            here.append(k)
        above = here
    found: dict[int, list[int]] = {}
    for k, (a, b, y, c) in enumerate(runs):
        box = found.setdefault(find(k), [a, y, b, y, 0, 0])
        box[:] = [min(box[0], a), box[1], max(box[2], b), y, box[4] + b - a + 1, box[5] + c]
    return [tuple(found[k]) for k in sorted(found)]


def with_sizes(components: DataFrame) -> DataFrame:
    return components.withColumns({
        "w": F.col("max_x") - F.col("min_x") + 1, "h": F.col("max_y") - F.col("min_y") + 1,
        "cx": (F.col("min_x") + F.col("max_x")) / 2.0, "cy": (F.col("min_y") + F.col("max_y")) / 2.0,
    })


def filter_glyphs(components: DataFrame, width: Column, height: Column) -> DataFrame:
    """Components of letter size: 0.4 to 3 times the upper median height (4 at least), not wider than half the page, 8 pixels or more."""
    df = with_sizes(components).withColumns({"pw": width, "ph": height})
    usable = (F.col("h") >= 4) & (F.col("h") <= F.floor(F.col("ph") / 6)) & (F.col("w") <= F.floor(F.col("pw") / 2))
    medians = df.filter(usable).groupBy(*PAGE).agg(upper_median(F.col("h")).alias("median_h"))
    return df.join(medians, PAGE).filter(
        (
            F.col("h") >= F.greatest(F.lit(4.0), F.col("median_h") * 0.4)
        ) & (F.col("h") <= F.col("median_h") * 3.0) & (F.col("w") <= F.col("pw") * 0.5) & (F.col("pixels") >= 8)
    ).drop("pw", "ph")


def group_lines(glyphs: DataFrame) -> DataFrame:
    """``line`` of every glyph: by centre height, each joins the nearest line within a tolerance.

    The running mean of a line moves with each glyph, so glyphs of a page are met one by one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cy", "comp"], kind="stable")
        h = np.sort(pdf.h.to_numpy())
        tolerance, sums, counts, lines = max(4.0, float(h[len(h) // 2]) * 0.6), np.zeros(0), np.zeros(0), []
        for y in pdf.cy:
            d = np.abs(sums / counts - y) if len(sums) else np.zeros(0)
            k = int(d.argmin()) if len(d) and d.min() <= tolerance else len(d)
            if k == len(d):
                sums, counts = np.append(sums, 0.0), np.append(counts, 0.0)
            sums[k] += y
            counts[k] += 1
            lines.append(k)
        return pdf.assign(line=np.array(lines, np.int32))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in glyphs.schema) + ", line int"
    return glyphs.groupBy(*PAGE).applyInPandas(run, schema)


def split_words(glyphs: DataFrame) -> DataFrame:
    """``word`` of every glyph of a line: a new one where the gap exceeds max(1.2 median height, 2.5 median gap + 1)."""
    line = [*PAGE, "line"]
    w = Window.partitionBy(*line).orderBy("min_x", "comp")
    df = glyphs.withColumn("gap", F.col("min_x") - F.lag("max_x").over(w))
    limits = df.groupBy(*line).agg(
        upper_median(F.col("h")).alias("mh"),
        F.coalesce(upper_median(F.when(F.col("gap").isNotNull(), F.greatest(F.col("gap"), F.lit(0)))), F.lit(0)).alias("mg")
    )
    limit = F.greatest(F.col("mh") * F.lit(1.2), F.col("mg") * F.lit(2.5) + 1)
    return df.join(limits, line).withColumn(
        "word", F.sum(F.coalesce((F.col("gap") > limit).cast("int"), F.lit(0))).over(w)
    ).drop("mh", "mg")


def word_scores(glyphs: DataFrame, o: HandwritingOptions = HandwritingOptions()) -> DataFrame:
    """Score, box and measures of every word of enough glyphs (columns as from ``split_words``).

    Height variation and baseline waves are of the body: glyphs of 0.6 to 1.5 median heights, or all
    if those are fewer than 3.  The baseline is a least-squares line of the lower edges.
    """
    word = [*PAGE, "line", "word"]
    whole = glyphs.groupBy(*word).agg(
        F.count("*").alias("n"), upper_median(F.col("h")).alias("mh")
    ).filter(F.col("n") >= o.min_glyphs)
    w = Window.partitionBy(*word).orderBy("min_x", "comp")
    df = glyphs.join(whole, word).withColumn("step", F.col("min_x") - F.lag("max_x").over(w)).withColumn(
        "near", (F.col("h") >= F.col("mh") * 0.6) & (F.col("h") <= F.col("mh") * 1.5)
    )
    df = df.withColumn("body", F.col("near") | (F.sum(F.col("near").cast("int")).over(Window.partitionBy(*word)) < 3))
    at = lambda c: F.when(F.col("body"), F.col(c).cast("double"))
    x, y = at("cx"), at("max_y")
    gap = F.when(F.col("step") > 0, F.col("step"))
    fit = df.groupBy(*word, "n").agg(
        F.count(x).alias("bn"), F.avg(at("h")).alias("mean_h"), F.stddev_pop(at("h")).alias("sd_h"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"),
        F.min("min_x").alias("x"), F.min("min_y").alias("y"), F.max("max_x").alias("x2"), F.max("max_y").alias("y2"),
        F.when(F.count(gap) >= 2, F.stddev_pop(gap) / F.avg(gap)).otherwise(0.0).alias("gap_cv"),
    )
    denom = F.col("bn") * F.col("sxx") - F.col("sx") * F.col("sx")
    fit = fit.withColumn(
        "slope",
        F.when(F.abs(denom) < 1e-6, 0.0).otherwise(
            (F.col("bn") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(denom, F.lit(0.0))
        )
    )
    fit = fit.withColumn("level", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("bn"))
    left = F.when(F.col("body"), F.pow(F.col("max_y") - (F.col("slope") * F.col("cx") + F.col("level")), 2))
    waves = df.select(*word, "body", "max_y", "cx").join(
        fit.select(*word, "slope", "level"), word
    ).groupBy(*word).agg(F.sqrt(F.avg(left)).alias("rms"))
    out = fit.join(waves, word).withColumn(
        "height_cv", F.col("sd_h") / F.col("mean_h")
    ).withColumn("baseline", F.col("rms") / F.col("mean_h"))
    out = out.withColumn("gap_cv", F.when(F.col("n") >= 3, F.col("gap_cv")).otherwise(0.0))
    # Weights and ranges of the three measures.
    score = 100 * _clamp(
        0.5 * _scaled(
            F.col("height_cv"), 0.28, 0.55
        ) + 0.4 * _scaled(F.col("baseline"), 0.06, 0.22) + 0.1 * _scaled(F.col("gap_cv"), 0.70, 1.50)
    )
    return out.select(
        *word, "n", "height_cv", "baseline", "gap_cv", "x", "y", (F.col("x2") - F.col("x") + 1).alias("w"),
        (F.col("y2") - F.col("y") + 1).alias("h"), score.alias("score")
    )


def stroke_scores(
    components: DataFrame, width: Column, height: Column, median_h: Column, o: HandwritingOptions = HandwritingOptions()
) -> DataFrame:
    """Large connected strokes (signatures, cursive words) with their score; those below the threshold go."""
    # All bounds, ranges and weights.
    df = with_sizes(components).withColumns({"pw": width, "ph": height, "mh": median_h})
    df = df.filter(
        (
            F.col("w") >= F.greatest(F.lit(14), F.floor(F.col("pw") * 0.018))
        ) & (F.col("h") >= F.greatest(F.lit(5), F.floor(F.col("ph") * 0.003)))
        & (F.col("w") <= F.col("pw") * 0.85) & (F.col("h") <= F.col("ph") * 0.18) & (
            (F.col("mh") <= 0) | (F.col("h") >= F.col("mh") * 1.4)
        )
    )
    df = df.withColumns(
        {
            "aspect": F.col("w").cast("double") / F.col("h"),
            "density": F.col("pixels").cast("double") / (F.col("w") * F.col("h")),
            "colour": F.when(F.col("pixels") > 0, F.col("colorful").cast("double") / F.col("pixels")).otherwise(0.0)
        }
    )
    df = df.filter(F.col("aspect").between(1.5, 8.0) & F.col("density").between(0.015, 0.42) & (F.col("colour") <= 0.35))
    density = F.when(
        F.col("density") <= 0.12, _scaled(F.col("density"), 0.015, 0.06)
    ).otherwise(1 - _scaled(F.col("density"), 0.12, 0.42))
    score = 100 * _clamp(
        0.5 * _scaled(F.col("aspect"), 1.5, 4.0) + 0.3 * density + 0.2 * _scaled(
            F.col("w").cast("double") / F.col("pw"), 0.018, 0.16
        )
    )
    return df.withColumn("score", score).filter(F.col("score") >= o.min_score).select(
        *PAGE, "comp", F.col("min_x").alias("x"), F.col("min_y").alias("y"), "w", "h", "score"
    )


def overlap(a: str, b: str, share: float) -> Column:
    """Whether two boxes (prefixes a, b) share at least ``share`` of the smaller one."""
    c = lambda p, n: F.col(f"{p}{n}")
    dx = F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x"))
    dy = F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y"))
    smaller = F.least(c(a, "w").cast("double") * c(a, "h"), c(b, "w").cast("double") * c(b, "h"))
    return (dx > 0) & (dy > 0) & (smaller > 0) & (dx.cast("double") * dy >= smaller * share)


def without_overlaps(regions: DataFrame, accepted: DataFrame, share: float = 0.5) -> DataFrame:
    """Regions that overlap none of the accepted ones of their page."""
    right = accepted.select(*[F.col(k).alias(f"a_{k}") for k in PAGE], *[F.col(c).alias(f"a_{c}") for c in ("x", "y", "w", "h")])
    left = regions.select("*", *[F.col(c).alias(f"g_{c}") for c in ("x", "y", "w", "h")])
    same = (F.col("doc_id") == F.col("a_doc_id")) & (F.col("page") == F.col("a_page"))
    return left.join(right, same & overlap("g_", "a_", share), "left_anti").select(regions.columns)


def first_of_overlapping(regions: DataFrame, order: list[str], share: float = 0.65) -> DataFrame:
    """Regions of a page met in order; one that overlaps an accepted one goes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept, rows = pdf.sort_values(order, kind="stable"), np.zeros((0, 4)), []
        for k, (x, y, w, h) in enumerate(pdf[["x", "y", "w", "h"]].to_numpy(float)):
            dx = np.minimum(kept[:, 0] + kept[:, 2], x + w) - np.maximum(kept[:, 0], x)
            dy = np.minimum(kept[:, 1] + kept[:, 3], y + h) - np.maximum(kept[:, 1], y)
            smaller = np.minimum(kept[:, 2] * kept[:, 3], w * h)
            if not ((dx > 0) & (dy > 0) & (smaller > 0) & (dx * dy >= smaller * share)).any():
                kept, rows = np.vstack([kept, [x, y, w, h]]), [*rows, k]
        return pdf.iloc[rows]

    return regions.groupBy(*PAGE).applyInPandas(run, regions.schema)


def colour_fractions(pages: DataFrame, words: DataFrame) -> DataFrame:
    """``colour`` of every word: the share of colourful pixels in its box.

    pages: doc_id, page, width, height, scale, colour (binary).  A page's mask becomes a two-way
    running sum, from which each box takes four values.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return right.assign(colour=0.0)
        p = left.iloc[0]
        sums = np.zeros((p.height + 1, p.width + 1), np.int64)
        sums[1:, 1:] = (np.frombuffer(p.colour, np.uint8).reshape(p.height, p.width) > 0).cumsum(0).cumsum(1)
        x1, y1 = (np.clip(np.floor(right[c] * p.scale), 0, n - 1).astype(int) for c, n in (("x", p.width), ("y", p.height)))
        x2, y2 = (
            np.clip(np.ceil((right[c] + right[d]) * p.scale), 0, n).astype(int) for c, d,
            n in (("x", "w", p.width), ("y", "h", p.height))
        )
        area = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
        inside = sums[y2, x2] - sums[y1, x2] - sums[y2, x1] + sums[y1, x1]
        return right.assign(colour=np.where(area > 0, inside / np.maximum(area, 1), 0.0))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema) + ", colour double"
    return pages.groupBy(*PAGE).cogroup(words.groupBy(*PAGE)).applyInPandas(run, schema)


def low_confidence_words(words: DataFrame, page_height: Column, o: HandwritingOptions = HandwritingOptions()) -> DataFrame:
    """Recognised words that may be handwriting (needs ``colour``)."""
    return words.filter(
        (F.trim("text") != "") & (F.col("confidence") >= 0) & (
            F.col("confidence") < o.low_confidence
        ) & (F.col("w") >= 8) & (F.col("h") >= 8) & (F.col("h") <= page_height * 0.12) & (F.col("colour") <= 0.15)
    )


def word_rows(words: DataFrame) -> DataFrame:
    """``row`` of every word, with ``gap_limit``: words join a row while their centre is near its moving middle.

    Words arrive in order, page after page, so one loop goes through all pages of a task; only what
    it knows of the page it is in is kept, however long that page is.
    """
    at = [F.asc_nulls_last(c) for c in ("__cy", "x", "word")]
    whole = Window.partitionBy(*PAGE)
    rank = F.floor(F.count("*").over(whole) / 2) + 1
    df = words.withColumns(
        {"__k": F.row_number().over(whole.orderBy(F.asc_nulls_last("h"))) == rank, "__cy": F.col("y") + F.col("h") / 2.0}
    )
    median = F.max(F.when(F.col("__k"), F.col("h").cast("double"))).over(whole)
    df = df.withColumn("__median", median).withColumn("__first", F.row_number().over(whole.orderBy(*at)) == 1)
    df = df.select(
        *words.columns, F.greatest(F.col("__median") * 3.0, F.lit(30.0)).alias("gap_limit"), "__first", "__cy",
        F.greatest(F.lit(6.0), F.col("__median") * 0.7).alias("__near")
    ).sortWithinPartitions(*[F.asc(k) for k in PAGE], *at)

    names = [*words.columns, "row", "gap_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, middle = -1, 0.0
        for batch in batches:
            *own, gap, first, cy, near = batch.columns
            rows = []
            for new, y, most in zip(first.to_pylist(), cy.to_numpy(zero_copy_only=False).tolist(), near.to_pylist()):
                if new:
                    row, middle = 0, y
                elif abs(y - middle) <= most:
                    middle = (middle + y) / 2.0
                else:
                    row, middle = row + 1, y
                rows.append(row)
            yield pa.RecordBatch.from_arrays([*own, pa.array(rows, pa.int32()), gap], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema) + ", row int, gap_limit double"
    return df.mapInArrow(run, schema)


def word_regions(words: DataFrame) -> DataFrame:
    """Boxes of runs of words of a row, split at gaps beyond ``gap_limit``; score 100 - mean confidence."""
    w = Window.partitionBy(*PAGE, "row").orderBy("x", "word")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)
    df = words.withColumn("run", F.sum(F.coalesce((gap > F.col("gap_limit")).cast("int"), F.lit(0))).over(w))
    out = df.groupBy(*PAGE, "row", "run").agg(
        F.count("*").alias("words"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"),
        F.avg(F.col("confidence").cast("double")).alias("c")
    )
    return out.select(
        *PAGE, "row", "run", "words", "x", "y", (F.col("x2") - F.col("x")).alias("w"),
        (F.col("y2") - F.col("y")).alias("h"),
        F.least(F.greatest(100 - F.col("c"), F.lit(0.0)), F.lit(100.0)).alias("score")
    )


def mean_confidence(words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean confidence of non-blank words of confidence 0 or more; -1 without any."""
    c = F.when((F.trim("text") != "") & (F.col("confidence") >= 0), F.col("confidence").cast("double"))
    return words.groupBy(*(keys or PAGE)).agg(F.coalesce(F.avg(c), F.lit(-1.0)).alias("mean_confidence"))


def page_regions(
    geometry: DataFrame, from_words: DataFrame, confidence: DataFrame, o: HandwritingOptions = HandwritingOptions()
) -> DataFrame:
    """Final regions of every page.

    No geometry: none.  Without corroboration or recognised words: the geometry.  Printed text (mean
    confidence high enough): none.  Else word regions and the geometry that overlaps none of them.
    """
    if not o.corroborate:
        return geometry
    marked = geometry.join(confidence, PAGE, "left").filter(
        F.coalesce(F.col("mean_confidence"), F.lit(-1.0)) < o.printed_confidence
    )
    alone = marked.select(geometry.columns)
    pages = alone.select(*PAGE).distinct()
    words = from_words.join(pages, PAGE, "left_semi").select(geometry.columns)
    return words.unionByName(without_overlaps(alone, words, 0.5))


def document_rollup(pages: DataFrame, o: HandwritingOptions = HandwritingOptions()) -> DataFrame:
    """Documents of pages (doc_id, page, regions array, max_score): decision, region count, largest score, all regions."""
    return pages.groupBy("doc_id").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("page", "regions"))), lambda p: p["regions"])
        ).alias("regions"), F.max("max_score").alias("max_score")
    ).withColumn("region_count", F.size("regions")).withColumn("has_handwriting", F.col("region_count") >= o.min_regions)
