"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by deterministic coin tossing: every symbol is compared with its left
neighbour, the lowest bit in which they differ becomes its label, and after three rounds labels are
below 8; symbols whose label is a local maximum end phrases.  A phrase is named by a hash of its
symbols and names are parsed again, level by level.  Where a phrase ends depends on a few neighbours
only, so equal substrings share all interior names wherever they stand.

Many texts are parsed in one pass of array operations; borders of texts always end phrases and
never look across, so the names of a text do not depend on its companions.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs, prepare, slices

#: Names of these levels make the fingerprint (level 1: phrases of characters).
LEVELS, FROM_LEVEL, SKETCH = 7, 2, 64
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P2
    x = (x ^ (x >> np.uint64(27))) * _P3
    return x ^ (x >> np.uint64(31))


def _toss(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """2 * lowest differing bit + that bit, against the left neighbour; at starts against the complement, so bit 0."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[starts] = ~x[starts]
    diff = x ^ left
    low = diff & (~diff + x.dtype.type(1))
    k = np.bitwise_count(low - x.dtype.type(1)).astype(x.dtype)
    return (2 * k + ((x >> k) & x.dtype.type(1))).astype(x.dtype)


def phrase_ends(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a phrase ends after each symbol.

    x: symbols of all texts, one after the other; starts: where each (non-empty) text starts.
    Equal neighbours differ nowhere: a run of one symbol is cut into phrases of two, counted from
    its start, so runs are parsed alike everywhere.
    """
    n = len(x)
    same = np.zeros(n, bool)
    same[1:] = x[1:] == x[:-1]
    same[starts] = False
    y = _toss(x, starts)
    if x.dtype.itemsize > 1:
        y = y.astype(np.uint8)
    y = _toss(y, starts)
    y = _toss(y, starts)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], after[:-1] = y[:-1], y[1:]
    last = np.append(starts[1:], n) - 1
    before[starts] = 255
    after[last] = 255
    top = (y > before) & (y >= after)
    # Stretches without a top (equal labels) are cut every third symbol, counted from the last top.
    at = np.arange(n)
    anchor = np.where(top, at, -1)
    anchor[starts] = np.where(top[starts], starts, starts - 1)
    anchor = np.maximum.accumulate(anchor)
    top |= (at - anchor) % 3 == 0
    if same.any():
        run = np.maximum.accumulate(np.where(same, -1, at))
        inside = same.copy()
        inside[:-1] |= same[1:]
        top = np.where(inside, (at - run) % 2 == 1, top)
        # what stands before a run ends there
        head = np.nonzero(inside & ~same)[0]
        top[head[head > 0] - 1] = True
        tail = same.copy()
        tail[:-1] &= ~same[1:]
        top |= tail
    top[last] = True
    return top


def parse(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Level, names, and the number of the text of each name, from level 1 on."""
    sizes = np.array([len(t) for t in texts], np.int64)
    x: np.ndarray = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    for level in range(1, LEVELS + 1):
        if not len(x):
            return
        starts = np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0]
        ends = np.nonzero(phrase_ends(x, starts))[0]
        first = np.append(0, ends[:-1] + 1)
        size = ends - first + 1
        name = _mix((x[first].astype(np.uint64) + np.uint64(level)) * _P1)
        for k in range(1, int(size.max())):
            more = np.nonzero(size > k)[0]
            name[more] = _mix(name[more] * _P1 + x[first[more] + k].astype(np.uint64))
        x, owner = name, owner[ends]
        yield level, x, owner


def signatures(texts: list[str | None], chunk: int = 1 << 19) -> list[np.ndarray]:
    """The SKETCH smallest names of levels FROM_LEVEL and up, sorted, as 32-bit numbers.

    An empty text has none.  Texts are parsed together, about ``chunk`` bytes at a time.
    """
    out: list[np.ndarray] = []
    part, size = [], 0
    for text in texts:
        raw = (text or "").encode()
        part.append(raw)
        size += len(raw)
        if size >= chunk:
            out += _signatures(part)
            part, size = [], 0
    return out + _signatures(part)


def _signatures(raw: list[bytes]) -> list[np.ndarray]:
    levels = [(_mix(x * _P3 + np.uint64(level)) >> np.uint64(32), owner) for level, x, owner in parse(raw) if level >= FROM_LEVEL]
    if not levels:
        return [np.zeros(0, np.uint32)] * len(raw)
    both = np.unique(np.concatenate([(owner.astype(np.uint64) << np.uint64(32)) | name for name, owner in levels]))
    bounds = np.searchsorted(both, np.arange(len(raw) + 1, dtype=np.uint64) << np.uint64(32))
    name = both.astype(np.uint32)
    return [name[a : min(b, a + SKETCH)] for a, b in zip(bounds[:-1], bounds[1:])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of the names of two texts, from what both sketches cover; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    upto = min(s[-1] if len(s) == SKETCH else 0xFFFFFFFF for s in (a, b))
    a, b = a[: np.searchsorted(a, upto, "right")], b[: np.searchsorted(b, upto, "right")]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by as many first ones of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def bucket_borders(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Upper borders (o, h) of all buckets but the last: quantiles of the ids.

    An id that is several quantiles (null ids, or one that many rows repeat) is cut by the hash of
    the text into as many buckets, so none holds much over twice its share.
    """
    if parts < 2:
        return []
    found = rows.agg(F.percentile_approx("o", F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10 * parts)).first()[0] or []
    times = Counter(found)
    top = (1 << 63) - 1
    return [
        (o, top) if n == 1 else (o, -(1 << 63) + (k << 64) // (n + 1) - 1) for o,
        n in sorted(times.items()) for k in range(1, n + 1)
    ]


def with_next(df: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows dealt into ``parts`` buckets of id order; bucket k is partition k, sorted by descending
    id, and ends with the row that follows it, marked by ``halo``.

    The driver sees only borders and the largest row key of each bucket.  Rows of one id are
    ordered by a hash of the text; rows that repeat both stay in one bucket.
    """
    rows = df.select(
        F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    ).withColumn("o", F.coalesce(F.expr("try_cast(i as bigint)"), F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("t"))
    borders = bucket_borders(rows, parts)
    # Bucket 0 has the largest ids.  Borders are looked up in two steps, by groups of about the root of their number.
    bucket = F.lit(0)
    if borders:
        step = max(1, math.isqrt(len(borders)))
        groups = [borders[k : k + step] for k in range(0, len(borders), step)]
        key = lambda b: F.struct(F.lit(b[0]).cast("long").alias("o"), F.lit(b[1]).cast("long").alias("h"))
        ends = F.array(*[key(g[-1]) for g in groups])
        fine = F.array(*[F.array(*map(key, g)) for g in groups])
        own = F.struct("o", "h")
        group = F.size(F.filter(ends, lambda x: x < own))
        below = F.when(group < len(groups), F.size(F.filter(F.get(fine, group), lambda x: x < own))).otherwise(0)
        bucket = F.lit(len(borders)) - F.least(group * step + below, F.lit(len(borders)))
    rows = rows.withColumn("b", bucket.cast("int"))
    tops = sorted(
        (r["b"], r["m"]["o"], r["m"]["h"]) for r in rows.groupBy("b").agg(F.max(F.struct("o", "h")).alias("m")).collect()
    )
    follows = {}
    for k, (_, o, h) in enumerate(tops):
        follows.setdefault((o, h), []).append(tops[k - 1][0])
    to = F.array(F.struct(F.col("b").alias("b"), F.lit(False).alias("halo")))
    if tops:
        table = F.create_map([x for (o, h), bs in follows.items() for x in (F.lit(f"{o}:{h}"), F.array(*map(F.lit, bs)))])
        extra = F.element_at(table, F.concat_ws(":", F.col("o").cast("string"), F.col("h").cast("string")))
        to = F.concat(
            to,
            F.coalesce(
                F.transform(extra, lambda b: F.struct(b.alias("b"), F.lit(True).alias("halo"))),
                F.array().cast("array<struct<b:int,halo:boolean>>")
            )
        )
    dealt = rows.select("i", "t", "o", "h", F.explode(to).alias("x")).select("i", "t", "o", "h", "x.b", "x.halo")
    return dealt.repartitionById(max(parts, 1), F.col("b")).sortWithinPartitions("b", "halo", F.desc("o"), F.desc("h"))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and how alike they are.

    The edited text takes its last half from the start of the next row by descending id (the
    first row follows the last).  Null text counts as empty; null ids come last; rows of one id
    follow each other by a hash of their text, and equal rows stand side by side.  A single row is
    followed by itself.  One shuffle, by buckets of ids.
    """
    spark = prepare(df.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(df, id_col, text_col, parts).select("i", "t", "b", "halo")
    id_type = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in (p for b in batches for p in slices(b, 1)):
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            if held:
                rows.insert(0, held)
            if not rows:
                continue
            # Every row but the last meets its next here; the last waits for the next batch.
            held = rows[-1]
            pairs = [(k, k + 1) for k in range(len(rows) - 1) if rows[k][2] == rows[k + 1][2] and not rows[k][3]]
            if not pairs:
                continue
            used = sorted({k for p in pairs for k in p})
            own = dict(zip(used, signatures([rows[k][1] for k in used])))
            changed = [edited(rows[a][1], rows[b][1]) for a, b in pairs]
            theirs = signatures(changed)
            cols = zip(*(
                (
                    rows[a][0], len(rows[a][1]), hashlib.sha256(e.encode()).hexdigest(), as_text(own[a]), as_text(s),
                    likeness(own[a], s), likeness(own[a], own[b])
                )
                for (a, b), e, s in zip(pairs, changed, theirs)
            ))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(c), t) for c,
                    t in zip(
                        cols,
                        (
                            batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
                            pa.float64()
                        )
                    )
                ],
                names=names
            )

    return rows.mapInArrow(
        run,
        f"{id_col} {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op7_parsing(spark, sf_dir):
    """Query: every whole text of ``documents``."""
    return fingerprint_documents(docs(spark, sf_dir))
