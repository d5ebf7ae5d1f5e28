"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Every text is a bag of hashed n-grams: words, word pairs, and pairs of word shapes.  Two
multinomials are counted, one over target texts (a bounded, documented sample of labelled rows),
one over all texts.  The log of their ratio is a text's importance weight.  Sampling without
replacement in proportion to the weights keeps the k largest of log weight + Gumbel noise.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .batches import P1, Stretches, char_table, mix, ranges, stretches, words
from .common import docs, prepare, release, slices, spread, stored

WORDS, SHAPES = 8192, 1024
BUCKETS = WORDS + SHAPES
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: Words whose n-grams are hashed at once.
BLOCK = 1 << 17
#: Characters of a shape.
SHAPE = 8


def _any(c: str) -> bool:
    return c != "\n"


@functools.cache
def _kinds() -> np.ndarray:
    """What a code point is in a shape: A and a for letters by case, 0 for digits, else itself."""
    out = np.arange(0x110000, dtype=np.uint32)
    out[char_table(str.isalpha)] = ord("a")
    out[char_table(str.isalpha) & char_table(str.isupper)] = ord("A")
    out[char_table(str.isdecimal)] = ord("0")
    return out


def word_hashes(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and one of its shape: kinds of its characters, runs collapsed, SHAPE of them at most."""
    h = np.fromiter(map(xxhash.xxh32_intdigest, distinct), np.uint32, len(distinct))
    if not distinct:
        return h, h
    w = words(distinct, _any, lower=False)
    kind = _kinds()[w.chars]
    new = np.append(True, kind[1:] != kind[:-1])
    new[w.start] = True
    new[w.chars == 10] = False
    upto = np.append(0, np.cumsum(new))
    place = upto[:-1] - np.repeat(upto[w.start], np.diff(np.append(w.start, len(kind))))
    new &= place < SHAPE
    value = np.where(new, mix((kind.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))) * P1), np.uint64(0))
    shapes = np.add.reduceat(value, w.start)
    return h, (mix(shapes) >> np.uint64(32)).astype(np.uint32)


class Bag:
    """The hashed n-grams of a batch of whole texts."""

    def __init__(self, s: Stretches):
        self.sizes = s.sizes
        self._codes, (self._word, self._shape) = s.codes, word_hashes(s.distinct)
        self._ends = np.cumsum(s.sizes)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of words: the text of each, its bucket, and two rows of buckets of the pairs that start with it.

        A word that ends its text starts no pair: the bucket is BUCKETS.
        """
        for a in range(0, len(self._codes), BLOCK):
            at = self._codes[a : a + BLOCK + 1]
            n = min(BLOCK, len(self._codes) - a)
            w, s = self._word[at], self._shape[at]
            pairs = np.full((2, n), BUCKETS, np.int64)
            m = len(at) - 1
            pairs[0, :m] = (((w[:-1] * _M2) ^ w[1:]) * _M1) >> np.uint32(19)
            same = (w[:-1] == w[1:]) * np.uint32(0x5BD1E995)
            pairs[1, :m] = WORDS + ((((s[:-1] * _M2) ^ s[1:] ^ same) * _M1) >> np.uint32(22))
            last = self._ends[self.sizes > 0] - 1 - a
            pairs[:, last[(last >= 0) & (last < n)]] = BUCKETS
            text = np.searchsorted(self._ends, np.arange(a, a + n), "right")
            yield text, ((w[:n] * _M1) >> np.uint32(19)).astype(np.int64), pairs

    def counts(self, target: np.ndarray) -> np.ndarray:
        """n-grams by bucket, of all the texts and of those where ``target`` holds."""
        out = np.zeros((2, BUCKETS + 1), np.int64)
        for text, own, pairs in self.blocks():
            for k, some in enumerate((slice(None), target[text])):
                out[k] += np.bincount(own[some], minlength=BUCKETS + 1) + np.bincount(
                    pairs[:, some].ravel(), minlength=BUCKETS + 1
                )
        return out[:, :BUCKETS]

    def sums(self, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and the sum of ``ratio`` over them."""
        total, ratio = np.zeros(len(self.sizes)), np.append(ratio, 0.0)
        for text, own, pairs in self.blocks():
            value = ratio[own] + ratio[pairs[0]] + ratio[pairs[1]]
            total[text[0] : text[-1] + 1] += np.bincount(text - text[0], weights=value)
        return self.sizes + 2 * np.maximum(self.sizes - 1, 0), total


def count_models(df: DataFrame, text_col: str, target_col: str) -> np.ndarray:
    """n-gram counts over all rows and over rows where ``target_col`` holds: 2 x BUCKETS.

    Each task sums what it reads; the driver gets two vectors of fixed length.
    """
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums = np.zeros((2, BUCKETS), np.int64)
        for part in (p for batch in batches for p in slices(batch, 0)):
            target = part.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            sums += Bag(stretches(part.column(0))).counts(target)
        kind, bucket = np.nonzero(sums)
        if len(kind):
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[kind, bucket], pa.int64())],
                schema=schema
            )

    rows = df.select(text_col, target_col).mapInArrow(
        count, "kind int, bucket int, n long"
    ).groupBy("kind", "bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((2, BUCKETS))
    for kind, bucket, n in rows:
        out[kind, bucket] = n
    return out


def log_ratio(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw); words and shapes are separate models."""
    out = np.zeros(BUCKETS)
    for part in (slice(0, WORDS), slice(WORDS, BUCKETS)):
        raw, target = counts[0, part] + smooth, counts[1, part]
        # The target model backs off to the raw one, so rare buckets say little.
        target = target + smooth * len(target) * raw / raw.sum()
        out[part] = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return out


def labelled_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``__t`` (id) and ``__y`` (label 1) of each labelled id; an id with both labels has label 1."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("__t")).agg(F.max(F.col(label_col) == 1).alias("__y"))


def target_rows(ids: DataFrame, bound: int, seed: int) -> DataFrame:
    """About ``bound`` ids with label 1, chosen by their hash: a table of bounded size."""
    good = ids.filter("__y").select("__t")
    n = good.count()
    return good.filter(spread(F.col("__t"), seed=seed) < (bound / n if n > bound else 1.0))


def target_size(weighed: DataFrame, ids: DataFrame, id_col: str) -> int:
    """How many rows are like the target: their number at each magnitude of the weight times the share of label 1 there.

    A magnitude without labelled rows takes the share of the nearest that has some (of two, the
    larger); without any label, all rows are like the target.
    """
    at = (F.signum("log_weight") * F.floor(F.log2(1 + F.abs("log_weight")))).cast("int").alias("__at")
    counted = weighed.select(F.col(id_col).alias("__i"), at).groupBy("__i", "__at").agg(F.count("*").alias("__n"))
    rows = dict(map(tuple, counted.groupBy("__at").agg(F.sum("__n")).collect()))
    # Rows of one id are counted before they meet its label.
    known = counted.join(ids, F.col("__i") == F.col("__t")).groupBy("__at").agg(
        F.sum("__n"), F.sum(F.when(F.col("__y"), F.col("__n")).otherwise(0))
    ).collect()
    share = {k: good / n for k, n, good in known}
    size = sum(n * (share[min(share, key=lambda j: (abs(j - k), -j))] if share else 1) for k, n in rows.items())
    return math.ceil(round(size, 6))


def weigh(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 9,
    temperature: float = 1.0, carry: bool = False
) -> DataFrame:
    """id, ``n_grams``, ``log_weight`` (log of the ratio of the two models) and ``gumbel_key`` for each row.

    ``target``: one column of ids of bounded size; it is broadcast.  The key is the log weight plus
    ``temperature`` times Gumbel noise; at 1, the largest keys are a sample in proportion to the
    weights.  The noise depends on the id, the text and the seed alone, so a retried task draws the
    same numbers.  Without targets both models agree and all weights are 0.  With ``carry`` all
    columns of ``df`` come along; those of the three names above are replaced.
    """
    prepare(df.sparkSession)
    flagged = df.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__x")).join(
        F.broadcast(target.select(F.col(target.columns[0]).alias("__t"), F.lit(True).alias("__target"))),
        F.col("__i") == F.col("__t"), "left"
    )
    counts = count_models(flagged, "__x", "__target")
    ratio = df.sparkSession.sparkContext.broadcast(log_ratio(counts) if counts[1].any() else np.zeros(BUCKETS))
    added = ("n_grams", "log_weight", "gumbel_key")
    kept = [c for c in df.columns if c not in (*added, "selected")] if carry else [id_col]
    rows = df.select(*kept, F.col(id_col).cast("string").alias("__i"), F.col(text_col).alias("__x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        r = ratio.value
        for part in (p for batch in batches for p in slices(batch, len(kept) + 1)):
            ids, texts = part.column(len(kept)).to_pylist(), part.column(len(kept) + 1)
            n, weight = Bag(stretches(texts)).sums(r)
            h = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{i}:{t or ''}") for i, t in zip(ids, texts.to_pylist())], np.uint64)
            u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[: len(kept)], pa.array(n, pa.int64()), pa.array(weight),
                    pa.array(weight - temperature * np.log(-np.log(u)))
                ],
                names=[*kept, *added]
            )

    schema = StructType([df.schema[c] for c in kept]).add("n_grams", "long").add("log_weight", "double").add("gumbel_key", "double")
    return rows.mapInArrow(run, schema)


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column, exactly, without sorting it anywhere.

    Each pass counts the values of one interval in ``bins`` parts; the interval that holds the
    k-th shrinks by that factor until all values in it are equal.
    """
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k >= n:
        return low
    left = k
    while low < high:
        width = (high - low) / bins
        if low + width <= low:
            break
        inside = df.filter(F.col(col).between(low, high))
        part = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1))
        for row in sorted(
            inside.groupBy(part.alias("p")).agg(
                F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")
            ).collect(),
            key=lambda r: -r["p"]
        ):
            if left <= row["n"]:
                low, high = row["lo"], row["hi"]
                break
            left -= row["n"]
        else:
            break
    return high


def resample(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    target_docs: int = 6000, k: int | None = None, seed: int = 9, temperature: float = 1.0, carry: bool = False
) -> DataFrame:
    """``weigh`` plus ``selected``: whether the row is among the Gumbel top-k.

    k defaults to the number of rows that are like the target (``target_size``).  At most about
    ``target_docs`` ids labelled 1 train the target model.  Without any such id all weights are 0
    and, unless ``k`` says otherwise, every row is kept.  Null and empty texts have weight 0.
    Rows with equal keys (repeated rows) are kept or go together, so the count may pass k by as many.
    """
    ids = labelled_ids(labels, id_col, label_col)
    weighed = stored(weigh(df, target_rows(ids, target_docs, seed), id_col, text_col, seed, temperature, carry), "weights")
    if k is None:
        k = target_size(weighed, ids if ids.filter("__y").limit(1).count() else ids.limit(0), id_col)
    cut = kth_largest(weighed, "gumbel_key", k) if k else float("inf")
    return weighed.withColumn("selected", F.col("gumbel_key") >= F.lit(cut))


def op9_quality(spark, sf_dir):
    """Query: every document with its weight, key and decision."""
    return resample(docs(spark, sf_dir), docs(spark, sf_dir, "labels"))
