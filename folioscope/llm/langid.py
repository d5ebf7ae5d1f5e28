"""Language identification by words first, backing off to shorter and shorter character n-grams.

A word that training saw is scored by its log frequency in each language.  Another word is read
left to right as character n-grams: at each place the longest n-gram that training saw counts.
A word is a run of letters (``str.isalpha``) of the lower-case text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import P1, Lookup, Stretches, Words, mix, ranges, stretches, word_keys, words
from .common import docs, fold, map_arrow, prepare, release, resident, slices, spread

LONGEST = 4
BORDER = 32
#: Words that a task counts before it hands its counts on.
KEPT = 100_000


def grams(word: str) -> list[str]:
    """Every n-gram of the bordered word, of 1 to LONGEST characters."""
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w)) for n in range(1, LONGEST + 1) if i + n <= len(w)]


def _gram_keys(chars: np.ndarray) -> list[np.ndarray]:
    """Keys of the n-grams that start at each character, for n of 1 to LONGEST; those that run over the end are cut."""
    x, out = chars.astype(np.uint64), []
    key = np.zeros(len(x), np.uint64)
    for n in range(1, LONGEST + 1):
        m = max(len(x) - n + 1, 0)
        key = mix(key[:m] * P1 + x[n - 1 :] + np.uint64(n))
        out.append(key)
    return out


def _key_of(s: str) -> np.uint64:
    return _gram_keys(np.frombuffer(s.encode("utf-32-le"), np.uint32))[len(s) - 1][0]


class LanguageModel:
    """Log frequencies of words and n-grams by language.

    counts: (language, "w" or "g", string) to number of occurrences.  ``words`` and ``grams`` are
    pairs of keys and rows (a column for each language); rows are centred over the languages.
    """

    def __init__(self, counts: dict[tuple[str, str, str], int], smooth: float = 0.5):
        self.langs = sorted({k[0] for k in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        tables: dict[object, dict[str, np.ndarray]] = {}
        for (lang, kind, s), n in counts.items():
            table = tables.setdefault("w" if kind == "w" else len(s), {})
            table.setdefault(s, np.zeros(len(at)))[at[lang]] += n
        none = np.zeros(0, np.uint64), np.zeros((0, len(at)), np.float32)
        self.words, found = none, [none]
        for kind, table in tables.items():
            rows = np.stack(list(table.values())) + smooth
            rows = np.log(rows / rows.sum(0))
            rows = (rows - rows.mean(1, keepdims=True)).astype(np.float32)
            if kind == "w":
                self.words = word_keys(words(list(table), str.isalpha, lower=False)), rows
            else:
                found.append((np.array([_key_of(s) for s in table], np.uint64), rows))
        self.grams = np.concatenate([k for k, _ in found]), np.concatenate([r for _, r in found])


class Scorer:
    """Scores of batches of whole texts."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._words, self._grams = Lookup(model.words[0]), Lookup(model.grams[0])
        # The last row is for what training did not see.
        self._rows = np.concatenate([model.grams[1], np.zeros((1, len(model.langs)), np.float32)])

    def word_rows(self, w: Words) -> np.ndarray:
        """Scores by language of each word."""
        known = self._words.find(word_keys(w))
        out = np.zeros((len(known), len(self.model.langs)), np.float32)
        out[known >= 0] = self.model.words[1][known[known >= 0]]
        new = np.nonzero(known < 0)[0]
        if len(new):
            out[new] = self._back_off(w.chars, w.start[new], w.end[new])
        return out

    def _back_off(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mean row of the longest known n-gram at each place of each bordered word but its last border."""
        size = end - start + 2
        first = np.cumsum(size) - size
        x = np.full(int(size.sum()), BORDER, np.uint32)
        x[ranges(first + 1, size - 2)] = chars[ranges(start, size - 2)]
        left = -ranges(-size, size)  # characters from here to the end of the word, this one included
        keys = _gram_keys(x)
        row = np.full(len(x), -1, np.int32)
        for n in range(LONGEST, 0, -1):
            at = np.nonzero((row < 0) & (left >= max(n, 2)))[0]
            at = at[at < len(keys[n - 1])]
            row[at] = self._grams.find(keys[n - 1][at])
        total = np.add.reduceat(self._rows[row], first, axis=0)
        return total / np.maximum(np.add.reduceat(row >= 0, first), 1)[:, None].astype(np.float32)

    def scores(self, s: Stretches) -> tuple[np.ndarray, np.ndarray]:
        """Summed scores by language and the number of words, for each text."""
        w = words(s.distinct, str.isalpha)
        both = np.concatenate([self.word_rows(w), np.ones((len(w.start), 1), np.float32)], axis=1)
        total = s.text_sums(w.per_stretch(both))
        return total[:, :-1], total[:, -1].astype(np.int64)

    def predict(self, s: Stretches) -> tuple[list[str], np.ndarray]:
        """For each text the best language (first by name among equals) and its share after a softmax over at most 50 mean words; ``und`` with 0 if there is no letter."""
        total, n = self.scores(s)
        if not self.model.langs:
            return ["und"] * len(n), np.zeros(len(n))
        z = total / np.maximum(n, 1)[:, None] * np.minimum(n, 50)[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        best = p.argmax(1)
        share = p.max(1) / p.sum(1)
        return [self.model.langs[b] if k else "und" for b, k in zip(best.tolist(), n.tolist())], np.where(n > 0, share, 0.0)


def _counted(texts: pa.Array, own: Counter) -> None:
    """Add the words of some texts to a count."""
    s = stretches(texts)
    w = words(s.distinct, str.isalpha)
    times = np.bincount(s.codes, minlength=len(s.distinct))[w.owner]
    for word, n in zip(w.strings(), times.tolist()):
        own[word] += n


def _grams_of(own: Counter) -> Counter:
    """The n-grams of counted words."""
    g: Counter = Counter()
    for word, n in own.items():
        for x in grams(word):
            g[x] += n
    return g


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_per_lang: int | None = 1500, max_words: int = 60_000, max_grams: int = 60_000, max_langs: int = 500, seed: int = 5
) -> LanguageModel:
    """Fit on a bounded sample of labelled rows: about ``docs_per_lang`` whole texts a language, or on all where it is None.

    Rows with null text or language teach nothing.  Texts are drawn by a hash of id and text.  The
    ``max_langs`` languages with most rows are learned (ties go by name), and of each the
    ``max_words`` words and ``max_grams`` n-grams that occur most (ties go by the string).  So what
    reaches the driver has a fixed bound, and no language crowds out another.
    """
    df = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")
    )
    share = {
        r["l"]: min(1.0, (docs_per_lang or r["n"]) / r["n"]) for r in df.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(max_langs).collect()
    }
    if not share:
        return LanguageModel({})
    keep = F.create_map([F.lit(x) for pair in share.items() for x in pair])
    sample = df.filter(
        spread(F.col("i"), F.col("t"), seed=seed) < F.coalesce(F.try_element_at(keep, F.col("l")), F.lit(0.0))
    ).select("l", "t")
    schema = pa.schema([("l", pa.string()), ("kind", pa.string()), ("s", pa.string()), ("n", pa.int64())])

    def rows(lang: str, kind: str, counter: Counter) -> Iterator[pa.RecordBatch]:
        strings, times = list(counter), list(counter.values())
        for a in range(0, len(strings), 10_000):
            m = len(strings[a : a + 10_000])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * m), pa.array([kind] * m), pa.array(strings[a : a + m], pa.string()),
                    pa.array(times[a : a + m], pa.int64())
                ],
                schema=schema
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kept: dict[str, Counter] = {}
        for part in (p for b in batches for p in slices(b, 1)):
            for lang in part.column(0).unique().to_pylist():
                _counted(part.filter(pc.equal(part.column(0), lang)).column(1), kept.setdefault(lang, Counter()))
            if sum(map(len, kept.values())) > KEPT:
                for lang, own in kept.items():
                    yield from rows(lang, "w", own)
                kept = {}
        for lang, own in kept.items():
            yield from rows(lang, "w", own)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of all texts together, so that the n-grams of each are made once; a word that occurs once goes no further itself."""
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, schema=schema).filter(pc.greater(batch.column(3), 1))
            kept: dict[str, Counter] = {}
            for lang, word, n in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                kept.setdefault(lang, Counter())[word] = n
            for lang, own in kept.items():
                yield from rows(lang, "g", _grams_of(own))

    once = sample.mapInArrow(
        count, "l string, kind string, s string, n long"
    ).groupBy("l", "kind", "s").agg(F.sum("n").alias("n"))
    counted = once.mapInArrow(
        expand, "l string, kind string, s string, n long"
    ).groupBy("l", "kind", "s").agg(F.sum("n").alias("n")).filter("n > 1")
    place = F.row_number().over(Window.partitionBy("l", "kind").orderBy(F.desc("n"), "s"))
    top = counted.withColumn("place", place).filter(
        F.col("place") <= F.when(F.col("kind") == "w", max_words).otherwise(max_grams)
    ).select("l", "kind", "s", "n")
    return LanguageModel({(lang, kind, s): n for lang, kind, s, n in sorted(map(tuple, top.collect()))})


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``lang_pred`` and ``score`` for each row, from the text alone; no shuffle."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(ids: pa.Array, texts: pa.Array) -> list:
        return [ids, *scorer_of(shared.value).predict(stretches(texts))]

    id_type = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"{id_col} {id_type}, lang_pred string, score double", keeps=True)


def scorer_of(model: LanguageModel) -> Scorer:
    """One scorer for each worker process."""
    return resident(model, lambda: Scorer(model))


def identify(
    df: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    **fit_options
) -> DataFrame:
    """Learn from the rows where ``learn`` holds (all by default), predict for all rows.

    Returns id, ``lang_pred``, ``score``.  Null or letterless text is ``und`` with score 0, and so
    is everything if no row has a language.  Repeated and null ids pass through; other columns
    are not read.
    """
    prepare(df.sparkSession)
    model = fit(df if learn is None else df.filter(learn), id_col, text_col, lang_col, **fit_options)
    return predict(df, model, id_col, text_col)


def op5_langid(spark, sf_dir):
    """Query: language of every document; learns from three of four folds."""
    df = docs(spark, sf_dir)
    out = identify(df, fold("doc_id", 4) != 2)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
