"""Toxicity by a convolutional text classifier, trained in numpy where the texts are.

A word (a run of letters and digits of the lower-case text) is the mean of the embeddings in three
hashed buckets.  Filters of several widths slide over the words of a whole text, each keeps its
largest response, and a logistic layer reads those.  The first embedding dimension starts as each
bucket's log odds over the training texts; training then adjusts everything.  Thresholds are
calibrated for each language, and the language is read from the text itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import langid
from .batches import Stretches, Words, ranges, stretches, words
from .common import docs, drop_stored, fold, map_arrow, prepare, release, resident, stored
from .jaccard import id_filter

BUCKETS, HASHES, DIM = 1 << 16, 3, 8
WIDTHS, FILTERS = (1, 2, 3), 6
DECISION = 0.7
#: Places that are scored at once, so that memory does not follow the longest text.
BLOCK = 1 << 16
#: Numbers of a sum in one row, and rows that are added at once.
PART, FAN = 1 << 14, 64
#: Steps of the logit that a threshold may fall between, to a unit.
GRID = 64
#: Bytes of lessons that change places with each other from round to round.
MIXED = 1 << 22


def buckets(strings: list[str]) -> np.ndarray:
    """Three buckets of each word: 16-bit parts of its hash."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))
    return np.stack([(h >> np.uint64(16 * k)) & np.uint64(BUCKETS - 1) for k in range(HASHES)], axis=1).astype(np.uint16)


def word_places(s: Stretches, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The word that stands at each place, text after text, and the number of words of each text."""
    count = w.counts()
    first = np.cumsum(count) - count
    at = ranges(first[s.codes], count[s.codes])
    ends = np.append(0, np.cumsum(count[s.codes]))[np.cumsum(s.sizes)]
    return at, np.diff(np.append(0, ends))


@dataclass
class ConvModel:
    """Weights; ``filters[w]`` has shape (w, DIM, FILTERS)."""

    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    langs: langid.LanguageModel | None = None

    def responses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter over word vectors x, and where; texts shorter than a filter are padded with zeros."""
        best, where = [], []
        for w in WIDTHS:
            if len(x) < w:
                x = np.concatenate([x, np.zeros((w - len(x), DIM), x.dtype)])
            n = len(x) - w + 1
            z = sum(x[j : j + n] @ self.filters[w][j] for j in range(w)) + self.bias[w]
            at = z.argmax(0)
            best.append(z[at, np.arange(FILTERS)])
            where.append(at)
        return np.concatenate(best), np.concatenate(where)


def _init(seen: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> ConvModel:
    """seen: texts with each bucket, by label; n: texts of each label."""
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    # A bucket that few texts have says little.
    odds *= seen.sum(0) / (seen.sum(0) + 10)
    embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    embed[:, 0] = odds
    filters, bias = {}, {}
    for w in WIDTHS:
        f = rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32)
        f[0, 0, 0] = 1.0
        filters[w], bias[w] = f, np.full(FILTERS, -0.5, np.float32)
    out = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
    out[0] = 1.0
    return ConvModel(embed, filters, bias, out, float(np.log((n[1] + 1) / (n[0] + 1))))


def _forward(model: ConvModel, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``responses`` of a text of any length, BLOCK places at a time."""
    best = where = None
    widest = max(WIDTHS)
    for a in range(0, max(len(h) - widest + 1, 1), BLOCK):
        own = h[a : a + BLOCK + widest - 1]
        z, at = model.responses(model.embed[own].mean(1) if len(own) else np.zeros((1, DIM), np.float32))
        if best is None:
            best, where = z, at
        else:
            where, best = np.where(z > best, at + a, where), np.maximum(z, best)
    return best, where


def teach(model: ConvModel, lessons: Iterable[tuple[np.ndarray, int]], weight: np.ndarray, rate: float = 0.05) -> np.ndarray:
    """Adagrad on the logistic loss, one text (the buckets of its words) at a time; the model changes in place.

    weight: of each label.  Returns which rows of the embeddings changed.
    """
    sums: dict[str, np.ndarray] = {}
    changed = np.zeros(BUCKETS, bool)

    def update(name: str, array: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        acc = sums.setdefault(name, np.full(array.shape, 0.1, np.float32))
        acc[rows] += grad * grad
        array[rows] -= (rate * grad / np.sqrt(acc[rows])).astype(np.float32)

    base = np.array([model.base], np.float32)
    for h, y in lessons:
        z, where = _forward(model, h)
        a = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-np.clip(float(a @ model.out) + float(base[0]), -30, 30)))
        g = (p - y) * weight[y]
        if abs(g) < 1e-3:
            continue
        back = g * model.out * (z > 0)
        update("out", model.out, (g * a).astype(np.float32))
        update("base", base, np.array([g], np.float32))
        for i, w in enumerate(WIDTHS):
            part = slice(i * FILTERS, (i + 1) * FILTERS)
            gb, at = back[part], where[part]
            if not gb.any():
                continue
            grad = np.zeros_like(model.filters[w])
            touched: dict[int, np.ndarray] = {}
            for f in np.nonzero(gb)[0]:
                for j in range(w):
                    t = at[f] + j
                    if t < len(h):
                        grad[j, :, f] = gb[f] * model.embed[h[t]].mean(0)
                        touched[t] = touched.get(t, 0) + gb[f] * model.filters[w][j, :, f] / HASHES
            update(f"f{w}", model.filters[w], grad)
            update(f"b{w}", model.bias[w], gb.astype(np.float32))
            for t, ge in touched.items():
                update("e", model.embed, np.tile(ge.astype(np.float32), (HASHES, 1)), h[t])
                changed[h[t]] = True
    model.base = float(base[0])
    return changed


def _dense(model: ConvModel) -> np.ndarray:
    """All weights but the embeddings."""
    parts = [*(model.filters[w].ravel() for w in WIDTHS), *(model.bias[w] for w in WIDTHS), model.out, [model.base]]
    return np.concatenate(parts).astype(np.float64)


def _moved(model: ConvModel, embed: np.ndarray, dense: np.ndarray) -> ConvModel:
    """A copy with changes added."""
    at, new = 0, []
    for old in (*(model.filters[w] for w in WIDTHS), *(model.bias[w] for w in WIDTHS), model.out, np.array([model.base])):
        new.append((old + dense[at : at + old.size].reshape(old.shape)).astype(old.dtype))
        at += old.size
    k = len(WIDTHS)
    return ConvModel(
        (model.embed + embed).astype(np.float32), dict(zip(WIDTHS, new[:k])), dict(zip(WIDTHS, new[k : 2 * k])),
        new[2 * k], float(new[2 * k + 1][0])
    )


_PARTS = pa.schema([("r", pa.int32()), ("salt", pa.int32()), ("blob", pa.binary())])


def _parts(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's share of a sum, in parts; those of zeros only are left out."""
    salt = TaskContext.get().partitionId()
    for r in range(-(-len(values) // PART)):
        own = values[r * PART : (r + 1) * PART]
        if own.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([r], pa.int32()), pa.array([salt], pa.int32()), pa.array([own.tobytes()], pa.binary())], schema=_PARTS
            )


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The tasks' shares added up, level by level, FAN of them at a time and always in the same order."""

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("salt").to_pylist(), table.column("blob").to_pylist()))
        total = np.sum([np.frombuffer(blob, np.float64) for _, blob in rows], axis=0)
        return pa.table(
            {"r": table.column("r")[:1], "salt": pa.array([rows[0][0] // FAN], pa.int32()), "blob": pa.array([total.tobytes()], pa.binary())}
        )

    for _ in range(2):
        parts = parts.groupBy("r", F.floor(F.col("salt") / FAN)).applyInArrow(add, "r int, salt int, blob binary")
    out = np.zeros(size)
    for row in parts.groupBy("r").applyInArrow(add, "r int, salt int, blob binary").collect():
        own = np.frombuffer(row["blob"], np.float64)
        out[row["r"] * PART : row["r"] * PART + len(own)] = own
    return out


class Scorer:
    """Scores of batches of whole texts."""

    def __init__(self, model: ConvModel):
        self.model = model
        self._flat = np.concatenate([model.filters[w][j] for w in WIDTHS for j in range(w)], axis=1)
        self._langs = langid.Scorer(model.langs) if model.langs else None

    def best(self, h: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Largest response of each filter (without its bias) for each text.

        h: buckets of the distinct words; at: which word stands at each place; sizes: words of
        each text.  A text is followed by places of zeros, so that it is as long as the widest filter.
        """
        widest = max(WIDTHS)
        rows = np.concatenate([self.model.embed[h].mean(1) @ self._flat, np.zeros((1, self._flat.shape[1]), np.float32)])
        start = np.cumsum(sizes + widest - 1) - (sizes + widest - 1)
        places = np.full(int((sizes + widest - 1).sum()) + widest, len(h), np.int64)
        places[ranges(start, sizes)] = at
        out = np.full((len(sizes), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for a in range(0, len(places) - widest, BLOCK):
            b = min(a + BLOCK, len(places) - widest)
            p = rows[places[a : b + widest - 1]]
            first = int(np.searchsorted(start, a, "right")) - 1
            last = int(np.searchsorted(start, b, "left"))
            own = np.arange(first, last)
            cuts = np.maximum(start[own], a) - a
            col = 0
            for i, w in enumerate(WIDTHS):
                z = p[: b - a, col : col + FILTERS].copy()
                for j in range(1, w):
                    z += p[j : b - a + j, col + j * FILTERS : col + (j + 1) * FILTERS]
                col += w * FILTERS
                # No filter starts so late that only what follows the text fills it up.
                ends = start[own] + np.maximum(sizes[own] - w + 1, 1)
                late = ranges(ends, start[own] + sizes[own] + widest - 1 - ends)
                z[late[(late >= a) & (late < b)] - a] = -np.inf
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                out[own, part] = np.maximum(out[own, part], np.maximum.reduceat(z, cuts, axis=0))
        return out

    def probabilities(self, best: np.ndarray) -> np.ndarray:
        m = self.model
        a = np.maximum(best + np.concatenate([m.bias[w] for w in WIDTHS]), 0)
        return 1 / (1 + np.exp(-np.clip((a * m.out).sum(1, dtype=np.float64) + m.base, -30, 30)))

    def raw(self, s: Stretches) -> np.ndarray:
        """The classifier's probability for each text before calibration."""
        w = words(s.distinct, str.isalnum)
        return self.probabilities(self.best(buckets(w.strings()), *word_places(s, w)))

    def score(self, s: Stretches) -> np.ndarray:
        """Probabilities moved so that the language's threshold falls on DECISION."""
        raw, m = self.raw(s), self.model
        t = np.full(len(raw), m.threshold)
        if m.thresholds and self._langs:
            t = np.array([m.thresholds.get(lang, m.threshold) for lang in self._langs.predict(s)[0]])
        return np.where(raw < t, DECISION * raw / t, DECISION + (1 - DECISION) * (raw - t) / (1 - t))


def _cut(counts: dict[int, list[int]]) -> float:
    """The threshold, midway between two steps of GRID that occur, with the best F1 (the highest among equals).

    counts: texts of label 0 and 1 at each step of the logit.
    """
    steps = sorted(counts, reverse=True)
    n = np.array([counts[k] for k in steps], np.float64)
    f1 = 2 * np.cumsum(n[:, 1]) / (np.cumsum(n.sum(1)) + n[:, 1].sum())
    k = int(np.argmax(f1))
    low = steps[k + 1] + 1 if k + 1 < len(steps) else steps[k] - GRID
    at = 1 / (1 + np.exp(-(steps[k] + low) / 2 / GRID))
    return float(min(max(at, 1e-4), 1 - 1e-4))


def _lessons(
    df: DataFrame, lab: DataFrame, langs: Broadcast, held: Callable[[Column], Column], id_col: str, text_col: str,
    max_words: int | None, shards: int, seed: int
) -> tuple[DataFrame, Broadcast]:
    """``s``, ``y``, ``held``, ``lang`` (of held texts) and ``h``, the buckets of the words, of each text that ``lab`` (i, y) has a label for.

    Rows that repeat an id and its words are one text.  Texts are not shuffled: a bitmap of hashed ids lets those with
    labels through, and few others, and only buckets meet the labels, once: where the shard ``s`` is partition s, in an
    order that the ids alone decide.  Also the broadcast that is read.
    """
    bitmap, bits = id_filter(lab.select("i"))
    shared = df.sparkSession.sparkContext.broadcast(np.frombuffer(bitmap, np.uint8))
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("x")).filter("i is not null and x is not null")

    def read(i: pa.Array, texts: pa.Array, calibrates: pa.Array, at: pa.Array) -> list:
        at = at.to_numpy(zero_copy_only=False)
        wanted = pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool))
        texts, calibrates = texts.filter(wanted), calibrates.filter(wanted)
        s = stretches(texts)
        w = words(s.distinct, str.isalnum)
        place, sizes = word_places(s, w)
        h, ends = buckets(w.strings())[place], np.cumsum(sizes)
        blobs = [
            h[e - k : e].tobytes() if max_words is None or k <= max_words else None for e, k in zip(ends.tolist(), sizes.tolist())
        ]
        named = iter(langid.scorer_of(langs.value).predict(stretches(texts.filter(calibrates)))[0])
        return [
            i.filter(wanted), calibrates, [next(named) if c else None for c in calibrates.to_pylist()], blobs,
            [None if b is None else xxhash.xxh3_128_digest(b) for b in blobs]
        ]

    kind = df.schema[id_col].dataType.simpleString()
    got = map_arrow(
        rows.select("i", "x", held(F.col("i")).alias("held"), F.pmod(F.xxhash64("i"), F.lit(bits)).alias("at")), read,
        f"i {kind}, held boolean, lang string, h binary, d binary", keeps=True
    )
    both = got.filter("h is not null").unionByName(lab, allowMissingColumns=True)
    dealt = both.withColumn("s", F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(shards)).cast("int")).repartitionById(
        shards, F.col("s")
    ).sortWithinPartitions("s", F.xxhash64("i", F.lit(seed + 1)), "i", F.desc_nulls_last("y"), "d")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of an id, the label comes first; texts follow, equal ones together."""
        release()
        at = y = last = None
        for batch in batches:
            own, labels = [], []
            for k, (i, label, d) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("i", "y", "d")))):
                if label is not None:
                    at, y, last = i, label, None
                elif i == at and d != last:
                    last = d
                    own.append(k)
                    labels.append(y)
            s, calibrates, lang, h = (batch.column(c).take(pa.array(own, pa.int32())) for c in ("s", "held", "lang", "h"))
            yield pa.RecordBatch.from_arrays([s, pa.array(labels, pa.int32()), calibrates, lang, h], names=["s", "y", "held", "lang", "h"])

    return dealt.mapInArrow(meet, "s int, y int, held boolean, lang string, h binary"), shared


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    lang_col: str = "lang", max_words: int | None = None, rounds: int = 3, shard: int = 4000, least: int = 25,
    seed: int = 3
) -> ConvModel:
    """Train on all labelled texts but every fifth by a hash of the id; those calibrate.

    Texts are dealt into shards of about ``shard`` by a hash of the id, once, and written.  In a round each shard goes on
    from the same model, text after text in an order of its own, and the changes are averaged: of an embedding over the shards
    that changed it, of other weights over all.  The first embedding starts from counts of all training texts, and
    thresholds are read from counts of all calibrating ones at steps of the logit.  So only sums of fixed size
    reach the driver.  Languages are learned from all rows that have one.  Rows with null text, id or label teach nothing, nor, where
    ``max_words`` is set, do longer texts; rows that repeat an id and its words teach once; an id with both labels
    has label 1.  A language with fewer than ``least`` calibration texts of either label takes the threshold
    of all.  Without both labels every score is all but 0 and nothing is toxic.
    """
    spark = prepare(df.sparkSession)
    sc = spark.sparkContext
    kind = df.schema[id_col].dataType.simpleString()
    lab = labels.filter(
        F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()
    ).groupBy(F.col(id_col).cast(kind).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    if len(n) < 2:
        none = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        return ConvModel(
            np.zeros((BUCKETS, DIM), np.float32), {w: np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS},
            {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, none, -30.0
        )
    langs = langid.fit(df, id_col, text_col, lang_col, docs_per_lang=None, max_words=20_000, max_grams=20_000)
    shared = sc.broadcast(langs)
    found, bitmap = _lessons(
        df, lab, shared, lambda i: F.crc32(F.concat(F.lit(f"{seed}:"), i.cast("string")).cast("binary")) % 5 == 0, id_col,
        text_col, max_words, max(1, -(-sum(n.values()) // shard)), seed
    )
    rows = stored(found, "lessons")
    for read in (shared, bitmap):
        read.destroy()
    model = _trained(rows.filter("not held"), rounds, seed)
    model.langs = langs
    own = sc.broadcast(model)

    def steps(y: pa.Array, lang: pa.Array, h: pa.Array) -> list:
        scorer, raw = Scorer(own.value), []
        for blob in h.to_pylist():
            x = np.frombuffer(blob, np.uint16).reshape(-1, HASHES)
            raw.append(scorer.probabilities(scorer.best(x, np.arange(len(x)), np.array([len(x)]))))
        p = np.concatenate(raw) if raw else np.zeros(0)
        return [y, lang, np.floor(np.log(p / (1 - p)) * GRID).astype(np.int32)]

    counted = map_arrow(rows.filter("held").select("y", "lang", "h"), steps, "y int, lang string, step int", text=2)
    every: dict[int, list[int]] = {}
    by_lang: dict[str, dict[int, list[int]]] = {}
    for r in counted.groupBy("lang", "step", "y").count().collect():
        for counts in (every, by_lang.setdefault(r["lang"], {})):
            counts.setdefault(r["step"], [0, 0])[r["y"]] += r["count"]
    own.destroy()
    drop_stored(rows)
    of = lambda counts, y: sum(c[y] for c in counts.values())
    if of(every, 0) and of(every, 1):
        model.threshold = _cut(every)
        model.thresholds = {name: _cut(c) for name, c in sorted(by_lang.items()) if min(of(c, 0), of(c, 1)) >= least}
    return model


def _mixed(texts: Iterator[tuple[np.ndarray, int]], seed: int) -> Iterator[tuple[np.ndarray, int]]:
    """The texts in another order: as many as fill MIXED bytes (one at least) change places with each other."""
    rng, held, size = np.random.default_rng(seed), [], 0
    for text in texts:
        held.append(text)
        size += text[0].nbytes
        if size >= MIXED:
            yield from (held[k] for k in rng.permutation(len(held)))
            held, size = [], 0
    yield from (held[k] for k in rng.permutation(len(held)))


def _trained(rows: DataFrame, rounds: int, seed: int) -> ConvModel:
    """The model after some rounds over all texts of ``rows`` (s, y, h), which holds shard after shard.

    Rounds read it as it was written, without a shuffle.  A file is a shard, and a row group of it (128 MB, unless the
    session says otherwise) comes to one task whole; of a larger shard each such part may be taught as a shard.
    """
    sc = rows.sparkSession.sparkContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen = np.zeros((2, BUCKETS + 1))
        for batch in batches:
            for y, blob in zip(*(c.to_pylist() for c in batch.columns)):
                seen[y, np.unique(np.frombuffer(blob, np.uint16))] += 1
                seen[y, BUCKETS] += 1
        yield from _parts(seen.ravel())

    seen = _summed(rows.select("y", "h").mapInArrow(count, "r int, salt int, blob binary"), 2 * (BUCKETS + 1))
    seen = seen.reshape(2, BUCKETS + 1)
    n = seen[:, BUCKETS]
    model = _init(seen[:, :BUCKETS], n, np.random.default_rng(seed))
    weight = n.sum() / (2 * np.maximum(n, 1))
    cells, dense = BUCKETS * DIM, len(_dense(model))
    for k in range(rounds if n.sum() else 0):
        shared = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], seed: int = seed + k) -> Iterator[pa.RecordBatch]:
            """Changes summed over the task's shards, and their number last."""
            release()
            before, sums = shared.value, np.zeros(cells + BUCKETS + dense + 1)
            texts = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
            for _, shard in itertools.groupby(texts, lambda row: row[0]):
                own = _moved(before, np.zeros((1, 1)), np.zeros(dense))
                lessons = ((np.frombuffer(blob, np.uint16).reshape(-1, HASHES), y) for _, y, blob in shard)
                changed = teach(own, _mixed(lessons, seed), weight)
                sums[:cells] += (own.embed.astype(np.float64) - before.embed).ravel()
                sums[cells : cells + BUCKETS] += changed
                sums[cells + BUCKETS : -1] += _dense(own) - _dense(before)
                sums[-1] += 1
            yield from _parts(sums)

        total = _summed(
            rows.select("s", "y", "h").mapInArrow(run, "r int, salt int, blob binary"), cells + BUCKETS + dense + 1
        )
        shared.destroy()
        by = np.maximum(total[cells : cells + BUCKETS], 1)[:, None]
        model = _moved(model, total[:cells].reshape(BUCKETS, DIM) / by, total[cells + BUCKETS : -1] / total[-1])
    return model


def score(df: DataFrame, model: ConvModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``score`` and ``predicted`` for each row, from the text alone; no shuffle.

    A null or empty text has no words and scores as such.  Repeated and null ids pass through.
    """
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(ids: pa.Array, texts: pa.Array) -> list:
        model = shared.value
        s = resident(model, lambda: Scorer(model)).score(stretches(texts))
        return [ids, s, (s >= DECISION).astype(np.int32)]

    id_type = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"{id_col} {id_type}, score double, predicted int", keeps=True)


def classify(df: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """Train on labels of the rows where ``learn`` (over the id) holds, score all rows."""
    prepare(df.sparkSession)
    known = (labels, df) if learn is None else (labels.filter(learn), df.filter(learn))
    return score(df, fit(known[1], known[0], id_col=id_col, **options), id_col, options.get("text_col", "text"))


def op3_toxicity(spark, sf_dir):
    """Query: every document scored; labels come from two of three folds."""
    df, labels = docs(spark, sf_dir), docs(spark, sf_dir, "labels")
    out = classify(df, labels, fold("doc_id", 3) != 1)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
