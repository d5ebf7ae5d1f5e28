"""Exact n-gram Jaccard join: a prefix-filter join over groups of similar documents.

A document's set is its distinct word shingles.  Documents with equal sets are one representative.
Similar representatives are partitioned into groups: those that share a band of min-wise values meet in
chunks, where all are compared, and some of each cluster are compared with all its chunks; what links
up is a group.  The token-group matrix then says which groups hold a token in a prefix.  A document is a query against every other group that shares
one of the tokens of its prefix (the rarest ones; two sets can't be similar enough without sharing one of those), if lengths and the
places of the token allow it.  That alone decides which groups are opened.  Groups are held in chunks; a chunk's token
union is built where its sets have arrived, and spares queries whose overlap with it is too small.  Others are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import mix, stretches
from .common import docs, drop_stored, map_arrow, prepare, release, slices, stored
from .components import components

_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
#: Counters of the frequency sketch (a fixed size, whatever the input) in blocks of 2^16.
SKETCH_BITS, BLOCK = 24, 1 << 16
#: Parts of the sketch that are summed at once.
FAN = 64
#: Parts in which the classes reach the driver.
FETCHES = 8
#: Documents and tokens in a chunk of a group (one longer document is a chunk's all), and queries that one copy of it answers.
CHUNK, CHUNK_TOKENS, CHUNK_QUERIES = 256, 1 << 20, 4096
#: Bands by which representatives are grouped, and min-wise values of a band.
BANDS, BAND = 4, 3
#: Documents of a cluster that are compared with all its chunks.
LEADERS = 8
_BOUNDS = np.arange(BANDS * BAND, dtype=np.uint64) * np.uint64((1 << 64) // (BANDS * BAND))


def _shingles(w: np.ndarray, k: int) -> np.ndarray:
    n = max(len(w) - k + 1, 0)
    h = w[:n] * _P[0]
    for j in range(1, k):
        h = mix(h) * _P[j % 5] + w[j : j + n]
    return mix(h + np.uint64(k))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of whole texts; A-Z is lowered, words end at ASCII white space."""
    s = stretches(texts, ascii=True)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, s.distinct), np.uint64, len(s.distinct))[s.codes]
    every, out, at = _shingles(w, size), [], 0
    for n in s.sizes.tolist():
        h = np.sort(every[at : at + n - size + 1] if n >= size else _shingles(w[at : at + n], n))
        out.append(h[np.append(True, h[1:] != h[:-1])] if len(h) else h)
        at += n
    return out


def needed(n: int, percent: int) -> int:
    """Least overlap with any similar set of a set of n."""
    return -(-percent * n // 100)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def band_keys(s: np.ndarray) -> list[int]:
    """One key for each band, from the smallest shingle of each of BANDS * BAND equal parts of the hash space (or the next larger one)."""
    v = s[np.minimum(np.searchsorted(s, _BOUNDS), len(s) - 1)].reshape(BANDS, BAND)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(BAND):
        key = mix(key * _P[j] + v[:, j])
    return _signed(key).tolist()


def _stats(df: DataFrame, size: int) -> DataFrame:
    """A row for each document (kind 0): id, set size, 128-bit digest, band keys; and rows of each task's frequency sketch (kind 1).

    The sketch leaves out what a task has met once only; most of that is unique.
    """
    schema = pa.schema(
        [
            ("kind", pa.int32()), ("i", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
            ("keys", pa.list_(pa.int64())), ("r", pa.int32()), ("salt", pa.int32()), ("blob", pa.binary())
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums = np.zeros(1 << SKETCH_BITS, np.uint32)
        salt = TaskContext.get().partitionId() // FAN
        for batch in (p for b in batches for p in slices(b, 1)):
            n, d1, d2, keys, seen = [], [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                digest = xxhash.xxh3_128_digest(s.tobytes())
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                keys.append(band_keys(s) if len(s) else [])
                seen.append(s)
            all_of = np.concatenate(seen)
            np.add.at(sums, (all_of & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), np.uint32(1))
            m = len(n)
            none = lambda t: pa.nulls(m, t)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * m, pa.int32()), batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()),
                    pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                    none(pa.int32()), none(pa.int32()), none(pa.binary())
                ],
                schema=schema
            )
        for r in range(len(sums) // BLOCK):
            part = sums[r * BLOCK : (r + 1) * BLOCK]
            part = np.where(part > 1, part, 0)
            if part.any():
                yield _block(schema, r, salt, part)

    return df.mapInArrow(run, "kind int, i long, n long, d1 long, d2 long, keys array<long>, r int, salt int, blob binary")


def _pack(counts: np.ndarray) -> bytes:
    at = np.nonzero(counts)[0]
    return at.astype(np.uint16).tobytes() + np.minimum(counts[at], 0xFFFFFFFF).astype(np.uint32).tobytes()


def _unpack(blob: bytes, into: np.ndarray) -> None:
    m = len(blob) // 6
    into[np.frombuffer(blob, np.uint16, m)] += np.frombuffer(blob, np.uint32, m, 2 * m)


def _block(schema: pa.Schema, r: int, salt: int, counts: np.ndarray) -> pa.RecordBatch:
    values = {"kind": 1, "r": r, "salt": salt, "blob": _pack(counts)}
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def frequency_classes(stats: DataFrame) -> np.ndarray:
    """Classes (8 log2 of the count) of the sketch's counters, summed over all documents level by level, FAN parts at a time."""

    def total(table: pa.Table) -> np.ndarray:
        counts = np.zeros(BLOCK, np.uint64)
        for blob in table.column("blob").to_pylist():
            _unpack(blob, counts)
        return counts

    def merge(table: pa.Table) -> pa.Table:
        return pa.table(
            {"r": table.column("r")[:1], "salt": table.column("salt")[:1], "blob": pa.array([_pack(total(table))], pa.binary())}
        )

    def classify(table: pa.Table) -> pa.Table:
        classes = np.minimum(8 * np.log2(1.0 + total(table)), 255).astype(np.uint8)
        return pa.table({"r": table.column("r")[:1], "blob": pa.array([classes.tobytes()], pa.binary())})

    parts = stats.filter("kind = 1").select("r", "salt", "blob").groupBy("r", "salt").applyInArrow(
        merge, "r int, salt int, blob binary"
    )
    parts = parts.withColumn(
        "salt", F.floor(F.col("salt") / FAN).cast("int")
    ).groupBy("r", "salt").applyInArrow(merge, "r int, salt int, blob binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    # A local iterator runs a job for each partition, whose stages the driver remembers: few partitions of 2 MB.
    done = parts.groupBy("r").applyInArrow(classify, "r int, blob binary").coalesce(FETCHES)
    for row in done.toLocalIterator():
        out[row["r"] * BLOCK : (row["r"] + 1) * BLOCK] = np.frombuffer(row["blob"], np.uint8)
    return out


def _distinct(t: np.ndarray, d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings by token and set, each once; equal sets have equal postings."""
    order = np.lexsort((d, t))
    t, d, o = t[order], d[order], o[order]
    new = np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]))
    return t[new], d[new], o[new]


def shared_prefixes(df: DataFrame, classes: Broadcast, size: int, percent: int, ranges: int) -> DataFrame:
    """``token``, ``d1``, ``pos``: prefix tokens that stand in the prefixes of two or more different sets, and where.

    Tokens travel packed, dealt by hash into ``ranges`` that grow with the input.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in (p for b in batches for p in slices(b, 0)):
            tokens, ids, places = [], [], []
            for s in shingle_sets(batch.column(0), size):
                if len(s):
                    key = (classes.value[(s & mask).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                    p = len(s) - needed(len(s), percent) + 1
                    tokens.append(np.sort(np.partition(key, p - 1)[:p] if p < len(key) else key))
                    places.append(np.arange(p, dtype=np.int32))
                    ids.append(np.full(p, np.frombuffer(xxhash.xxh3_128_digest(s.tobytes())[:8], np.int64)[0], np.int64))
            if not tokens:
                continue
            t, d, o = _distinct(np.concatenate(tokens), np.concatenate(ids), np.concatenate(places))
            r = (mix(t) % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(r, kind="stable")
            t, d, o, r = t[order], d[order], o[order], r[order]
            cuts = np.append(np.nonzero(np.append(True, r[1:] != r[:-1]))[0], len(r))
            rows = [(int(r[a]), t[a:b].tobytes(), d[a:b].tobytes(), o[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["r", "t", "d", "o"]
            )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch for batch in batches if batch.num_rows]
        if not rows:
            return
        t, d, o = (
            np.concatenate([np.frombuffer(b, kind) for batch in rows for b in batch.column(name).to_pylist()]) for name,
            kind in (("t", np.uint64), ("d", np.int64), ("o", np.int32))
        )
        del rows
        t, d, o = _distinct(t, d, o)
        alike = t[1:] == t[:-1]
        keep = np.nonzero(np.append(alike, False) | np.append(False, alike))[0]
        for at in range(0, len(keep), 1 << 16):
            k = keep[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(t[k]), pa.int64()), pa.array(d[k], pa.int64()), pa.array(o[k], pa.int32())],
                names=["token", "d1", "pos"]
            )

    # Range k is partition k, so ranges are even tasks.
    dealt = df.select("x").mapInArrow(emit, "r int, t binary, d binary, o binary").repartitionById(ranges, F.col("r"))
    return dealt.select("t", "d", "o").mapInArrow(match, "token long, d1 long, pos int")


def id_filter(ids: DataFrame) -> tuple[bytes, int]:
    """A bitmap of hashed ids and its number of bits: 16 bits an id, between 2^16 and 2^26 (8 MB) whatever their number.

    It lets every wanted document through, and few others while it isn't full.
    """
    bits = 1 << min(26, max(16, (16 * ids.count()).bit_length()))
    h = F.pmod(F.xxhash64("i"), F.lit(bits)) + 1
    rows = ids.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")
    ).collect()
    out = bytearray(bits // 8)
    for r in rows:
        out[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + min(4096, len(out))] = r["m"][: len(out)]
    return bytes(out), bits


def sets_of(df: DataFrame, ids: DataFrame, size: int) -> tuple[DataFrame, Broadcast]:
    """``i`` and ``set`` (packed) of the documents named by ``ids`` (i), and of few others; texts are not shuffled.

    Also the broadcast it reads, to be destroyed when the rows are written.
    """
    bitmap, bits = id_filter(ids)
    shared = df.sparkSession.sparkContext.broadcast(np.frombuffer(bitmap, np.uint8))

    def run(i: pa.Array, texts: pa.Array, at: pa.Array) -> list:
        h = at.fill_null(0).to_numpy(zero_copy_only=False)
        wanted = pa.array((shared.value[h >> 3] >> (h & 7) & 1).astype(bool) & at.is_valid().to_numpy(zero_copy_only=False))
        return [i.filter(wanted), [s.tobytes() for s in shingle_sets(texts.filter(wanted), size)]]

    at = F.when(F.col("i").isNotNull(), F.pmod(F.xxhash64("i"), F.lit(bits)))
    return map_arrow(df.select("i", "x", at.alias("h")), run, "i long, set binary"), shared


class Chunk:
    """Some sets of a group with their token union, inverted."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self._index = None

    def add(self, i: int, s: np.ndarray) -> None:
        self.ids.append(i)
        self.sets.append(s)

    def alike(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Positions of the members that are similar enough to a set."""
        if self._index is None:
            token = np.concatenate(self.sets)
            sizes = np.array([len(x) for x in self.sets])
            order = np.argsort(token, kind="stable")
            self._index = token[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes
        token, owner, sizes = self._index
        low, high = np.searchsorted(token, s, "left"), np.searchsorted(token, s, "right")
        has = high > low
        # The union bound: no member can share more of the query than the union does.
        if has.sum() < needed(len(s), percent):
            return np.zeros(0, np.int64)
        low, width = low[has], (high - low)[has]
        at = np.repeat(low - np.append(0, np.cumsum(width)[:-1]), width) + np.arange(width.sum())
        both = np.bincount(owner[at], minlength=len(sizes))
        return np.nonzero(100 * both >= percent * (sizes + len(s) - both))[0]

    def inner_links(self, percent: int) -> tuple[list[tuple[int, int]], list[int]]:
        """All members compared: of the links, enough to join what belongs together, and each member's part."""
        root = list(range(len(self.ids)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        out = []
        for k, s in enumerate(self.sets if len(self.sets) > 1 else []):
            for j in self.alike(s, percent).tolist():
                a, b = find(j), find(k)
                if a != b:
                    root[a] = b
                    out.append((self.ids[k], self.ids[j]))
        return out, [find(k) for k in range(len(root))]


def chunks_of(m: Column, tokens: Column) -> Column:
    """Chunks of a group of ``m`` documents and so many tokens."""
    return F.greatest(F.ceil(m / CHUNK), F.ceil(tokens / CHUNK_TOKENS)).cast("int")


def every_chunk(chunks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), chunks - 1)).alias("p")


def own_chunk(i: Column, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(i), chunks).cast("int")


def probe(members: DataFrame, queries: DataFrame, sets: DataFrame, percent: int, inside: bool = False) -> DataFrame:
    """Links (a, b) between the queries of a chunk and its members, and with ``inside`` among its members.

    members: (g, p, i), the documents of chunk p of group g, few and with few tokens; queries: the
    same, any number: a chunk that many ask is copied, and each copy answers some of them.  Chunks
    are read as streams: members first, then query after query.  A query is linked with one member
    of each part of a chunk that is linked already; without ``inside``, a group is one part.
    """
    asked = queries.groupBy("g", "p").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("copies")).filter("copies > 1")
    asked = stored(asked, "asked")
    copies = F.coalesce("copies", F.lit(1))
    held = members.join(asked, ["g", "p"], "left").select(
        "g", "p", F.explode(F.sequence(F.lit(0), copies - 1)).alias("s"), "i", F.lit(0).alias("role")
    )
    asks = queries.join(asked, ["g", "p"], "left").select(
        "g", "p", F.pmod(F.xxhash64("i", F.lit(1)), copies).cast("int").alias("s"), "i", F.lit(1).alias("role")
    )
    dealt = held.unionByName(asks).join(sets, "i").select(
        "g", "p", "s", "role", "i", "set"
    ).repartition("g", "p", "s").sortWithinPartitions("g", "p", "s", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, parts = None, Chunk(), None
        for batch in (p for b in batches for p in slices(b, 5)):
            links: list[tuple[int, int]] = []
            for g, p, copy, role, i, raw in zip(*(x.to_pylist() for x in batch.columns)):
                if (g, p, copy) != at:
                    if inside and parts is None and at and at[2] == 0:
                        links += chunk.inner_links(percent)[0]
                    at, chunk, parts = (g, p, copy), Chunk(), None
                s = np.frombuffer(raw, np.uint64)
                if role == 0:
                    chunk.add(i, s)
                elif chunk.ids:
                    if parts is None:
                        more, parts = chunk.inner_links(percent) if inside else ([], [0] * len(chunk.ids))
                        links += more
                    one = {parts[k]: chunk.ids[k] for k in chunk.alike(s, percent).tolist() if chunk.ids[k] != i}
                    links += [(i, j) for j in one.values()]
            if links:
                yield _links(links)
        if inside and parts is None and at and at[2] == 0:
            links = chunk.inner_links(percent)[0]
            if links:
                yield _links(links)

    return dealt.mapInArrow(run, "a long, b long")


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*links)], names=["a", "b"])


def similarity_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85
) -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` for each row of ``df``.

    Sets of at least ``percent`` per cent Jaccard similarity are linked; the component is the
    smallest id reachable by links.  Texts with fewer words than ``size`` have the whole sequence as
    one shingle; null texts and texts without words have none and are linked with nothing.  Ids are
    whole numbers.  Rows of one id and different texts are separate documents that share a
    name, so both their components are joined by it.  Rows with a null id join no component (null).
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("x"))
    stats = stored(_stats(rows, size), "stats")
    every = stats.filter("kind = 0").select("i", "n", "d1", "d2", "keys")
    named = every.filter("n > 0 and i is not null")
    # Equal sets are one representative, named by its smallest id.
    classes = named.groupBy("d1", "d2", "n").agg(F.min("i").alias("rep"), F.first("keys").alias("keys"))
    reps = stored(classes, "reps")

    # Clusters: representatives that share a band; groups: what is similar in them.
    sc = df.sparkSession.sparkContext
    keyed = reps.select("rep", F.posexplode("keys").alias("j", "key"))
    firsts = keyed.groupBy("j", "key").agg(
        F.min("rep").alias("a"), F.max("rep").alias("z")
    ).filter("a < z").select("j", "key", "a")
    tied = components(keyed.join(firsts, ["j", "key"]).select("a", F.col("rep").alias("b")))
    clustered = tied.select(F.col("root").alias("g"), F.col("node").alias("i")).unionByName(
        tied.select(F.col("root").alias("g"), F.col("root").alias("i")).distinct()
    )
    clustered = stored(clustered.join(reps.select(F.col("rep").alias("i"), "n"), "i"), "clusters")
    about = clustered.groupBy("g").agg(
        F.count("*").alias("m"), F.sum("n").alias("tokens"),
        F.array_distinct(F.array(*[F.min_by("i", F.xxhash64("i", F.lit(k))) for k in range(LEADERS)])).alias("l")
    )
    # Written before it is joined, so that Spark can split the rows of one large cluster over tasks.
    about = stored(about.select("g", chunks_of(F.col("m"), F.col("tokens")).alias("chunks"), "l"), "about")
    members = clustered.join(about.select("g", "chunks"), "g").select("g", own_chunk(F.col("i"), F.col("chunks")).alias("p"), "i")
    leaders = about.filter("chunks > 1").select(
        "g", F.explode("l").alias("i"), "chunks"
    ).select("g", every_chunk(F.col("chunks")), "i")
    sets, filtered = sets_of(rows, clustered.select("i"), size)
    near = stored(probe(members, leaders, sets, percent, inside=True), "near")
    filtered.destroy()
    grouped = components(near)

    # The token-group matrix over prefixes.
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(12, int(total * (100 - percent) / 100 / 400_000))
    sketch = sc.broadcast(frequency_classes(stats))
    shared = shared_prefixes(rows, sketch, size, percent, ranges)
    group_of = reps.select("d1", "n", "rep").join(grouped, F.col("rep") == F.col("node"), "left").select(
        "d1", "n", "rep", F.coalesce("root", "rep").alias("g")
    )
    group_of = stored(group_of, "groups")
    # Of a group of one, all is known; the others' sizes are written before they are joined (see above).
    sizes = group_of.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("tokens")).filter("m > 1")
    sizes = stored(sizes.select("g", "m", chunks_of(F.col("m"), F.col("tokens")).alias("chunks")), "sizes")
    postings = stored(shared.join(group_of, "d1").select("token", "pos", "rep", "n", "g"), "matrix")
    sketch.destroy()
    spread_out = stored(
        postings.groupBy("token").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).filter("g1 <> g2").select("token"),
        "spread"
    )
    matrix = postings.join(spread_out, "token").join(
        sizes.select("g", "m"), "g", "left"
    ).withColumn("m", F.coalesce("m", F.lit(1)))
    cells = matrix.groupBy("token", "g").agg(
        F.max("m").alias("m"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.max(F.col("n") - F.col("pos")).alias("rest")
    )
    asks = matrix.select(
        "token", F.col("rep").alias("q"), F.col("n").alias("qn"), F.col("pos").alias("qpos"), F.col("g").alias("qg"),
        F.col("m").alias("qm")
    )
    # The query is of the smaller group (by size, then name).  Lengths must be compatible, and from the first
    # token that two sets share on, both must have enough tokens left for the overlap they need.
    fits = f"qn * {percent} <= most * 100 and least * {percent} <= qn * 100 and least(qn - qpos, rest) * {100 + percent} >= {percent} * (qn + least)"
    open_ = asks.join(cells, "token").filter(f"(qm < m or qm = m and qg > g) and {fits}")
    open_ = stored(open_.select("q", "g").distinct(), "open")
    opened = stored(
        open_.select("g").distinct().join(sizes.select("g", "chunks"), "g", "left").select(
            "g", F.coalesce("chunks", F.lit(1)).alias("chunks")
        ),
        "opened"
    )
    inside = group_of.join(opened, "g").select("g", own_chunk(F.col("rep"), F.col("chunks")).alias("p"), F.col("rep").alias("i"))
    queries = open_.join(opened, "g").select("g", every_chunk(F.col("chunks")), F.col("q").alias("i"))
    wanted = inside.select("i").unionByName(open_.select(F.col("q").alias("i"))).distinct()
    sets, filtered = sets_of(rows, wanted, size)
    far = stored(probe(inside, queries, sets, percent), "far")
    filtered.destroy()
    for table in (clustered, about, postings, spread_out, open_, opened, sizes, group_of):
        drop_stored(table)

    same = named.join(
        reps.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"]
    ).filter("i <> rep").select(F.col("rep").alias("a"), F.col("i").alias("b"))
    final = components(near.unionByName(far).unionByName(same))
    out = every.join(final, F.col("i") == F.col("node"), "left")
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "i").alias("component_id"))


def op4_jaccard(spark, sf_dir):
    """Query: every document with its set size and component."""
    return similarity_groups(docs(spark, sf_dir))
