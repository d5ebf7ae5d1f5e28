"""BPE, language ID, toxicity, quality and Ogg: round trips, brute force and held-out accuracy."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import batches, bpe, importance, langid, ogg, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
EDGES = [
    None, "", " ", "\n", "  a", "a  b", " a\n b ", "it's", "ﬁ ñ 日本 😀", "x" * 50_000, "the " * 20_000, "1234567",
    "\t\r\n", "a\x1cb \x85", "a\n b"
]


def edge_table(spark, *extra):
    """Edge texts twice, with a null id and columns that clash with results."""
    rows = [(k, t, "en", "s", "clash", 7) for k, t in enumerate(EDGES)] * 2 + [(None, "null id", None, None, "clash", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string, n_words int")


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.machine.ranks, special_tokens={})


def test_bpe_is_the_library(own, library, spark, sf_dir):
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + EDGES
    got = own.round_trip(pa.array(texts, pa.string()), keep_ids=True)
    assert all(got["round_trip"].to_pylist())
    for t, ids in zip(texts, got["ids"].to_pylist()):
        assert ids == library.encode_ordinary(t or "")
        assert own.decode(ids, 3) == (t or "")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(own, library, text):
    assert own.encode(text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text), 2) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=8))
def test_bpe_any_batch(own, library, texts):
    got = own.round_trip(pa.array(texts, pa.string()), keep_ids=True)
    assert [] == texts or got["ids"].to_pylist() == [library.encode_ordinary(t) for t in texts]
    assert list(got["decoded_sha256"]) == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert list(got["ids_sha256"]) == [
        hashlib.sha256(" ".join(map(str, library.encode_ordinary(t))).encode()).hexdigest() for t in texts
    ]


@pytest.mark.parametrize("states", [40, 200_000])
def test_bpe_side_by_side(own, states):
    """Many pieces at once, with the table emptied on the way, are as one after the other."""
    rng = random.Random(9)
    pieces = ["".join(rng.choice("thandionère 日#A9") for _ in range(rng.randint(1, 70))).encode() for _ in range(400)]
    machine = bpe.BpeTransducer(own.machine.ranks, max_states=states)
    n, ids = machine.encode_many(pieces)
    want = [own.machine.encode(p) for p in pieces]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert machine.encode_many([])[0].tolist() == []


def test_edges():
    table, rng = bpe.Edges(4), np.random.default_rng(3)
    keys = rng.permutation(np.unique(rng.integers(0, 1 << 30, 3000)))
    for part in np.split(keys, [1, 10, 500, 501, 2000]):
        assert (table.find(part) == -1).all()
        table.add(part, part + 1, part + 2)
        assert (table.to[table.find(part)] == part + 1).all()
    assert (table.out[table.find(keys)] == keys + 2).all() and (table.find(keys + (1 << 31)) == -1).all()


def test_bpe_states_are_bounded_within_a_piece(own, library):
    rng = random.Random(6)
    small = bpe.BpeTransducer(own.machine.ranks, max_states=50, max_pairs=100)
    for alphabet, n in (("abcdefghijklmnopqrstuvwxyz", 6000), ("日本語学校大", 2000), ("AQgw59xZ", 6000)):
        piece = "".join(rng.choice(alphabet) for _ in range(n))
        for machine in (small, bpe.BpeTransducer(own.machine.ranks)) if n == 2000 else (small,):
            assert machine.encode(piece.encode()) == library._encode_single_piece(piece)
        assert len(small._guesses) <= 52 and len(small._pair) <= 101 and len(small._walk) <= 5000


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_stream(data, step):
    s = bpe.Utf8Stream()
    out = "".join(s.feed(data[k : k + step]) for k in range(0, len(data), step)) + s.close()
    assert out == data.decode("utf-8", "replace")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6), max_size=12))
def test_token_decoder(tokens):
    decoder = bpe.TokenDecoder(dict(enumerate(tokens)), max_steps=3)
    text, state = decoder.feed(decoder.start, list(range(len(tokens))))
    assert text + decoder.close(state) == b"".join(tokens).decode("utf-8", "replace")


def test_bpe_documents(spark, library):
    got = bpe.encode_documents(edge_table(spark), PATH, keep_ids=True).collect()
    assert len(got) == 2 * len(EDGES) + 1
    for r in got:
        text = "null id" if r["doc_id"] is None else EDGES[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["round_trip"]
        assert r["ids_sha256"] == hashlib.sha256(
            " ".join(map(str, ids)).encode()
        ).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(edge_table(spark).limit(0), PATH).count() == 0


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 1 << 31 else 0)) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("sizes", [[0], [1, 254, 255, 256], [0, 510, 0], [200_000, 3], [255 * 255, 255 * 255], [7] * 600])
def test_ogg_round_trip(sizes):
    rng = random.Random(1)
    packets = [(rng.randbytes(n), k) for k, n in enumerate(sizes)]
    other = [(b"o", 0), (b"p", 1)]
    data = ogg.mux([ogg.pages_of(5, packets), ogg.pages_of(9, other)])
    streams, bad = ogg.demux(data)
    assert bad == 0 and streams[5].packets == [p for p, _ in packets] and streams[9].packets == [b"o", b"p"] and streams[5].ended and not streams[5].gaps
    assert streams[5].granules[-1] == len(sizes) - 1


def test_ogg_damage():
    assert ogg.page_crc(b"OggS and more") == slow_crc(b"OggS and more")
    data = bytearray(ogg.encode_samples(bytes(100_000), 100_000))
    data[60_000] ^= 1
    streams, bad = ogg.demux(bytes(data))
    assert bad == 1 and sum(s.gaps for s in streams.values()) >= 1
    with pytest.raises(ValueError):
        ogg.decode_samples(bytes(data))
    with pytest.raises(ValueError):
        ogg.decode_samples(b"")
    got = ogg.decode_samples(ogg.encode_samples(bytes(20_000), 5))
    assert got["starts"] == [0.0, 8192 / 8000, 16384 / 8000] and got["n_bytes"] == 5


def test_ogg_documents(spark):
    for r in ogg.media_documents(edge_table(spark)).collect():
        raw = ("null id" if r["doc_id"] is None else EDGES[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (
            len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])
        )
    assert ogg.media_documents(edge_table(spark).limit(0)).count() == 0


def test_langid(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.op5_langid(spark, sf_dir).join(df.select("doc_id", F.col("lang").alias("want")), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == df.count() and len(held) > 20 and sum(r["lang_pred"] == r["want"] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def letters_of(text):
    return ["".join(g) for inside, g in itertools.groupby((text or "").lower(), str.isalpha) if inside]


def brute_language(counts, text, smooth=0.5):
    """The whole rule for one text, word by word."""
    langs = sorted({lang for lang, _, _ in counts})
    tables = {}
    for (lang, kind, s), n in counts.items():
        tables.setdefault(kind if kind == "w" else len(s), {}).setdefault(s, dict.fromkeys(langs, smooth))[lang] += n
    logs = {}
    for kind, table in tables.items():
        total = {lang: sum(row[lang] for row in table.values()) for lang in langs}
        for s, row in table.items():
            x = [math.log(row[lang] / total[lang]) for lang in langs]
            logs["w" if kind == "w" else "g", s] = [v - sum(x) / len(x) for v in x]
    score, words = [0.0] * len(langs), letters_of(text)
    for w in words:
        rows = [logs["w", w]] if ("w", w) in logs else []
        if not rows:
            b = f" {w} "
            for i in range(len(b) - 1):
                rows += next(
                    ([logs["g", b[i : i + n]]] for n in (4, 3, 2, 1) if len(b[i : i + n]) == n and ("g", b[i : i + n]) in logs),
                    []
                )
        for row in rows:
            score = [a + v / len(rows) for a, v in zip(score, row)]
    if not words:
        return "und", 0.0
    z = [v / len(words) * min(len(words), 50) for v in score]
    p = [math.exp(v - max(z)) for v in z]
    return langs[p.index(max(p))], max(p) / sum(p)


def test_langid_is_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang").collect()
    counts = Counter()
    for text, lang in rows[:120]:
        for w in letters_of(text):
            counts[lang, "w", w] += 1
            for g in langid.grams(w):
                counts[lang, "g", g] += 1
    counts = {k: n for k, n in counts.items() if n > 1}
    texts = [r[0] for r in rows[100:]] + EDGES + ["½ ² ①", "½a", "İstanbul ΣΑΣ ﬁ", "a-b_c9d"]
    got = list(zip(*langid.Scorer(langid.LanguageModel(counts)).predict(batches.stretches(pa.array(texts, pa.string())))))
    for text, (lang, score) in zip(texts, got):
        if text and len(text) > 200_000:
            continue
        want, share = brute_language(counts, text)
        assert score == pytest.approx(share, abs=1e-4) and (lang == want or abs(score - 1 / 4) < 0.01), text


def test_langid_backs_off(spark):
    model = langid.LanguageModel(
        {
            ("en", "w", "house"): 5, ("de", "w", "haus"): 5, ("en", "g", "th"): 9, ("de", "g", "sch"): 9,
            ("de", "g", "th"): 1, ("de", "g", "ch"): 9, ("en", "g", "ou"): 3
        }
    )
    texts = ["House", "xschx", "thx", "123 !", None, "½", ""]
    lang, score = langid.Scorer(model).predict(batches.stretches(pa.array(texts)))
    assert lang == ["en", "de", "en", "und", "und", "und", "und"] and not score[3:].any()
    assert langid.Scorer(model).predict(batches.stretches(pa.array([None, " "], pa.string())))[0] == ["und", "und"]
    edges = langid.identify(edge_table(spark)).collect()
    assert all(
        r["lang_pred"] == "und" for r in edges if r["doc_id"] is not None and not any(
            c.isalpha() for c in EDGES[r["doc_id"]] or ""
        )
    )
    assert {
        r["lang_pred"] for r in langid.identify(edge_table(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    } == {"und"}
    assert langid.identify(edge_table(spark).limit(0)).count() == 0


def test_langid_small_language_keeps_its_words(spark):
    rows = [(k, "alpha beta gamma delta", "big") for k in range(50)] + [(100 + k, "zuzu wowo", "small") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, max_words=3, max_grams=4)
    known = langid.Lookup(model.words[0])
    find = lambda w: known.find(batches.word_keys(batches.words([w], str.isalpha)))[0] >= 0
    assert model.langs == ["big", "small"]
    assert [
        w for w in ("alpha", "beta", "delta", "gamma", "zuzu", "wowo") if find(w)
    ] == ["alpha", "beta", "delta", "zuzu", "wowo"]
    assert langid.Scorer(model).predict(batches.stretches(pa.array(["zuzu wowo"])))[0] == ["small"]
    assert langid.fit(df, max_langs=1).langs == ["big"]


def test_lookup():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.uint64) << np.uint64(2))
    table = batches.Lookup(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1)) == -1).all()
    assert (batches.Lookup(keys[:0]).find(keys) == -1).all()


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for k in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        y = k % 4 == 0
        if y:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "foul"]))
        rows.append((k, " ".join(words), "en", "s"))
        labels.append((k, int(y)))
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string"
    ), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns(toxic_corpus, spark):
    df, labels = toxic_corpus
    from folioscope.llm.common import fold

    got = toxicity.classify(df, labels, fold("doc_id", 3) != 1).join(labels, "doc_id").filter(fold("doc_id", 3) == 1).collect()
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert right >= 0.95 * len(got) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def brute_toxicity(model, text):
    """The forward pass for one text, word by word and filter by filter."""
    words = ["".join(g) for inside, g in itertools.groupby((text or "").lower(), str.isalnum) if inside]
    x = [model.embed[h].mean(0) for h in toxicity.buckets(words)] if words else []
    z, k = model.base, 0
    for w in toxicity.WIDTHS:
        padded = x + [np.zeros(toxicity.DIM)] * (w - len(x))
        for f in range(toxicity.FILTERS):
            best = max(
                sum(float(padded[i + j] @ model.filters[w][j, :, f]) for j in range(w)) for i in range(len(padded) - w + 1)
            )
            z += max(best + float(model.bias[w][f]), 0.0) * float(model.out[k])
            k += 1
    return 1 / (1 + math.exp(-z))


def test_toxicity_is_brute_force(toxic_corpus, spark, sf_dir, monkeypatch):
    df, labels = toxic_corpus
    model = toxicity.fit(df, labels)
    texts = [r[0] for r in df.select("text").limit(60).collect()] + [t for t in EDGES if len(t or "") < 1000] + [
        "vile", "so vile", "a b nasty", "it's foul-mouthed", "ça ½"
    ]
    for block in (1 << 16, 5):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        raw = toxicity.Scorer(model).raw(batches.stretches(pa.array(texts, pa.string())))
        for text, got in zip(texts, raw):
            assert got == pytest.approx(brute_toxicity(model, text), rel=1e-3, abs=1e-5), text
    assert toxicity.Scorer(model).raw(
        batches.stretches(pa.array([None, " "], pa.string()))
    ) == pytest.approx([brute_toxicity(model, "")] * 2, rel=1e-3)
    # Thresholds of the languages fall on DECISION.
    model.thresholds = {"en": 0.9}
    score = toxicity.Scorer(model).score(batches.stretches(pa.array(texts, pa.string())))
    for text, r, s in zip(texts, raw, score):
        t = 0.9 if any(c.isalpha() for c in text or "") else model.threshold
        assert s == pytest.approx(0.7 * r / t if r < t else 0.7 + 0.3 * (r - t) / (1 - t))


def test_toxicity_edges(spark, toxic_corpus):
    df, labels = toxic_corpus
    none = toxicity.classify(edge_table(spark), labels.filter("toxic = 1")).collect()
    assert len(none) == 2 * len(EDGES) + 1 and all(r["predicted"] == 0 and r["score"] < 1e-6 for r in none)
    model = toxicity.fit(df.limit(200), labels)
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.classify(df.limit(0), labels.limit(0)).count() == 0
    # Repeated ids teach once, whatever their number; texts over the bound teach nothing.
    again = toxicity.fit(df.limit(200).unionByName(df.limit(200)), labels)
    assert np.array_equal(again.embed, model.embed) and np.array_equal(again.out, model.out)
    assert toxicity.fit(df, labels, max_words=0).threshold == 0.5


def shape(word):
    """Letter case, digits and marks of a word, runs collapsed, eight at most."""
    kinds = ["0" if c.isdecimal() else ("A" if c.isupper() else "a") if c.isalpha() else c for c in word]
    return "".join(k for k, _ in itertools.groupby(kinds))[:8]


def brute_grams(text):
    words = (text or "").split()
    h = lambda w: xxhash.xxh32_intdigest(w)
    s = lambda w: int(importance.word_hashes([shape(w)])[1][0])  # noqa: E731  a shape is its own shape
    mask = 0xFFFFFFFF
    mix = lambda x, shift: ((x * 0x9E3779B1) & mask) >> shift
    out = Counter(mix(h(w), 19) for w in words)
    shapes = dict(zip(words, map(s, words))) if len(words) < 100 else {w: s(w) for w in set(words)}
    for a, b in zip(words, words[1:]):
        out[mix(((h(a) * 0x85EBCA77) & mask) ^ h(b), 19)] += 1
        same = 0x5BD1E995 if h(a) == h(b) else 0
        out[importance.WORDS + mix(((shapes[a] * 0x85EBCA77) & mask) ^ shapes[b] ^ same, 22)] += 1
    return out


def brute_weights(texts, target):
    """Log weights of all texts, given which are targets."""
    raw, goal = Counter(), Counter()
    bags = [brute_grams(t) for t in texts]
    for g, chosen in zip(bags, target):
        raw += g
        goal += g if chosen else Counter()
    ratio = {}
    for part in (range(importance.WORDS), range(importance.WORDS, importance.BUCKETS)):
        r = {b: raw[b] + 1.0 for b in part}
        total = sum(r.values())
        t = {b: goal[b] + len(part) * r[b] / total for b in part}
        n = sum(t.values())
        ratio |= {b: math.log(t[b] / n) - math.log(r[b] / total) for b in part}
    return [sum(ratio[b] * c for b, c in g.items()) for g in bags]


@pytest.mark.parametrize("block", [1 << 17, 7])
def test_importance_grams(monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    texts = [t for t in EDGES if t is None or len(t) < 1000] + [
        "the cat sat on the mat", "Buy!! NOW!! NOW!! 50%", "x", "ÀÉ1234-5678abcDEF"
    ]
    target = np.array([k % 3 == 0 for k in range(len(texts))])
    bag = importance.Bag(batches.stretches(pa.array(texts, pa.string())))
    for got, some in zip(bag.counts(target), (texts, [t for t, c in zip(texts, target) if c])):
        assert {k: n for k, n in enumerate(got) if n} == dict(sum(map(brute_grams, some), Counter()))
    ratio = np.random.default_rng(1).normal(size=importance.BUCKETS)
    n, sums = bag.sums(ratio)
    for k, t in enumerate(texts):
        g = brute_grams(t)
        assert n[k] == sum(g.values()) and sums[k] == pytest.approx(sum(ratio[b] * c for b, c in g.items()), abs=1e-9)


def test_importance_is_brute_force(spark):
    rng = random.Random(8)
    rows = [
        (
            k,
            " ".join(
                rng.choice(
                    ["good", "fine", "text", "JUNK!!", "###"][:3] if k % 4 else ["JUNK!!", "###"]
                ) for _ in range(rng.randint(0, 30))
            )
        ) for k in range(120)
    ]
    rows += [(None, "good fine"), (None, "JUNK!! ###"), (3, rows[3][1]), (500, None)]
    labels = [(k, int(k % 4 > 0)) for k in range(0, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1)], "doc_id long, quality int")
    got = importance.resample(df, lab, seed=3).collect()
    good = {k for k, y in labels if y}
    weights = brute_weights([t for _, t in rows], [i in good for i, _ in rows])
    noise = [((xxhash.xxh3_64_intdigest(f"3:{i}:{t or ''}") >> 11) + 0.5) / 2**53 for i, t in rows]
    keys = [w - math.log(-math.log(u)) for w, u in zip(weights, noise)]
    at = lambda w: int(math.copysign(math.floor(math.log2(1 + abs(w))), w))
    label, seen = dict(labels), {}
    for (i, _), w in zip(rows, weights):
        if i in label:
            seen.setdefault(at(w), []).append(label[i])
    size = 0
    for w in weights:
        own = seen[min(seen, key=lambda j: (abs(j - at(w)), -j))]
        size += sum(own) / len(own)
    cut = sorted(keys, reverse=True)[math.ceil(round(size, 6)) - 1]
    want = Counter((i, round(w, 6), k >= cut) for (i, _), w, k in zip(rows, weights, keys))
    assert Counter((r["doc_id"], round(r["log_weight"], 6), r["selected"]) for r in got) == want
    assert sum(r["selected"] for r in importance.resample(df, lab, k=30).collect()) == 30


def test_importance_inclusion_follows_the_weights(spark):
    """Of one row of each kind, the largest key is a draw in proportion to the weights."""
    kinds, groups = ["a b c", "a a b", "c c c d"], 6000
    df = spark.createDataFrame(
        [(len(kinds) * g + j, t) for g in range(groups) for j, t in enumerate(kinds)], "doc_id long, text string"
    )
    target = spark.createDataFrame(
        [(len(kinds) * g + j,) for g in range(0, groups, 10) for j in ((0,), (0, 1), (0, 1, 2))[g // 10 % 3]],
        "doc_id long"
    )
    rows = importance.weigh(df, target).collect()
    weight, won = {}, Counter()
    for group in itertools.groupby(sorted(rows, key=lambda r: r["doc_id"]), lambda r: r["doc_id"] // len(kinds)):
        own = list(group[1])
        weight = {r["doc_id"] % len(kinds): math.exp(r["log_weight"]) for r in own}
        won[max(own, key=lambda r: r["gumbel_key"])["doc_id"] % len(kinds)] += 1
    for j in weight:
        p = weight[j] / sum(weight.values())
        assert abs(won[j] - p * groups) < 4 * math.sqrt(groups * p * (1 - p))
    assert max(weight.values()) > 1.3 * min(weight.values())


def test_importance_top_k(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 5, 1, -3, 2.5, 9, 9, 9, 0]], "v double")
    order = sorted([5, 5, 1, -3, 2.5, 9, 9, 9, 0], reverse=True)
    assert [importance.kth_largest(df, "v", k, bins=3) for k in range(1, 10)] == order


def test_importance_selects(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("selected", F.lit("clash"))
    got = importance.resample(df, labels, carry=True)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_grams", "log_weight", "gumbel_key", "selected"]
    rows = got.join(labels, "doc_id").collect()
    good, bad = [r["selected"] for r in rows if r["quality"] == 1], [r["selected"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
    # A very long text is one row like any other.
    long = df.limit(50).unionByName(df.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.repeat("text", 2000)}))
    assert importance.resample(long, labels).filter("doc_id = -1 and n_grams > 100000").count() == 1
    assert importance.resample(edge_table(spark), labels.filter("quality = 5")).filter("selected").count() == 2 * len(EDGES) + 1
    assert importance.resample(edge_table(spark), labels.limit(0)).count() == 2 * len(EDGES) + 1
    assert importance.resample(df.limit(0), labels).count() == 0


def test_toxicity_learns_from_all_labelled_texts(spark, monkeypatch):
    """No draw of labelled texts, no bound of their words: counts are of all but the calibrating fifth."""
    import zlib

    n = 8000
    df = spark.range(n).selectExpr("id doc_id", "concat('plain words ', id % 50) text", "'en' lang")
    labels = spark.range(n).selectExpr("id doc_id", "int(id % 3 = 0) toxic")
    seen = []
    first = toxicity._init
    monkeypatch.setattr(toxicity, "_init", lambda counts, n, rng: seen.append((counts, n)) or first(counts, n, rng))
    toxicity.fit(df.unionByName(df), labels, rounds=0)
    teach = [k for k in range(n) if zlib.crc32(f"3:{k}".encode()) % 5]
    want = [sum(k % 3 != 0 for k in teach), sum(k % 3 == 0 for k in teach)]
    assert seen[0][1].tolist() == want and seen[0][0][:, np.unique(toxicity.buckets(["plain"]))].T.tolist() == [want] * 3


def test_toxicity_in_shards_and_long_texts(toxic_corpus, spark):
    """Shards that are averaged learn, the same each time; a word that only texts of over 10,000 words have is learned."""
    df, labels = toxic_corpus
    long = spark.range(1000, 1120).selectExpr(
        "id doc_id", "concat(repeat('calm ', 10001), if(id % 2 = 0, 'wicked', 'kindly')) text", "'en' lang", "'s' source"
    )
    more = labels.unionByName(long.selectExpr("doc_id", "int(doc_id % 2 = 0) toxic"))
    both = df.unionByName(long)
    model = toxicity.fit(both, more, shard=200)
    got = toxicity.score(both, model).join(more, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.95 * len(got)
    assert sum(r["predicted"] == r["toxic"] for r in got if r["doc_id"] >= 1000) >= 115
    again = toxicity.fit(both.repartition(7), more, shard=200)
    assert np.array_equal(again.embed, model.embed) and again.thresholds == model.thresholds
    long_text = toxicity.buckets(["calm"] * 7 + ["wicked"])
    whole = toxicity._forward(model, long_text)
    toxicity_block, toxicity.BLOCK = toxicity.BLOCK, 3
    try:
        cut = toxicity._forward(model, long_text)
    finally:
        toxicity.BLOCK = toxicity_block
    assert np.allclose(whole[0], cut[0]) and (whole[1] == cut[1]).all()


def test_toxicity_deals_lessons_once(toxic_corpus, spark, monkeypatch):
    """Counts and rounds read the shards as they were written, without an exchange; each holds its labelled texts once."""
    df, labels = toxic_corpus
    plans, tables = [], []
    summed, keep = toxicity._summed, toxicity.stored
    monkeypatch.setattr(
        toxicity, "_summed", lambda parts, size: plans.append(parts._jdf.queryExecution().executedPlan().toString()) or summed(parts, size)
    )
    monkeypatch.setattr(toxicity, "stored", lambda found, name: tables.append(keep(found, name)) or tables[-1])
    monkeypatch.setattr(toxicity, "drop_stored", lambda rows: None)
    more = labels.unionByName(spark.sql("select 5L doc_id, 1 toxic union all select 70000L, 1"))
    other = spark.sql("select 5L doc_id, 'another text' text, 'en' lang, 's' source union all select 80000L, 'no label', 'en', 's'")
    toxicity.fit(df.unionByName(df).unionByName(other), more, shard=100, rounds=2)
    assert len(plans) == 3 and not any("Exchange" in p for p in plans)
    rows = tables[0].withColumn("file", F.input_file_name()).collect()
    assert len(rows) == 901 and sum(r["y"] for r in rows) == 225 + 2
    assert len({r["s"] for r in rows}) == 10 == len({(r["s"], r["file"]) for r in rows})
    texts = [(np.zeros((k + 1, 3), np.uint16), k) for k in range(50)]
    monkeypatch.setattr(toxicity, "MIXED", 600)
    one, two = ([y for _, y in toxicity._mixed(iter(texts), seed)] for seed in (1, 2))
    assert one != two and sorted(one) == sorted(two) == list(range(50)) and max(one[:14]) < 14


def test_bpe_states_are_packed():
    """A state is kept as bytes, three numbers a guess, and gives its guesses back."""
    machine = bpe.BpeTransducer(bpe.load_ranks(PATH))
    machine.encode_many([b" unquestionably", b" xqzzjk", "ĳß".encode()])
    assert len(machine._guesses) > 10 and all(isinstance(g, bytes) and len(g) % 12 == 0 for g in machine._guesses)
    assert all(machine._intern(tuple(machine._live(k))) == k for k in range(len(machine._guesses)))
