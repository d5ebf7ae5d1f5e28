"""Line dedup, Jaccard join, parsing, licenses, mixing and the pipeline against brute force and SQL."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import components, jaccard, licenses, lines, mixing, parsing, registry

from ..conftest import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(name, spark, sf_dir, duck):
    assert rows_of(registry.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, registry.SQL[name])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def against_sql(spark, rows, query, sql):
    """A query's frame function and its SQL on a small table."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows) if rows else None
    assert rows_of(query(spark.createDataFrame(rows, SCHEMA))) == rows_of_sql(con, sql)


def small_corpus(n=60, seed=2):
    rng = random.Random(seed)
    words = [
        "the", "mit", "license", "gnu", "general", "public", "cc", "by", "apache", "x", "ñ", "released", "under",
        "licensed", "version", "2", "0", "all", "rights", "reserved"
    ]
    rows = [
        (
            k,
            "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 5))),
            rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "web12", None]), 1
        ) for k in range(n)
    ]
    return [
        *rows, (n, None, "en", "src0", 0), (n + 1, "", "en", "src0", 0),
        (n + 2, "MIT\nLicense, Released under the MIT License.\n\n", "en", "src1", 1),
        (n + 3, "KCC-BY\tcc  by;CC.BY mıt license", "en", None, 1)
    ]


def test_lines_small(spark):
    rows = small_corpus() + small_corpus()[-4:]
    against_sql(
        spark, rows,
        lambda df: lines.drop_boilerplate(df).select(
            "doc_id", "source", F.col("text").alias("clean_text"), F.col("n_lines").cast("long").alias("n_lines"),
            F.col("n_dropped").cast("long").alias("n_dropped")
        ),
        lines.OP2_SQL
    )
    against_sql(
        spark, [],
        lambda df: lines.drop_boilerplate(df).select(
            "doc_id", "source", F.col("text").alias("clean_text"), F.col("n_lines").cast("long").alias("n_lines"),
            F.col("n_dropped").cast("long").alias("n_dropped")
        ),
        lines.OP2_SQL
    )


def test_lines_beyond_broadcast(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("n_lines", F.lit("clash"))
    small = rows_of(lines.drop_boilerplate(df))
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    assert rows_of(lines.drop_boilerplate(df)) == small


def test_lines_by_host(spark, sf_dir):
    rows = [
        (f"https://WWW.a.org/{k}", f"menu\nown {k}\n\t") for k in range(4)
    ] + [(f"http://b.net:80/{k}", f"menu {k}\nfooter") for k in range(4)] + [("no address", "menu"), (None, "menu")]
    df = spark.createDataFrame(rows, "url string, text string")
    got = {r["url"]: r["text"] for r in lines.drop_boilerplate(df, lines.host(F.col("url")), max_ratio=0.5).collect()}
    assert got == {u: t.replace("menu\n", "") if "a.org" in (u or "") else t.replace("\nfooter", "") for u, t in rows}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = lines.drop_boilerplate(pages, lines.host(F.col("url")), "html")
    hosts = Counter(r["h"] for r in pages.select(lines.host(F.col("url")).alias("h")).collect())
    assert out.count() == pages.count() == sum(hosts.values()) and None not in hosts


def test_lines_long_text(spark):
    rows = [(k, "\n".join(f"{k} {j}" for j in range(20000)) + "\nsame", None, "s", 0) for k in range(3)]
    got = lines.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(
        r["text"] == t.removesuffix("\nsame") and (r["n_lines"], r["n_dropped"]) == (20001, 1) for r,
        (_, t, *_) in zip(sorted(got, key=lambda r: r["doc_id"]), rows)
    )


def test_licenses_small(spark):
    against_sql(spark, small_corpus(), licenses.scan_licenses, licenses.licenses_sql())
    against_sql(spark, [], licenses.scan_licenses, licenses.licenses_sql())


def test_licenses_runs(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"
    texts = [
        bsd, "Licensed under the Apache\nLicense, Version 2.0", "x " * 500 + "\nAll\nrights\nreserved.\n" + "y " * 500,
        "This work is licensed under the terms of the GNU General Public\nLicense, version 3",
        "all of the many words\nthat have no rights\nand are not reserved", "Released under the MIT License.", None, "",
        "\n",
        "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.",
        "all " + "x " * 2000 + "rights " + "y " * 2000 + "reserved", "This wor\u212a is dedicated to the public domain",
        "all rights reserved" + " z" * 20000,
    ]
    rows = [(k, t, None, None, 0) for k, t in enumerate(texts)]
    got = [
        (r["labels"], r["score"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    ]
    assert got[:3] == [("bsd", 1.0), ("apache,apache-2.0", 1.0), ("all-rights-reserved", 1.0)]
    assert got[3][0] == "gpl,gpl-3" and got[4:9] == [("", 0.0), ("mit", 1.0), ("", 0.0), ("", 0.0), ("", 0.0)]
    assert [x for x, _ in got[9:12]] == ["cc-by", "cc-by,cc-by-nc", ""] and got[12][1] < 1.0 and got[13] == ("all-rights-reserved", 1.0)
    against_sql(spark, rows, licenses.scan_licenses, licenses.licenses_sql())
    # The place of a notice in its text does not matter.
    moved = spark.createDataFrame([(k, "w " * k + bsd + " w" * (40 - k), None, None, 0) for k in range(40)], SCHEMA)
    assert {r["labels"] for r in licenses.scan_licenses(moved).collect()} == {"bsd"}


def test_licenses_clashing_names(spark):
    df = spark.createDataFrame(
        [(1, "MIT License"), (1, "MIT License"), (None, None)], "h long, t string"
    ).withColumn("label", F.lit("x"))
    got = Counter(map(tuple, licenses.scan_licenses(df, "h", "t").select("h", "labels").collect()))
    assert got == Counter({(1, "mit"): 2, (None, ""): 1})


def pick(df):
    return df.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


@pytest.mark.parametrize(
    "mix",
    [
        mixing.Mix(), mixing.Mix(budget_permille=5000, max_epochs=3), mixing.Mix(budget_permille=0),
        mixing.Mix(lang={"en": 0}, max_epochs=1, budget_permille=900)
    ]
)
def test_mixing_small(spark, mix):
    rows = small_corpus(200)
    against_sql(spark, rows, lambda df: pick(mixing.mix_sources(df, mix)), mixing.mixing_sql(mix))


def test_mixing_weight_zero_goes_to_siblings(spark):
    leaves = spark.createDataFrame(
        [("d0", "en", "src0", 900), ("d0", "de", "src0", 100), ("d1", "de", "src1", 1000)],
        "domain string, lang string, source string, supply long"
    )
    for mix in (
        mixing.Mix(domain={}, lang={"en": 0}, budget_permille=500, max_epochs=1),
        mixing.Mix(domain={}, lang={}, source={"src0": 0, "src1": 1}, budget_permille=500, max_epochs=1)
    ):
        got = {(r["domain"], r["lang"]): r["alloc"] for r in mixing.leaf_budgets(leaves, mix).collect()}
        # 1000 tokens are to be had; what d0 can't use goes to d1.
        assert got == {("d0", "en"): 0, ("d0", "de"): 100 if mix.lang else 0, ("d1", "de"): 900 if mix.lang else 1000}


def test_mixing_clashing_names(spark):
    df = spark.createDataFrame(small_corpus(60), SCHEMA)
    clash = ["rest", "cut", "passes", "before", "edge", "part", "k", "n", "e_id", "alloc", "supply"]
    more = df.withColumns({c: F.col("doc_id") for c in clash})
    got = mixing.mix_sources(more)
    assert got.filter(" or ".join(f"{c} <> doc_id" for c in clash)).count() == 0
    assert rows_of(pick(got)) == rows_of(pick(mixing.mix_sources(df)))


def test_mixing_repeated_rows_and_null_ids(spark):
    rows = [
        (1, "a b c"), (1, "a b c"), (None, "d e"), (None, "f g"), (2, None), (3, "")
    ] + [(k, "w " * 4000) for k in range(10, 14)]
    df = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], SCHEMA)
    everything = mixing.mix_sources(df, mixing.Mix(budget_permille=1000, max_epochs=1))
    assert Counter((r["doc_id"], r["text"]) for r in everything.collect()) == Counter(rows)
    half = Counter(
        (r["doc_id"], r["text"]) for r in mixing.mix_sources(df, mixing.Mix(budget_permille=500, max_epochs=1)).collect()
    )
    assert half[1, "a b c"] in (0, 2) and sum(4000 * n for (i, _), n in half.items() if i and i >= 10) <= 8006


def test_mixing_properties(spark, monkeypatch):
    df = spark.createDataFrame(small_corpus(150), SCHEMA).withColumn("epoch", F.lit("clash"))
    mix = mixing.Mix(domain={}, lang={}, budget_permille=500, max_epochs=1)
    got = mixing.mix_sources(df, mix)
    total = sum(r["n"] for r in df.select(mixing.n_tokens(F.col("text")).alias("n")).collect())
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "domain", "n_tokens", "epoch"]
    assert 0 < got.agg(F.sum("n_tokens")).first()[0] <= total // 2
    everything = rows_of(got)
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert rows_of(mixing.mix_sources(df, mix)) == everything
    assert mixing.mix_sources(df.limit(0), mix).count() == 0


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(texts, k, percent):
    sets, parent = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index, links = {}, 0
    for a, s in enumerate(sets):
        seen = Counter(b for t in s for b in index.get(t, ()))
        for b, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[b]) - n):
                links += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
        for t in s:
            index.setdefault(t, []).append(a)
    return [find(a) for a in range(len(texts))], [len(s) for s in sets], links


def near_corpus(seed, n=260):
    """Families of near copies with chains of edits, shared passages, exact copies, edges."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    passage, texts = [word() for _ in range(30)], [None, "", " \n", "one", "One", "a b c", "A B  C", "a b c d", "a b c d"]
    while len(texts) < n:
        base = [word() for _ in range(rng.randint(4, 60))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 8, 40])):
            texts.append(" ".join(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                base = list(base)
                base[rng.randrange(len(base))] = word()
    return texts[:n]


@pytest.mark.parametrize("seed, k, percent, chunk", [(1, 4, 85, 256), (2, 5, 80, 3)])
def test_jaccard_is_brute_force(spark, monkeypatch, seed, k, percent, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    texts = near_corpus(seed)
    df = spark.createDataFrame(
        [(a + 10, t, "x") for a, t in enumerate(texts)], "doc_id long, text string, n_shingles string"
    ).repartition(3)
    got = {r["doc_id"]: r for r in jaccard.similarity_groups(df, size=k, percent=percent).collect()}
    roots, sizes, links = brute_components(texts, k, percent)
    assert links > 50 and len(got) == len(texts)
    assert [got[a + 10]["n_shingles"] for a in range(len(texts))] == sizes
    assert [got[a + 10]["component_id"] - 10 for a in range(len(texts))] == roots


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None)], "doc_id long, text string")
    got = Counter(map(tuple, jaccard.similarity_groups(df).collect()))
    assert got == Counter([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2)])
    assert jaccard.similarity_groups(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 40)] + [
        (rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)
    ] + [(7, 7)]
    rng.shuffle(links)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {
        r["node"]: r["root"] for r in components.components(
            spark.createDataFrame([*links, (300, 299)], "a long, b long")
        ).collect()
    }
    assert got == {x: find(x) for x in list(parent) if find(x) != x} | {300: 299}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parsing_is_local():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef ") for _ in range(3000))
    alone, batch = parsing.signatures([text])[0], parsing.signatures(["x", text, "", text[:50], text])
    assert (alone == batch[1]).all() and (alone == batch[4]).all() and len(batch[2]) == 0
    names = [
        {
            int(v) for lv, x, _ in parsing.parse([t.encode()]) if lv == 2 for v in x
        } for t in (text, "some other start" + text, text + text)
    ]
    for other in names[1:]:
        assert len(names[0] & other) >= len(names[0]) - 6
    runs = [{int(v) for lv, x, _ in parsing.parse([t.encode()]) if lv == 1 for v in x} for t in ("x" * 999, "x" * 1001)]
    assert runs[0] == runs[1]
    a, b = ({int(v) for _, x, _ in parsing.parse([t.encode()]) for v in x} for t in (text, text[:1500] + text[2000:]))
    exact = len(a & b) / len(a | b)
    assert abs(parsing.likeness(*parsing.signatures([text, text[:1500] + text[2000:]])) - exact) < 0.25
    assert parsing.likeness(alone, alone) == 1.0 and parsing.likeness(alone, batch[2]) == 0.0 and parsing.likeness(batch[2], batch[2]) == 1.0


def test_phrases_are_short():
    rng = np.random.default_rng(2)
    for alphabet in (2, 4, 200):
        x = rng.integers(0, alphabet, 5000).astype(np.uint8)
        ends = np.nonzero(parsing.phrase_ends(x, np.array([0, 1234])))[0]
        assert 1233 in ends and 4999 in ends and np.diff(np.concatenate([[-1], ends])).max() <= 4


@pytest.mark.parametrize("parts", [1, 5])
def test_parsing_documents(spark, sf_dir, parts):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    df = spark.createDataFrame([*df.collect(), (1000, None), (1001, ""), (1002, "é"), (-5, "é")], "doc_id long, text string")
    rows = sorted(df.collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in parsing.fingerprint_documents(df, parts=parts).collect()}
    assert len(got) == len(rows)
    for row, after in zip(rows, rows[1:] + rows[:1]):
        t, u = row["text"] or "", after["text"] or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = parsing.signatures([t, u, e])
        r = got[row["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (
            len(t), hashlib.sha256(e.encode()).hexdigest(), parsing.as_text(a), parsing.as_text(c)
        )
        assert (r["near_edited"], r["near_next"]) == (parsing.likeness(a, c), parsing.likeness(a, b))
    assert parsing.fingerprint_documents(df.limit(0), parts=parts).count() == 0
    assert parsing.fingerprint_documents(df.limit(1), parts=parts).count() == 1


def slow_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * factor) % 2**64
    return x ^ x >> 31


def slow_names(text):
    """Names of all levels of one text, symbol by symbol."""
    x, bits, out = list(text.encode()), 8, set()
    for level in range(1, parsing.LEVELS + 1):
        if not x:
            break
        n, y, width = len(x), x, bits
        for _ in range(3):
            left = [y[i - 1] if i else y[i] ^ (2**width - 1) for i in range(n)]
            low = [(a ^ b) & -(a ^ b) if a != b else 0 for a, b in zip(y, left)]
            k = [(v.bit_length() - 1) if v else width for v in low]
            y, width = [(2 * j + (v >> j & 1)) % 2**width for j, v in zip(k, y)], 8
            y = [v % 256 for v in y]
        top = [0 < i < n - 1 and y[i] > y[i - 1] and y[i] >= y[i + 1] for i in range(n)]
        anchor, ends = -1, []
        for i in range(n):
            anchor = i if top[i] else anchor
            ends.append((i - anchor) % 3 == 0 or top[i])
        i = 0
        while i < n:  # runs of one symbol: phrases of two from the start of the run
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j > i:
                if i:
                    ends[i - 1] = True
                for m in range(i, j + 1):
                    ends[m] = (m - i) % 2 == 1
                ends[j] = True
            i = j + 1
        ends[n - 1] = True
        names, at = [], 0
        for i in range(n):
            if ends[i]:
                h = slow_mix((x[at] + level) * 0x9E3779B97F4A7C15 % 2**64)
                for v in x[at + 1 : i + 1]:
                    h = slow_mix((h * 0x9E3779B97F4A7C15 + v) % 2**64)
                names.append(h)
                at = i + 1
        x, bits = names, 64
        if level >= parsing.FROM_LEVEL:
            out |= {slow_mix((v * 0x94D049BB133111EB + level) % 2**64) >> 32 for v in names}
    return out


def test_parsing_is_brute_force():
    rng = random.Random(11)
    texts = ["", "a", "aa", "ab", "aaaaaaa", "abababab", "ééñ日本", "x" * 70 + "y" * 31] + [
        "".join(rng.choice("ab"[: rng.randint(1, 2)] + "cdef gh") for _ in range(rng.randint(1, 400))) for _ in range(40)
    ]
    for text, got in zip(texts, parsing.signatures(texts)):
        assert got.tolist() == sorted(slow_names(text))[: parsing.SKETCH], text


def test_parsing_buckets_are_even(spark):
    """Bucket k is partition k, and null or repeated ids are split by the text."""
    rows = [(k, f"text {k}") for k in range(4000)] + [
        (None, f"null {k}") for k in range(2000)
    ] + [(77, f"again {k}") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = parsing.with_next(df, "doc_id", "text", 8)
    sizes = Counter(
        r["p"] for r in dealt.filter("not halo").select(F.spark_partition_id().alias("p"), "b").collect() if r["p"] == r["b"]
    )
    assert sum(sizes.values()) == len(rows) and len(sizes) == 8 and max(sizes.values()) < 2.1 * len(rows) / 8
    got = parsing.fingerprint_documents(df, parts=8).collect()
    assert len(got) == len(rows)
    key = lambda r: (-(1 << 63) if r[0] is None else r[0], parsing_hash[r[1]])
    parsing_hash = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=key, reverse=True)
    want = Counter(hashlib.sha256(parsing.edited(a[1], b[1]).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1]))
    assert Counter(r["edited_sha256"] for r in got) == want


def test_parsing_long_text_and_clashing_names(spark):
    df = spark.createDataFrame(
        [("b", "word " * 100_000, 1), ("a", "x", 2), ("7", None, 3)], "t string, fingerprint string, h int"
    )
    got = {r["t"]: r for r in parsing.fingerprint_documents(df, "t", "fingerprint", parts=2).collect()}
    assert {k: r["n_chars"] for k, r in got.items()} == {"b": 500_000, "a": 1, "7": 0}


def test_parsing_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "c"), (2, "d")], "doc_id long, text string")
    for parts in (1, 3):
        assert Counter(r["doc_id"] for r in parsing.fingerprint_documents(df, parts=parts).collect()) == {1: 2, None: 2, 2: 1}


def test_jaccard_long_and_hot(spark, monkeypatch):
    """Chunks are bounded by tokens, and one that many documents ask is answered by copies."""
    monkeypatch.setattr(jaccard, "CHUNK_TOKENS", 2000)
    monkeypatch.setattr(jaccard, "CHUNK_QUERIES", 3)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    base, long = [word() for _ in range(60)], [word() for _ in range(30_000)]
    texts = [" ".join(long), " ".join([*long[:-1], "end"]), " ".join(long[: len(long) // 2])]
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similarity_groups(df).collect()}
    assert [got[k] for k in range(len(texts))] == brute_components(texts, 4, 85)[0]


def test_stored_tables_go(spark, tmp_path, monkeypatch):
    from folioscope import tables as common

    shared = tmp_path / "shared"
    monkeypatch.setattr(common, "shared_dir", lambda _: str(shared))
    with common.scope() as keep:
        common.stored(spark.range(3), "inner")
        out = keep(spark.range(5), "outer")
        common.drop_stored(common.stored(spark.range(2), "dropped"))
        assert sorted(p.name.split("-")[0] for p in shared.iterdir()) == ["inner", "outer"]
    assert out.count() == 5 and [p.name.split("-")[0] for p in shared.iterdir()] == ["outer"]
    common.drop_stored(out)
    assert not list(shared.iterdir())


def slow_lines(rows, ratio=0.05, least=3):
    """Texts without boilerplate, page by page."""
    pages, seen = Counter(r["source"] for r in rows), Counter()
    for r in rows:
        for line in set((r["text"] or "").split("\n")) if r["text"] is not None else ():
            if line.strip(" \t\n\x0b\f\r"):
                seen[r["source"], line] += 1
    drop = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return {
        (
            r["doc_id"],
            None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in drop)
        ) for r in rows
    }


def slow_shares(budget, children):
    """Budget by weight, name to (weight, cap): whoever is full leaves, the others share the rest."""
    out, left, open_ = {}, budget, {k: v for k, v in children.items() if v[0] > 0}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [k for k, (w, cap) in open_.items() if cap * total <= left * w]
        if not full:
            return out | {k: left * w // total for k, (w, _) in open_.items()} | {k: 0 for k in children if children[k][0] == 0}
        for k in full:
            out[k] = open_.pop(k)[1]
        left = max(left - sum(out[k] for k in full), 0)
    return out | {k: 0 for k in children if children[k][0] == 0}


def slow_mixing(rows, mix):
    """The documents that each leaf takes, epoch by epoch."""
    domain = lambda s: f"d{int('0' + (re.search('([0-9]{1,9})$', s or '') or ['', ''])[1]) % 4}"
    n = lambda t: len(re.findall("[^ \t\n\x0b\f\r]+", t or ""))
    weight = lambda table, name: table.get(name, mix.other)
    leaves = {}
    for r in rows:
        leaves.setdefault((domain(r["source"]), r["lang"] or "", r["source"] or ""), []).append(r)
    tables = (mix.domain, mix.lang, mix.source)
    cap = {
        k: sum(n(r["text"]) for r in v) * mix.max_epochs if all(weight(t, x) > 0 for t, x in zip(tables, k)) else 0 for k,
        v in leaves.items()
    }
    budgets = {(): sum(n(r["text"]) for r in rows) * mix.budget_permille // 1000}
    for depth, table in enumerate(tables):
        new = {}
        for parent, budget in budgets.items():
            names = {k[: depth + 1] for k in leaves if k[:depth] == parent}
            new |= slow_shares(
                budget,
                {p: (weight(table, p[-1]), sum(c for k, c in cap.items() if k[: depth + 1] == p)) for p in names}
            )
        budgets = new
    out = Counter()
    for leaf, own in leaves.items():
        supply, epoch = sum(n(r["text"]) for r in own), 0
        while supply and epoch < mix.max_epochs and budgets[leaf] >= (epoch + 1) * supply:
            out.update(r["doc_id"] for r in own)
            epoch += 1
        rest = budgets[leaf] - epoch * supply
        if epoch < mix.max_epochs:
            for r in sorted(
                own,
                key=lambda r: (hashlib.md5(f"{mix.seed}:{epoch}:{r['doc_id']}".encode()).hexdigest(), str(r["doc_id"]))
            ):
                rest -= n(r["text"])
                if rest < 0:
                    break
                out[r["doc_id"]] += 1
    return out


@pytest.mark.parametrize(
    "mix",
    [
        mixing.Mix(), mixing.Mix(budget_permille=900, max_epochs=1, domain={"d0": 3}),
        mixing.Mix(lang={"en": 0}, budget_permille=2000),
        mixing.Mix(domain={}, lang={}, source={"src1": 5}, budget_permille=300)
    ]
)
def test_mixing_is_brute_force(spark, mix):
    rows = [dict(zip(("doc_id", "text", "lang", "source"), r)) for r in small_corpus(300, seed=7)]
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], 0) for r in rows], SCHEMA)
    assert Counter(r["doc_id"] for r in mixing.mix_sources(df, mix).collect()) == slow_mixing(rows, mix)


def test_pipeline_stages_are_brute_force(spark, sf_dir):
    """Quality, lines and mixing on the smallest tables; the Jaccard and BPE stages are held below and elsewhere."""
    import corpus_pipeline as cp

    from .test_text_models import brute_weights

    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in df.collect()]
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    weights = brute_weights([r["text"] for r in rows], [good.get(r["doc_id"]) == 1 for r in rows])
    noise = [((xxhash.xxh3_64_intdigest(f"9:{r['doc_id']}:{r['text']}") >> 11) + 0.5) / 2**53 for r in rows]
    keys = {r["doc_id"]: w - np.log(-np.log(u)) for r, w, u in zip(rows, weights, noise)}
    kept = sorted(r["doc_id"] for r in cp.quality(spark, df, sf_dir).collect())
    assert kept == sorted(sorted(keys, key=keys.get, reverse=True)[: len(kept)]) and 0.6 * len(rows) < len(kept) < len(rows)
    assert {(r["doc_id"], r["text"]) for r in cp.line_dedup(spark, df, sf_dir).collect()} == slow_lines(rows)
    assert Counter(r["doc_id"] for r in cp.mixing_stage(spark, df, sf_dir).collect()) == slow_mixing(rows, cp.MIX)


def test_pipeline_stages_on_edges(spark, sf_dir):
    """Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, more columns."""
    import corpus_pipeline as cp

    rows = [
        (1, None, None, None, None), (None, None, None, None, None), (None, "", "en", "src0", 0),
        (2, "", None, "src0", 0), (2, "", None, "src0", 0), (3, "w " * 200_000, "en", None, 1),
        (3, "w " * 200_000, "en", None, 1), (None, "same text here", "en", "src0", 5),
        (None, "same text here", "en", "src0", 5)
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit(1) for c in ("h", "n", "epoch", "selected", "n_lines", "component_id")}
    )
    for name, stage in cp.STAGES:
        out = stage(spark, df, sf_dir)
        got = out.collect()
        assert stage(spark, df.limit(0), sf_dir).count() == 0
        if name == "byte-level BPE":
            assert len(got) == len(rows)
            continue
        assert out.columns == cp.COLUMNS
        if name == "line dedup":
            assert len(got) == len(rows)
        if name == "n-gram Jaccard join":
            assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(
                {(1, None): 1, (None, None): 1, (None, ""): 1, (2, ""): 1, (3, "w " * 200_000): 1, (None, "same text here"): 1}
            )


def test_near_duplicates_stage(spark):
    import corpus_pipeline as cp

    a, b, c = "a b c d e f g h", "k l m n o p q r", "s t u v w x y z"
    rows = [
        (3, a, "en", "s"), (1, a, "en", "s"), (1, a, "en", "s"), (3, b, "en", "s"), (None, c, "en", "s"),
        (None, c, "de", "s"), (None, b, "en", "s"), (None, a + " a b c", "en", "s")
    ]
    rows += [
        (7, "", "en", "s"), (7, "", "en", "s"), (8, "", "en", "s"), (9, None, "en", "s"), (None, "", "en", "s"),
        (None, None, "en", "s")
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, df, "").select("doc_id", "text").collect())
    # The last text of the first list has 7 shingles, 4 of them a's: no near copy.
    assert got == Counter(
        [(1, a), (3, b), (None, c), (None, a + " a b c"), (7, ""), (8, ""), (9, None), (None, ""), (None, None)]
    )


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = df
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r["doc_id"]: r for r in kept.collect()}
        out = stage(spark, kept, sf_dir)
        after = out.collect()
        assert k == len(cp.STAGES) - 1 or out.columns == cp.COLUMNS
        ids = [r["doc_id"] for r in after]
        assert len(set(ids)) == len(ids) and set(ids) <= set(before)
        if name == "quality":
            assert sum(labels.get(i) == 0 for i in ids) <= 0.2 * sum(v == 0 for v in labels.values())
        elif name == "line dedup":
            assert len(ids) == len(before) and all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "n-gram Jaccard join":
            order = sorted(before)
            roots, _, _ = brute_components([before[i]["text"] for i in order], 5, 80)
            assert sorted(ids) == [i for i, r in zip(order, roots) if order[r] == i]
        elif name == "byte-level BPE":
            assert len(ids) == len(before) and all(r["round_trip"] for r in after)
        if k < len(cp.STAGES) - 1:
            kept = spark.createDataFrame(after, SCHEMA)
    assert rows_of(cp.run(spark, sf_dir).select("doc_id", "ids_sha256"))[1] == sorted(
        (repr(r["doc_id"]), repr(r["ids_sha256"])) for r in after
    )


def test_sketch_reaches_the_driver_in_few_jobs(spark):
    """Not in a job for each shuffle partition, all of which the driver would remember."""
    from folioscope.llm import jaccard

    df = spark.range(40).selectExpr("id i", "concat_ws(' ', sequence(id, id + 30)) x")
    stats = jaccard._stats(df, 4).cache()
    stats.count()
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    sc = spark.sparkContext
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        sc.setJobGroup("sketch", "sketch")
        classes = jaccard.frequency_classes(stats)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
        stats.unpersist()
    assert classes.any() and len(sc.statusTracker().getJobIdsForGroup("sketch")) < 32


def test_few_links_are_joined_in_few_jobs(spark, monkeypatch):
    """In one task, by numbers or strings, with the components that the steps over many links give."""
    import random

    rng = random.Random(5)
    links = [(k, k + 1) for k in range(300)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(300)]
    numbers = spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in links], "a long, b long")
    strings = numbers.selectExpr("concat('n', a) a", "concat('n', b) b")
    sc = spark.sparkContext
    found = {}
    for few in (1 << 17, 0):
        monkeypatch.setattr(components, "FEW", few)
        sc.setJobGroup(f"few {few}", "few")
        try:
            found[few] = [rows_of(components.components(df))[1] for df in (numbers, strings)]
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1 << 17] and len(found[0][0]) > 500
    jobs = {few: len(sc.statusTracker().getJobIdsForGroup(f"few {few}")) for few in found}
    assert jobs[1 << 17] <= 16 and jobs[0] > 40, jobs
