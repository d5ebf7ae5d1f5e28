import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import markdown as M
from folioscope.functions import text as T
from folioscope.functions.options import CleanerOptions, NormalizeOptions


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", expr.alias("o")).collect()
    return [r["o"] for r in sorted(rows)]


def around(line):
    return f"before {line.lower()[:1]}1\n{line}\nafter it"


#: Lines that say a page number, made from the parts they may have.
PAGE_LINES = [
    f"{word}{dot} 5{rest}" for word,
    dot in (
        ("Página", ""), ("pagina", ""), ("Pág", "."), ("PAG", ""), ("P", "."), ("p", ".")
    ) for rest in ("", " de 31", "/31", " - 31")
]
CLEAN = [
    *[(around(line), ["**[Página 5]**", "---", "before", "after it"], [f"\n{line}\n"]) for line in PAGE_LINES],
    ("x\n07/11/2031 08:15 Pág. 9 de 12\ny", ["**[Página 9]**"], ["07/11", "08:15"]),
    ("x.\nPágina 3\ny", ["x.\n\n---\n\n**[Página 3]**\n\n---\n\ny"], []),
    ("see Página 3 for more", ["see Página 3 for more"], ["**"]),
    ("q <!--  --> r <!---->", ["q  r "], ["<!--"]),
    ("q " + "_" * 6 + " r", ["q  r"], ["_"]),
    ("q " + "_" * 5 + " r", ["_____"], []),
    ("q" + "\n" * 7 + "r", ["q\n\nr"], []),
    ("q\n\t\n   \n \t \nr", ["q\n\nr"], []),
    ("q\r\nr\rs", ["q\nr\ns"], []),
    ("P 3\nPagar 3\nPlano 3", ["P 3\nPagar 3\nPlano 3"], ["**"]),
    ("  \tq\nr", ["  \tq\nr"], []),
]


def test_cleaner_cases(spark):
    got = column(spark, [c[0] for c in CLEAN], T.clean_markdown(F.col("t")))
    for out, (text, inside, outside) in zip(got, CLEAN):
        assert all(s in out for s in inside) and not any(s in out for s in outside), (text, out)


def test_cleaner_edges(spark):
    assert column(spark, [None, "", "Página 1\nx", "\n \nPágina 1\nx"], T.clean_markdown(F.col("t")))[:2] == ["", ""]
    for out in column(spark, ["Página 1\nx", "\n\nPágina 1\nx"], T.clean_markdown(F.col("t"))):
        assert out.startswith("**[Página 1]**")
    out = column(
        spark, ["q\nPágina 2 Borrador\nr"], T.clean_markdown(F.col("t"), CleanerOptions(extra_keywords=("Borrador",)))
    )[0]
    assert "**[Página 2]**" in out and "Borrador" not in out
    once = column(spark, [CLEAN[0][0]], T.clean_markdown(F.col("t")))
    assert column(spark, once, T.clean_markdown(F.col("t"))) == once


#: Pieces of white space between letters, and what the defaults make of each.
BETWEEN = [("\n" * k, "\n" * min(k, 2)) for k in (1, 2, 3, 6)] + [(" " * k, " ") for k in (1, 2, 5)] + [
    (" \n", "\n"), ("\n  ", "\n"), ("\t", " "), ("\t \t", " "), ("\r\n", "\n"), ("\r", "\n"), ("\u00a0", " "),
    ("\u3000\u2003", " "), ("\u200b", ""), ("\ufeff\u2060", "")
]
NORMAL = [
    (None, ""), ("", ""), (" \t ", ""), *[(f"q{a}r", f"q{b}r") for a, b in BETWEEN],
    ("".join(f"{a}q" for a, _ in BETWEEN), "".join(f"{b}q" for _, b in BETWEEN).lstrip())
]


def test_normalize_cases(spark):
    assert column(spark, [c[0] for c in NORMAL], T.normalize_text(F.col("t"))) == [c[1] for c in NORMAL]
    assert [T.normalize_row(a, NormalizeOptions()) for a, _ in NORMAL] == [b for _, b in NORMAL]


@pytest.mark.parametrize("options, text, out", [
    (NormalizeOptions(trim_line_end=False), "a \n \nb", "a  \n\nb"), (NormalizeOptions(trim_line_end=False), "  \n b", " \nb"),
    (NormalizeOptions(convert_tabs=False), "  \tb", " \tb"), (NormalizeOptions(spaces_per_tab=0), "a\tb", "ab"),
    (NormalizeOptions(trim_block=False), " a \n\n ", "a\n\n"),
    (NormalizeOptions(collapse_newlines=False), "a\n\n\n\nb", "a\n\n\n\nb"),
    (NormalizeOptions(max_newlines=1), "a\n\nb", "a\nb"), (NormalizeOptions(collapse_spaces=False), "a   b", "a   b"),
])
def test_normalize_options(spark, options, text, out):
    assert column(spark, [text], T.normalize_text(F.col("t"), options)) == [out]


noise = st.text(alphabet="ab.,-#*=>1 \t\n\r ​ é😀Pág5/", max_size=40)


@settings(max_examples=5, deadline=None)
@given(st.lists(noise, min_size=30, max_size=60))
def test_chain_is_the_machine(spark, texts):
    assert column(spark, texts, T.normalize_text(F.col("t"))) == [T.normalize_row(t, NormalizeOptions()) for t in texts]


def model_escape(line):
    if m := re.match(r"(\s*)(\d{1,9})([.)])(\s|$)", line):
        return line[: m.end(2)] + "\\" + line[m.end(2) :]
    body = line.lstrip(" \t")
    if not body:
        return line
    first, rest = body[0], body[1:]
    opens = first == ">" or first in "#+*-" and (not rest or rest[0] in " \t") or first in "-=" and not set(body) - {first, " ", "\t"}
    return line[: len(line) - len(body)] + ("\\" if opens else "") + body


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab-=#*>+1.) \t\n", max_size=20), min_size=30, max_size=60))
def test_escape_line_start(spark, texts):
    from folioscope.sources.html import escape_line

    want = ["\n".join(map(model_escape, t.split("\n"))) for t in texts]
    assert column(spark, texts, M.escape_line_start(F.col("t"))) == want
    assert ["\n".join(map(escape_line, t.split("\n"))) for t in texts] == want


def test_tokens(spark):
    got = column(spark, [None, "", "x" * 200, "a b c d", "😀" * 4], T.estimate_tokens(F.col("t"), "cl100k"))
    assert got == [0, 0, 56, 4, 3]
    m = spark.range(1).select(T.normalize_with_metrics(F.lit("a   b")).alias("m")).first()["m"]
    assert (m.text, m.original_chars, m.saved_chars, m.reduction_pct) == ("a b", 5, 2, 40.0)


def test_streaming_runs_the_batch_functions(spark, tmp_path, sf_dir):
    from folioscope.streaming.documents import prepared, read_stream

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.write.parquet(str(tmp_path / "in"))
    q = prepared(read_stream(spark, str(tmp_path / "in"), docs.schema)).writeStream.format("memory").queryName("prepared").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("prepared").collect())) == sorted(map(tuple, prepared(docs).collect()))
