"""The corpus pipeline: stages over ``documents``, each applying one training-data operator.

Every stage works on all rows its predecessor kept and, but for the last, returns the columns of
``documents``; the last returns the token digests of what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, importance, jaccard, lines, mixing
from folioscope.llm.common import docs, drop_stored, prepare, scope, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: One pass over what is left, by equal weights; so a source is cut only where it holds far more
#: than its share, and nothing repeats.
MIX = mixing.Mix(domain={}, lang={}, source={}, budget_permille=950, max_epochs=1)


def quality(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; rows of null id are weighed by their text alone."""
    picked = importance.resample(df, docs(spark, sf_dir, "labels"), carry=True)
    return picked.filter("selected").select(*COLUMNS)


def line_dedup(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; ``n_chars`` follows the text.

    Documents of nothing but boilerplate stay, with an empty text.
    """
    return lines.drop_boilerplate(df).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8): the one with the smallest id, null ids last.

    Texts are grouped, not ids, so rows that share an id but not a text are separate documents and
    rows of null id are compared like any other.  Among equal ids the text's hash decides; rows that
    repeat an id and a text are one document.  Texts without words are no copies of each other and
    all stay, but for rows that repeat the id too.
    """
    rows = df.select(*COLUMNS).withColumn("__h", F.xxhash64("text"))
    # What has one row for each text or group is written before it is joined, so that Spark can split the rows of a large one.
    groups = jaccard.similarity_groups(rows, id_col="__h", size=5, percent=80).groupBy("__h").agg(
        F.first("n_shingles").alias("n"), F.first("component_id").alias("c")
    )
    groups = stored(groups, "groups")
    keys = rows.groupBy("doc_id", "__h").agg(F.count("*").alias("copies")).join(groups, "__h")
    keys = stored(keys.select("doc_id", "__h", "copies", "n", "c"), "keys")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("__h").alias("h"))
    first = stored(keys.filter("n > 0").groupBy("c").agg(F.min(place).alias("first")), "first")
    dropped = keys.filter("n > 0").join(first, "c").filter(place != F.col("first")).select("doc_id", "__h")
    kept = rows.join(
        dropped.select(F.col("doc_id").alias("i"), F.col("__h").alias("h")), F.expr("doc_id <=> i and __h = h"),
        "left_anti"
    )
    again = keys.filter("copies > 1 and (n > 0 or doc_id is not null)").select(
        F.col("doc_id").alias("i"), F.col("__h").alias("h")
    )
    if again.limit(1).count():
        same = F.expr("doc_id <=> i and __h = h")
        kept = kept.join(again, same, "left_anti").unionByName(
            kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "__h"])
        )
    return kept.select(*COLUMNS)


def mixing_stage(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    """Documents selected towards the target weights."""
    return mixing.mix_sources(df, MIX).select(*COLUMNS)


def tokenize(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_documents(df, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixing_stage),
    ("byte-level BPE", tokenize),
]

#: The first stage is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again.

    What a stage wrote on its way goes when its result is written, and a result when its successor's is.
    """
    prepare(spark)
    df = docs(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        with scope() as keep:
            after = keep(stage(spark, df, sf_dir), "stage")
        drop_stored(df)
        df = after
    return STAGES[-1][1](spark, df, sf_dir)
