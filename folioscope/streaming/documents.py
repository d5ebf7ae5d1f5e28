"""Stateless text operators on streams.

The column functions are the batch ones; a stream of documents goes through them unchanged and needs
no state, watermark or Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clean_markdown, estimate_tokens, normalize_with_metrics


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def prepared(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Cleaned and normalised text with its metrics and token estimate; works on batches and streams."""
    m = normalize_with_metrics(clean_markdown(F.col(text_col)))
    out = df.withColumn("__m", m)
    kept = [c for c in df.columns if c != text_col]
    return out.select(
        *kept, F.col("__m.text").alias(text_col), "__m.original_chars", "__m.result_chars", "__m.reduction_pct",
        estimate_tokens(F.col("__m.text")).alias("tokens")
    )
