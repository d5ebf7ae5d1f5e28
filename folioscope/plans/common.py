"""Input tables of the queries, and noise that gives the text operators work to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def noisy(text: Column, key: Column) -> Column:
    """Tabs, wide and zero-width spaces, carriage returns, page lines and artefacts, by a key."""
    page = F.concat(F.lit("\nPágina "), (key % 40 + 1).cast("string"), F.when(key % 3 == 0, " de 40").otherwise(""), F.lit("\n"))
    x = F.replace(text, F.lit(". "), F.lit(". ​  \r\n"))
    x = F.replace(x, F.lit(", "), F.lit(",\t\t <!-- --> ________ "))
    x = F.concat(
        F.when(key % 4 == 0, "  \n").otherwise(""),
        F.when(key % 5 == 0, F.concat(F.lit("Pág. "), (key % 7 + 1).cast("string"), F.lit("\n"))).otherwise(""), x
    )
    return F.concat(x, F.lit("\r\n \t\n\n\n\n01/02/2024 10:30"), page, F.lit("carátula PAG 3/9\n* x\n# y\n12. z\n=== \n  "), text)


NOISY_SQL = """
CASE WHEN {k} % 4 = 0 THEN '  ' || chr(10) ELSE '' END || CASE WHEN {k} % 5 = 0 THEN 'Pág. ' || ({k} % 7 + 1) || chr(10) ELSE '' END ||
replace(replace({t}, '. ', '.' || chr(160) || chr(8203) || '  ' || chr(13) || chr(10)), ', ', ',' || chr(9) || chr(9) || ' <!-- --> ________ ') ||
chr(13) || chr(10) || ' ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10) || '01/02/2024 10:30' ||
chr(10) || 'Página ' || ({k} % 40 + 1) || CASE WHEN {k} % 3 = 0 THEN ' de 40' ELSE '' END || chr(10) ||
'carátula PAG 3/9' || chr(10) || '* x' || chr(10) || '# y' || chr(10) || '12. z' || chr(10) || '=== ' || chr(10) || '  ' || {t}
"""


def noisy_sql(text: str = "text", key: str = "doc_id") -> str:
    return "(" + NOISY_SQL.format(t=text, k=key).strip().replace("\n", " ") + ")"
