"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, importance, jaccard, langid, licenses, lines, mixing, ogg, parsing, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_lines": lines.op2_lines,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_langid": langid.op5_langid,
    "op6_ogg": ogg.op6_ogg,
    "op7_parsing": parsing.op7_parsing,
    "op8_licenses": licenses.op8_licenses,
    "op9_quality": importance.op9_quality,
    "op10_mixing": mixing.op10_mixing,
}

SQL: dict[str, str] = {
    "op2_lines": lines.OP2_SQL,
    "op8_licenses": licenses.licenses_sql(),
    "op10_mixing": mixing.mixing_sql(),
}
