"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kontor.llm import bpe, dac, fingerprints, langid, lengths, mixing, preferences, simhash, topk, url_templates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_topk": topk.op2_topk,
    "op3_token_files": dac.op3_token_files,
    "op4_url_templates": url_templates.op4_url_templates,
    "op5_preferences": preferences.op5_preferences,
    "op6_simhash": simhash.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_language": langid.op8_language,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_token_counts": lengths.op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op2_topk": topk.OP2_SQL,
    "op4_url_templates": url_templates.OP4_SQL,
    "op5_preferences": preferences.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
}
