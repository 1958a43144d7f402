"""The queries of this subpackage and, where SQL can state them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, decontam, langid, nearest, pitman_yor, secrets, setjoin, spelling, substrings, token_files, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": langid.op1_language_id,
    "op2_nearest": nearest.op2_nearest,
    "op3_jaccard_join": setjoin.op3_jaccard_join,
    "op4_url_filter": urls.op4_url_filter,
    "op5_secrets": secrets.op5_secrets,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pitman_yor": pitman_yor.op7_pitman_yor,
    "op8_bpe": bpe.op8_bpe,
    "op9_decontaminate": decontam.op9_decontaminate,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_token_files": token_files.op12_token_files,
    "op13_token_alignment": alignment.op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op2_nearest": nearest.ORACLE,
    "op3_jaccard_join": setjoin.ORACLE,
    "op4_url_filter": urls.ORACLE,
    "op5_secrets": secrets.ORACLE,
    "op9_decontaminate": decontam.ORACLE,
    "op10_substring_dedup": substrings.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
}
