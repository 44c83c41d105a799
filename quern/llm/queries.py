"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import op01_bpe, op02_line_dedup, op03_minhash, op04_fingerprint, op05_warc, op06_url_filter, op07_suffix_dedup, op08_mixing, op09_language, op10_quality

QUERIES = {
    "op1_bpe": op01_bpe.op1_bpe,
    "op2_line_dedup": op02_line_dedup.op2_line_dedup,
    "op3_minhash": op03_minhash.op3_minhash,
    "op4_fingerprint": op04_fingerprint.op4_fingerprint,
    "op5_warc": op05_warc.op5_warc,
    "op6_url_filter": op06_url_filter.op6_url_filter,
    "op7_suffix_dedup": op07_suffix_dedup.op7_suffix_dedup,
    "op8_mixing": op08_mixing.op8_mixing,
    "op9_language": op09_language.op9_language,
    "op10_quality": op10_quality.op10_quality,
}

ORACLE_SQL = {
    "op2_line_dedup": op02_line_dedup.ORACLE_SQL,
    "op3_minhash": op03_minhash.ORACLE_SQL,
    "op5_warc": op05_warc.ORACLE_SQL,
    "op6_url_filter": op06_url_filter.ORACLE_SQL,
    "op7_suffix_dedup": op07_suffix_dedup.ORACLE_SQL,
}
