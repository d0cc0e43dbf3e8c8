"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from lumenframe.llm import bpe, decontaminate, linededup, pii, quality, sharding, simhash, substring, warc, wrapper

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_html": wrapper.op2_html,
    "op3_quality": quality.op3_quality,
    "op4_sharding": sharding.op4_sharding,
    "op5_pii": pii.op5_pii,
    "op6_substring": substring.op6_substring,
    "op7_warc": warc.op7_warc,
    "op8_linededup": linededup.op8_linededup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality": quality.OP3_SQL,
    "op6_substring": substring.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
}
