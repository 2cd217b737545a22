"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contamination, filter_audit, flat_tokens, html, infill, jaccard, licenses, neighbours, quality, secrets, sharding, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_shards": sharding.op3_shards,
    "op4_html": html.op4_html,
    "op5_secrets": secrets.op5_secrets,
    "op6_contamination": contamination.op6_contamination,
    "op7_licences": licenses.op7_licences,
    "op8_token_counts": flat_tokens.op8_token_counts,
    "op9_byte_bpe": tokens.op9_byte_bpe,
    "op10_neighbours": neighbours.op10_neighbours,
    "op11_infill": infill.op11_infill,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_warc": warc.op13_warc,
}
ORACLES: dict[str, str] = {
    "op2_jaccard": jaccard.OP2_SQL,
    "op6_contamination": contamination.OP6_SQL,
    "op11_infill": infill.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_warc": warc.OP13_SQL,
}
