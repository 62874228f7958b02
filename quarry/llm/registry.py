"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, iblt, language, mixing, packing, pii, secrets, simhash, substrings, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_embeddings": embeddings.op2_embeddings,
    "op3_fingerprints": iblt.op3_fingerprints,
    "op4_mixing": mixing.op4_mixing,
    "op5_warc": warc.op5_warc,
    "op6_substrings": substrings.op6_substrings,
    "op7_packing": packing.op7_packing,
    "op8_language": language.op8_language,
    "op9_simhash": simhash.op9_simhash,
    "op10_secrets": secrets.op10_secrets,
}
ORACLE_SQL: dict[str, str] = {
    "op2_embeddings": embeddings.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_substrings": substrings.OP6_SQL,
}
