"""The corpus operators' queries and their DuckDB counterparts."""

from __future__ import annotations

from sondage.llm import ann, byte_bpe, centroids, chat_format, divergence, exact_dedup, licenses, ngram_join, packing, quality, secrets, token_files, toxicity

QUERIES = {
    "op1_pack": packing.query_op1,
    "op2_quality": quality.query_op2,
    "op3_chat_format": chat_format.query_op3,
    "op4_byte_bpe": byte_bpe.query_op4,
    "op5_secrets": secrets.query_op5,
    "op6_toxicity": toxicity.query_op6,
    "op7_ann": ann.query_op7,
    "op8_ngram_join": ngram_join.query_op8,
    "op9_exact_dedup": exact_dedup.query_op9,
    "op10_licenses": licenses.query_op10,
    "op11_divergence": divergence.query_op11,
    "op12_centroids": centroids.query_op12,
    "op13_token_files": token_files.query_op13,
}
ORACLES = {
    "op3_chat_format": chat_format.ORACLE_OP3,
    "op9_exact_dedup": exact_dedup.ORACLE_OP9,
    "op10_licenses": licenses.ORACLE_OP10,
    "op11_divergence": divergence.ORACLE_OP11,
    "op12_centroids": centroids.ORACLE_OP12,
}
