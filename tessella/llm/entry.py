"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, conversations, embedding_dedup, language_model, licenses, merkle, mixing, packing, pii, secrets, simhash, topk, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_secrets": secrets.op2_secrets,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_licenses": licenses.op4_licenses,
    "op5_pii": pii.op5_pii,
    "op6_packing": packing.op6_packing,
    "op7_language_model": language_model.op7_language_model,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash": simhash.op9_simhash,
    "op10_topk": topk.op10_topk,
    "op11_merkle": merkle.op11_merkle,
    "op12_bpe": bpe.op12_bpe,
    "op13_conversations": conversations.op13_conversations,
}

SQL = {"op1_mixing": mixing.OP1_SQL, "op3_embedding_dedup": embedding_dedup.OP3_SQL, "op10_topk": topk.OP10_SQL, "op11_merkle": merkle.OP11_SQL, "op13_conversations": conversations.OP13_SQL}
