"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from folioloom.llm import chat, covertree, hnsw, katz, langid, lexical, merkle, packing, pii, piece_codec, quality, simhash, toxicity

QUERIES = {
    "op1_simhash": simhash.op1,
    "op2_chat": chat.op2,
    "op3_katz": katz.op3,
    "op4_packing": packing.op4,
    "op5_hnsw": hnsw.op5,
    "op6_toxicity": toxicity.op6,
    "op7_sentencepiece": piece_codec.op7,
    "op8_cover_tree": covertree.op8,
    "op9_pii": pii.op9,
    "op10_quality": quality.op10,
    "op11_lexical": lexical.op11,
    "op12_langid": langid.op12,
    "op13_merkle": merkle.op13,
}

ORACLE: dict[str, str] = {
    "op2_chat": chat.OP2_SQL,
    "op8_cover_tree": covertree.OP8_SQL,
    "op11_lexical": lexical.OP11_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
