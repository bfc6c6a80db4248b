"""Registered queries of the corpus operators and the oracles of those that SQL can express."""

from . import chat, htmltext, minhash, mixing, packing, pii, quality, repair, tokenids, toxicity, vectors, warc, whitening

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_token_ids": tokenids.op2_token_ids,
    "op3_minhash_dedup": minhash.op3_minhash_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_mixing": mixing.op6_mixing,
    "op7_chat_rotation": chat.op7_chat_rotation,
    "op8_vector_dedup": vectors.op8_vector_dedup,
    "op9_html_text": htmltext.op9_html_text,
    "op10_warc": warc.op10_warc,
    "op11_structure_repair": repair.op11_structure_repair,
    "op12_whitening": whitening.op12_whitening,
    "op13_toxicity": toxicity.op13_toxicity,
}
ORACLES = {
    "op3_minhash_dedup": minhash.ORACLE,
    "op4_quality_rules": quality.ORACLE,
    "op7_chat_rotation": chat.ORACLE,
    "op8_vector_dedup": vectors.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_structure_repair": repair.ORACLE,
}
