"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

import corpus_pipeline

from . import chat, clustering, embeddings, exact_dedup, katz, lexical, licenses, mixing, packing, secrets, simhash, topk, toxicity

QUERIES = {
    "op1_toxicity_ordinal": toxicity.op1_toxicity_ordinal,
    "op2_target_mix": mixing.op2_target_mix,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_cost_packing": packing.op4_cost_packing,
    "op5_license_diagonals": licenses.op5_license_diagonals,
    "op6_embedding_itq": embeddings.op6_embedding_itq,
    "op7_chat_template": chat.op7_chat_template,
    "op8_secret_ledger": secrets.op8_secret_ledger,
    "op9_katz_backoff": katz.op9_katz_backoff,
    "op10_simhash_neardup": simhash.op10_simhash_neardup,
    "op11_sorted_accumulation": lexical.op11_sorted_accumulation,
    "op12_segment_statistics": topk.op12_segment_statistics,
    "op13_block_norms": clustering.op13_block_norms,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op3_exact_dedup": exact_dedup.ORACLE, "op5_license_diagonals": licenses.ORACLE, "op6_embedding_itq": embeddings.ORACLE, "op7_chat_template": chat.ORACLE, "op8_secret_ledger": secrets.ORACLE, "op11_sorted_accumulation": lexical.ORACLE, "op12_segment_statistics": topk.ORACLE, "op13_block_norms": clustering.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
