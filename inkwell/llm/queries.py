"""The operators of this subpackage as queries, and their check statements where SQL can express them."""

from __future__ import annotations

from inkwell.llm import (
    bpe, conversations, decontamination, exactdedup, filteraudit, hostrules, langid, quality, secrets, sharding, simhash, tokenfiles, toxicity,
)

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_bpe_codec": bpe.op2_bpe_codec,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_language_id": langid.op4_language_id,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_exact_dedup": exactdedup.op6_exact_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_files": tokenfiles.op9_token_files,
    "op10_benchmark_decontamination": decontamination.op10_benchmark_decontamination,
    "op11_filter_audit": filteraudit.op11_filter_audit,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_host_rules": hostrules.op13_host_rules,
}
STATEMENTS: dict[str, str] = {
    "op5_secret_scan": secrets.OP5_SQL,
    "op6_exact_dedup": exactdedup.OP6_SQL,
    "op11_filter_audit": filteraudit.OP11_SQL,
    "op13_host_rules": hostrules.OP13_SQL,
}
