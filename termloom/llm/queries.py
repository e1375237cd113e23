"""The registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from termloom.llm import (
    bpe, jaccard, licenses, mixing, periods, phrases, quality, repeats, secrets, sharding, tokenfile, topk,
    winnowing,
)

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_mixture": mixing.op4_mixture,
    "op5_top_k": topk.op5_top_k,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_token_files": tokenfile.op7_token_files,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_repeats": repeats.op9_repeats,
    "op10_shards": sharding.op10_shards,
    "op11_decontamination": winnowing.op11_decontamination,
    "op12_phrases": phrases.op12_phrases,
    "op13_periodic_runs": periods.op13_periodic_runs,
}
ORACLE = {
    "op2_quality_rules": quality.OP2_SQL,
    "op3_license_scan": licenses.OP3_SQL,
    "op5_top_k": topk.OP5_SQL,
    "op11_decontamination": winnowing.OP11_SQL,
    "op12_phrases": phrases.OP12_SQL,
}
