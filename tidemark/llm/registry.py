"""Queries of the corpus operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from tidemark.llm import conversations, cotraining, jaccard, languages, licenses, mixing, packing, repeats, resampling, rules, scoring, token_files, vectors

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_licenses": licenses.op3_licenses,
    "op4_nearest": vectors.op4_nearest,
    "op5_scoring": scoring.op5_scoring,
    "op6_rules": rules.op6_rules,
    "op7_repeats": repeats.op7_repeats,
    "op8_mixing": mixing.op8_mixing,
    "op9_cotraining": cotraining.op9_cotraining,
    "op10_token_files": token_files.op10_token_files,
    "op11_languages": languages.op11_languages,
    "op12_conversations": conversations.op12_conversations,
    "op13_resampling": resampling.op13_resampling,
}
ORACLES = {
    "op4_nearest": vectors.OP4_SQL,
    "op8_mixing": mixing.OP8_SQL,
}
