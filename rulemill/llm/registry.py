"""The subpackage's queries and their SQL, by name."""

from . import ann, decontaminate, embedding_dedup, lm_score, near_dedup, packing, pii, quality, source_audit, spelling, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_lm_score": lm_score.query,
    "op2_quality": quality.query,
    "op3_packing": packing.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_pii": pii.query,
    "op6_toxicity": toxicity.query,
    "op7_decontaminate": decontaminate.query,
    "op8_near_dedup": near_dedup.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_ann": ann.query,
    "op11_source_audit": source_audit.query,
    "op12_spelling": spelling.query,
    "op13_embedding_dedup": embedding_dedup.query,
}
ORACLE_SQL = {
    "op4_substring_dedup": substring_dedup.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op8_near_dedup": near_dedup.ORACLE_SQL,
    "op9_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op11_source_audit": source_audit.ORACLE_SQL,
    "op12_spelling": spelling.ORACLE_SQL,
    "op13_embedding_dedup": embedding_dedup.ORACLE_SQL,
}
