"""The queries of this subpackage and their SQL."""

from . import conversation_repair, decontaminate, filter_audit, line_quality, mixing, ngram_join, personal_data, quality_rules, suffix_dedup, token_counts, token_files, toxicity, url_reputation

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_source_mixing": mixing.query,
    "op3_token_files": token_files.query,
    "op4_decontamination": decontaminate.query,
    "op5_toxicity": toxicity.query,
    "op6_personal_data": personal_data.query,
    "op7_line_quality": line_quality.query,
    "op8_quality_rules": quality_rules.query,
    "op9_ngram_join": ngram_join.query,
    "op10_url_reputation": url_reputation.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_filter_audit": filter_audit.query,
    "op13_token_counts": token_counts.query,
}
SQL = {
    "op1_suffix_dedup": suffix_dedup.SQL,
    "op2_source_mixing": mixing.SQL,
    "op4_decontamination": decontaminate.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op9_ngram_join": ngram_join.SQL,
    "op10_url_reputation": url_reputation.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
