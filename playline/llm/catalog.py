"""Registry of the training-data operators' queries and their DuckDB statements."""

from __future__ import annotations

from playline.llm import (alignment, bpe, conversations, decontaminate, fingerprint, jaccard, language, mixing, pages, pii,
                          quality, secrets, substring)

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_pii": pii.op4_pii,
    "op5_language": language.op5_language,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_html": pages.op7_html,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_bpe": bpe.op9_bpe,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_decontaminate": decontaminate.op11_decontaminate,
    "op12_alignment": alignment.op12_alignment,
    "op13_conversations": conversations.op13_conversations,
}
ORACLES = {
    "op1_secret_scans": secrets.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op8_jaccard_join": jaccard.ORACLE,
    "op10_substring_dedup": substring.ORACLE,
    "op11_decontaminate": decontaminate.ORACLE,
    "op13_conversations": conversations.ORACLE,
}
