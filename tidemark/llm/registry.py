"""Queries of this package and their SQL twins."""

from tidemark.llm import (
    decontaminate,
    fill_middle,
    html_text,
    licenses,
    mixing,
    nearest,
    ngram_join,
    quality,
    spelling,
    substring_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_licenses": licenses.query,
    "op2_html_text": html_text.query,
    "op3_ngram_join": ngram_join.query,
    "op4_token_counts": token_counts.query,
    "op5_mixing": mixing.query,
    "op6_nearest": nearest.query,
    "op7_toxicity": toxicity.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_decontaminate": decontaminate.query,
    "op11_quality_rules": quality.query,
    "op12_spelling": spelling.query,
    "op13_fill_middle": fill_middle.query,
}
ORACLES = {
    "op1_licenses": licenses.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op11_quality_rules": quality.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}
