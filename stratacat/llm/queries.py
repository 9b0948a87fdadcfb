"""The queries of this subpackage and their DuckDB SQL, where SQL can express one."""

from __future__ import annotations

from stratacat.llm import chat, decontam, html, mixing, pii, quality, simhash, suffix, tokens, urls

QUERIES = {
    "op1_quality_outliers": quality.op1,
    "op2_suffix_repeats": suffix.op2,
    "op3_html_main_text": html.op3,
    "op4_url_cascade": urls.op4,
    "op5_separator_scan": tokens.op5,
    "op6_simhash_near_duplicates": simhash.op6,
    "op7_spaced_seed_leaks": decontam.op7,
    "op8_chat_round_trip": chat.op8,
    "op9_mix_sources": mixing.op9,
    "op10_pii_spans": pii.op10,
}
ORACLES = {"op7_spaced_seed_leaks": decontam.SQL, "op4_url_cascade": urls.SQL, "op8_chat_round_trip": chat.SQL, "op9_mix_sources": mixing.SQL}
