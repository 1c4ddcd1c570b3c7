"""The registered corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontamination, html_text, jaccard, media, mixing, oracles, sharding, suffixes, toxicity, urls

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_html_text": html_text.op2_html_text,
    "op3_mix": mixing.op3_mix,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_media": media.op5_media,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_url_filter": urls.op8_url_filter,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_chat_format": chat.op10_chat_format,
}
ORACLES = {
    "op3_mix": mixing.ORACLE,
    "op4_ngram_jaccard": oracles.JACCARD,
    "op6_decontamination": decontamination.ORACLE,
    "op7_suffix_dedup": oracles.REPEATS,
    "op8_url_filter": urls.ORACLE,
    "op10_chat_format": chat.ORACLE,
}
