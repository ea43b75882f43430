"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, codes, fingerprint, packing, parity_join, phrases, pieces, quality_cnn, quality_rules, simhash, substring_dedup, url_filter, warc

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_sentencepiece_dropout": pieces.op2_sentencepiece_dropout,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_quality_classifier": quality_cnn.op4_quality_classifier,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_packing": packing.op6_packing,
    "op7_simhash": simhash.op7_simhash,
    "op8_warc": warc.op8_warc,
    "op9_chat_format": chat.op9_chat_format,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_jaccard_join": parity_join.op11_jaccard_join,
    "op12_phrases": phrases.op12_phrases,
    "op13_vector_codes": codes.op13_vector_codes,
}

SQL = {"op5_url_filter": url_filter.SQL, "op8_warc": warc.SQL, "op9_chat_format": chat.SQL, "op11_jaccard_join": parity_join.SQL, "op12_phrases": phrases.SQL, "op13_vector_codes": codes.SQL}
