"""The queries of this subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import exact_dedup, importance, jaccard_join, language_id, license_scan, minhash_dedup, sentencepiece_codec, source_mixing, suffix_dedup, topk_search, url_filters, vector_codes, warc

QUERIES = {
    "op1_url_filters": url_filters.query,
    "op2_language_id": language_id.query,
    "op3_source_mixing": source_mixing.query,
    "op4_sentencepiece": sentencepiece_codec.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_topk_search": topk_search.query,
    "op8_minhash_dedup": minhash_dedup.query,
    "op9_warc": warc.query,
    "op10_license_scan": license_scan.query,
    "op11_vector_codes": vector_codes.query,
    "op12_jaccard_join": jaccard_join.query,
    "op13_importance": importance.query,
}

ORACLES = {
    "op3_source_mixing": source_mixing.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op7_topk_search": topk_search.ORACLE,
    "op8_minhash_dedup": minhash_dedup.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_jaccard_join": jaccard_join.ORACLE,
    "op13_importance": importance.ORACLE,
}
