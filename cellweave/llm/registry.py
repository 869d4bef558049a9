"""The registered corpus queries and their SQL oracles."""

from __future__ import annotations

from cellweave.llm import alignment, decontaminate, html_text, language_model, mixing, ngram_join, quality, secrets, simhash, substring, token_counts, warc, whitening

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_simhash_dedup": simhash.op3_simhash_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_lm_score": language_model.op6_lm_score,
    "op7_html_text": html_text.op7_html_text,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_warc_derivatives": warc.op10_warc_derivatives,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_ngram_jaccard": ngram_join.op12_ngram_jaccard,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}

ORACLE_SQL = {
    "op2_substring_dedup": substring.ORACLE_SQL,
    "op4_decontaminate": decontaminate.ORACLE_SQL,
    "op5_secret_scan": secrets.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
    "op12_ngram_jaccard": ngram_join.ORACLE_SQL,
}
