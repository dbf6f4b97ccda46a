"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, decontam, langid, licenses, lm, packing, quality, simhash, substrings, tokenfile, toxicity, trie, whitening

QUERIES = {
    "op1_byte_bpe": bpe.query,
    "op2_substring_dedup": substrings.query,
    "op3_lm_score": lm.query,
    "op4_language_id": langid.query,
    "op5_license_scan": licenses.query,
    "op6_token_file": tokenfile.query,
    "op7_toxicity": toxicity.query,
    "op8_simhash": simhash.query,
    "op9_quality_rules": quality.query,
    "op10_decontamination": decontam.query,
    "op11_best_fit_packing": packing.query,
    "op12_prefix_trie": trie.query,
    "op13_embedding_whitening": whitening.query,
}

#: The other operators' results can't be written in SQL: tokenizers, models, compression, XXH64.
ORACLE: dict[str, str] = {
    "op2_substring_dedup": substrings.SQL,
    "op9_quality_rules": quality.SQL,
    "op10_decontamination": decontam.SQL,
    "op12_prefix_trie": trie.SQL,
}
