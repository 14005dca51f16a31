"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, ctph, langid, mixing, pii, quality, secrets, simhash, tokens, urls

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_pii": pii.op2_pii,
    "op3_url_filters": urls.op3_url_filters,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_document_fingerprints": ctph.op5_document_fingerprints,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_language_id": langid.op10_language_id,
}

#: The others can't be written as SQL, or not to run over whole tables; they have brute-force tests instead.
ORACLES = {
    "op3_url_filters": urls.op3_sql(),
    "op4_source_mixing": mixing.op4_sql(),
}
