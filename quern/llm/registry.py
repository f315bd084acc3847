"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, codebooks, langid, licences, media, mixing, resampling, runs, sentencepieces, simhash, sketches, suffixes, surrogates

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_langid_crf": langid.op2_langid_crf,
    "op3_mixing": mixing.op3_mixing,
    "op4_lookup_sketch": sketches.op4_lookup_sketch,
    "op5_media_avi": media.op5_media_avi,
    "op6_simhash": simhash.op6_simhash,
    "op7_importance_resampling": resampling.op7_importance_resampling,
    "op8_sentencepiece": sentencepieces.op8_sentencepiece,
    "op9_surrogates": surrogates.op9_surrogates,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_license_scan": licences.op11_license_scan,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_vector_codes": codebooks.op13_vector_codes,
}
SQL: dict[str, str] = {"op1_chat_format": chat.OP1_SQL, "op3_mixing": mixing.OP3_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
