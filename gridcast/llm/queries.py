"""Queries of the corpus operators and their SQL."""

import corpus_pipeline
from gridcast.llm import bpe, chat, decontaminate, knn, language, license, lm, neardup, phrases, quality, substring, toxicity, whitening

QUERIES = {
    "op1_near_dedup": neardup.query,
    "op2_top_k": knn.query,
    "op3_bpe": bpe.query,
    "op4_lm_score": lm.query,
    "op5_toxicity": toxicity.query,
    "op6_decontamination": decontaminate.query,
    "op7_substring_dedup": substring.query,
    "op8_language_id": language.query,
    "op9_chat_format": chat.query,
    "op10_license_scan": license.query,
    "op11_quality": quality.query,
    "op12_whitening": whitening.query,
    "op13_phrases": phrases.query,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_near_dedup": neardup.SQL,
    "op2_top_k": knn.SQL,
    "op6_decontamination": decontaminate.SQL,
    "op7_substring_dedup": substring.SQL,
    "op9_chat_format": chat.SQL,
    "op10_license_scan": license.SQL,
    "op13_phrases": phrases.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
