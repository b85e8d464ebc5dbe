"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import chat, codes, decontaminate, language, mixing, near_dup, quality, search, sql, substring_dedup, token_counts, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_language_id": language.op1_language_id,
        "op2_chat_format": chat.op2_chat_format,
        "op3_bm25_topk": search.op3_bm25_topk,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_toxic_segments": toxicity.op7_toxic_segments,
        "op8_pareto_mix": mixing.op8_pareto_mix,
        "op9_line_crf_quality": quality.op9_line_crf_quality,
        "op10_near_dup": near_dup.op10_near_dup,
        "op11_vector_codes": codes.op11_vector_codes,
        "op12_warc_archive": warc.op12_warc_archive,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.ORACLE, "op5_substring_dedup": sql.SUBSTRING, "op8_pareto_mix": sql.MIX, "op11_vector_codes": codes.oracle(), "op12_warc_archive": warc.ORACLE}
