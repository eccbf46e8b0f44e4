"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from papyra.llm import byte_bpe, centroids, conversation_repair, decontaminate, html_text, language, quality, set_sketch, shards, simhash, suffix_dedup, token_blocks, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_token_blocks": token_blocks.op2_token_blocks,
    "op3_simhash": simhash.op3_simhash,
    "op4_kd_shards": shards.op4_kd_shards,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_quality": quality.op6_quality,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_html_text": html_text.op9_html_text,
    "op10_language": language.op10_language,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_centroids": centroids.op12_centroids,
    "op13_set_sketch": set_sketch.op13_set_sketch,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_filter.ORACLE_SQL,
    "op6_quality": quality.ORACLE_SQL,
    "op11_conversation_repair": conversation_repair.ORACLE_SQL,
    "op12_centroids": centroids.ORACLE_SQL,
    "op13_set_sketch": set_sketch.ORACLE_SQL,
}
