"""Registered queries of the operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from attestry.llm import alignment, extraction, language, lines, mixing, near_text, near_vectors, neighbours, packing, pieces, quality, urls, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_language_id": language.op2_language_id,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_embedding_near_dedup": near_vectors.op4_embedding_near_dedup,
    "op5_html_extraction": extraction.op5_html_extraction,
    "op6_quality": quality.op6_quality,
    "op7_url_filter": urls.op7_url_filter,
    "op8_nearest_neighbours": neighbours.op8_nearest_neighbours,
    "op9_minhash_near_dedup": near_text.op9_minhash_near_dedup,
    "op10_packing": packing.op10_packing,
    "op11_whitening": whitening.op11_whitening,
    "op12_alignment": alignment.op12_alignment,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}
ORACLES: dict[str, str] = {}
