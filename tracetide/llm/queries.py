"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline
from tracetide.llm import decontaminate, graph_index, importance, infill, line_dedup, near_dedup, ngram_join, pieces, quality, suffix_dedup, suffix_lm, url_filter, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality": quality.op2_quality,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_nearest_neighbours": graph_index.op6_nearest_neighbours,
    "op7_lm_scoring": suffix_lm.op7_lm_scoring,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_warc": warc.op9_warc,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_importance_resampling": importance.op13_importance_resampling,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_line_dedup": line_dedup.ORACLE, "op4_url_filter": url_filter.ORACLE, "op9_warc": warc.ORACLE, "op11_fill_in_middle": infill.ORACLE, "op13_importance_resampling": importance.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
