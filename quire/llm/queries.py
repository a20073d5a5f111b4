"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from quire.llm.language_model import op3_lm_scoring
from quire.llm.line_dedup import OP2_SQL, op2_line_dedup
from quire.llm.media import op6_media_columns
from quire.llm.mixing import OP8_SQL, op8_mixing
from quire.llm.near_dup import op10_jaccard_join
from quire.llm.pieces import op1_sentencepiece
from quire.llm.quality import op7_quality_classifier
from quire.llm.tool_calls import OP9_SQL, op9_tool_calls
from quire.llm.topk import OP5_SQL, op5_exact_topk
from quire.llm.url_filter import op4_url_filters

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_url_filters": op4_url_filters,
    "op5_exact_topk": op5_exact_topk,
    "op6_media_columns": op6_media_columns,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_mixing": op8_mixing,
    "op9_tool_calls": op9_tool_calls,
    "op10_jaccard_join": op10_jaccard_join,
}
ORACLE = {"op2_line_dedup": OP2_SQL, "op5_exact_topk": OP5_SQL, "op8_mixing": OP8_SQL, "op9_tool_calls": OP9_SQL}
