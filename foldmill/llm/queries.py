"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from foldmill.llm.bpe import op9_bpe
from foldmill.llm.chat_format import op8_chat_format
from foldmill.llm.decontaminate import OP2_SQL, op2_decontamination
from foldmill.llm.line_dedup import OP10_SQL, op10_line_dedup
from foldmill.llm.ngram_join import op4_ngram_join
from foldmill.llm.quality_classifier import op6_quality_classifier
from foldmill.llm.quality_rules import op7_quality_rules
from foldmill.llm.secrets import op3_secrets
from foldmill.llm.token_counts import op1_token_counts
from foldmill.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_secrets": op3_secrets,
    "op4_ngram_join": op4_ngram_join,
    "op5_url_filter": op5_url_filter,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_format": op8_chat_format,
    "op9_bpe": op9_bpe,
    "op10_line_dedup": op10_line_dedup,
}
SQL = {"op2_decontamination": OP2_SQL, "op5_url_filter": OP5_SQL, "op10_line_dedup": OP10_SQL}
