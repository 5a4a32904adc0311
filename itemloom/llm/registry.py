"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from .chat_format import op3_chat_format
from .context_mixing import op5_context_mixing
from .decontaminate import op6_decontaminate
from .filter_audit import OP11_SQL, op11_filter_audit
from .language_id import op10_language_id
from .line_dedup import OP8_SQL, op8_line_dedup
from .minhash_dedup import op1_minhash_dedup
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .sentencepiece_codec import op2_sentencepiece
from .source_mix import OP12_SQL, op12_source_mix
from .substring_dedup import op7_substring_dedup
from .token_files import op4_token_files
from .vantage_search import op9_vantage_search

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_chat_format": op3_chat_format,
    "op4_token_files": op4_token_files,
    "op5_context_mixing": op5_context_mixing,
    "op6_decontaminate": op6_decontaminate,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_vantage_search": op9_vantage_search,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_mix": op12_source_mix,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {"op8_line_dedup": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_source_mix": OP12_SQL, "op13_prefix_trie": OP13_SQL}
