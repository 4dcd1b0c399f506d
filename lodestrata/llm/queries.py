"""Queries of this subpackage, by name, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from .chat import OP1_SQL, op1_chat_formatting
from .decontam import OP10_SQL, op10_benchmark_decontamination
from .jaccard import OP6_SQL, op6_ngram_jaccard_join
from .langid import op4_language_id
from .licenses import op9_license_scans
from .lines import OP3_SQL, op3_line_dedup
from .packing import op2_best_fit_packing
from .search import OP5_SQL, op5_exact_topk_search
from .spans import op7_substring_dedup
from .sstable import op8_token_shards

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_exact_topk_search": op5_exact_topk_search,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_shards": op8_token_shards,
    "op9_license_scans": op9_license_scans,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}
ORACLES: dict[str, str] = {
    "op1_chat_formatting": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op5_exact_topk_search": OP5_SQL,
    "op6_ngram_jaccard_join": OP6_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
}
