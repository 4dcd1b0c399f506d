import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from lodestrata import catalog

CHECKED = [
    "scan_filter_ext", "token_count_by_lang", "graph_statistics", "content_hash_dedupe", "autocomplete_symbols", "find_definition", "impact_upstream", "impact_downstream", "blast_radius",
    "file_impact_tree", "impact_summary_risk", "dependency_resolution", "python_symbols", "lexical_symbols", "outline_code", "skeleton_chunks", "code_chunks", "clean_graph_view", "common_prefix_name", "outline_search_topk", "markdown_headings", "symbol_candidates", "preamble_lines", "bm25_topk", "hybrid_alpha", "federated_topk", "rerank_fallback",
    "change_classification", "cache_probe_hits", "upsert_replace_file", "link_target_priority", "fact_search", "supersede_pattern_count", "scip_name_parent", "debounce_sessions", "watch_telemetry", "stop_guard",
]


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_twin(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame, twin = catalog.QUERIES[name](spark, data), con.sql(catalog.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(twin.columns)
    at = [twin.columns.index(c) for c in columns]
    got = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    assert got and got == Counter(tuple(plain(r[i]) for i in at) for r in twin.fetchall())


def test_entry_and_names(spark):
    rows = E.entry(spark)
    assert rows.columns == ["node", "depth", "dependents", "risk"] and rows.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
