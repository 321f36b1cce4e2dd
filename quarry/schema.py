"""The engine's tables: names, columns and keys."""

from __future__ import annotations

_DDL = {
    "symbols": "id string, file_path string, language string, kind string, name string, exported boolean, start_byte int, end_byte int, start_line int, end_line int, text string, created_at long, updated_at long",
    "edges": "src string, dst string, type string, at_file string, at_line int, confidence double, evidence_count int, resolution string, resolution_rank int",
    "edge_evidence": "src string, dst string, type string, at_file string, at_line int, count int",
    "file_fingerprints": "file_path string, mtime_ns long, size_bytes long",
    "usage_examples": "to_id string, type string, file_path string, line long, snippet string, from_id string",
    "index_runs": "started_at long, duration_ms long, files_scanned long, files_indexed long, files_skipped long, files_unchanged long, files_deleted long, symbols_indexed long",
    "search_runs": "started_at long, duration_ms long, keyword_ms long, vector_ms long, merge_ms long, query string, query_limit int, exported_only boolean, result_count int",
    "similarity_clusters": "id string, cluster_key string",
    "symbol_metrics": "id string, pagerank double, in_degree long, out_degree long, updated_at long",
    "query_selections": "query string, query_normalized string, id string, position int, created_at long",
    "user_file_affinity": "file_path string, view_count long, edit_count long, last_accessed_at long",
    "repositories": "id string, name string, root_path string, vcs_type string, remote_url string",
    "packages": "id string, repository_id string, name string, version string, manifest_path string, package_type string",
    "docstrings": "id string, raw_text string, summary string, params_json string, returns_text string, examples_json string",
    "todos": "id string, kind string, text string, file_path string, line int, associated_symbol string",
    "test_links": "test_file_path string, source_file_path string, link_direction string",
    "decorators": "id string, name string, arguments string, target_line int, decorator_type string",
    "embedding_cache": "cache_key string, model_name string, text_hash string, embedding array<float>, vector_dim int, created_at long, last_accessed_at long, access_count long",
    "framework_patterns": "id string, framework string, kind string, file_path string, line int, http_method string, path string, name string, handler string, arguments string, parent_chain string",
}
KEYS = {
    "symbols": ["id"], "edges": ["src", "dst", "type"], "edge_evidence": ["src", "dst", "type", "at_file", "at_line"], "file_fingerprints": ["file_path"],
    "usage_examples": ["to_id", "type", "file_path", "line", "snippet"], "index_runs": [], "search_runs": [], "similarity_clusters": ["id"], "symbol_metrics": ["id"], "query_selections": [],
    "user_file_affinity": ["file_path"], "repositories": ["id"], "packages": ["id"], "docstrings": ["id"], "todos": ["id"], "test_links": ["test_file_path", "source_file_path"],
    "decorators": ["id", "name"], "embedding_cache": ["cache_key"], "framework_patterns": ["id"],
}

#: DDL of every table, by name.
TABLES: dict[str, str] = dict(_DDL)


def empty(spark, name: str):
    """An empty table."""
    return spark.createDataFrame([], TABLES[name])
