"""Table schemas, as Spark types. Late columns are nullable; nothing is inferred."""

from __future__ import annotations

CHUNKS = "id string, file_path string, chunk_index int, start_line int, end_line int, title string, content string, embedding array<float>, code4 binary, code1 array<long>, hash string, updated_at timestamp, event_date date, project string, source_kind string"
FILES = "file_path string, content_hash string, last_indexed timestamp, chunk_count int, summary string"
META = "key string, value string"
EMBEDDING_CACHE = "provider string, model string, hash string, embedding array<float>, dims int, updated_at timestamp"
BOUNDARY_CACHE = "pair_hash string, scorer_version string, score double, created_at timestamp"
CODEBASE_META = "codebase string, file_path string, content_hash string, indexed_at timestamp"
EDGES = "id long, codebase string, source_file string, target_file string, edge_type string, metadata string, updated_at timestamp, confidence double"
SYMBOLS = "id string, codebase string, file_path string, name string, kind string, start_line int, end_line int, updated_at timestamp, metadata string"
COMMUNITIES = "codebase string, file_path string, community_id int, updated_at timestamp"
COMMUNITY_META = "codebase string, edge_count long, community_count long, computed_at timestamp"
CHUNK_ENTITIES = "chunk_id string, entity_type string, entity_value string"
RELATIONSHIPS = "entity_a string, relation_type string, entity_b string, chunk_id string, confidence double"
QUANTIZATION = "id long, model_name string, dims int, bit_width int, rotation_seed int, codebook array<double>, created_at timestamp"
JOBS = "id long, repo_name string, clone_url string, before_sha string, after_sha string, ref string, status string, error string, created_at timestamp, started_at timestamp, completed_at timestamp, timing map<string,double>"
RECORD = "type string, sessionId string, cwd string, timestamp string, message string"
BLOCKS = "array<struct<type:string,text:string,name:string>>"
SYMBOL_INDEX = "documents array<struct<relativePath:string,occurrences:array<struct<symbol:string,symbolRoles:int>>>>"
EDGE_TYPES = "import static_import wildcard_import side_effect default_import namespace_import reexport require extends implements delegation calls calls_unresolved build_dependency repo_dependency".split()
