"""Schemas of the stored tables, as DDL."""

DOCUMENTS = "path string, text string, mtime double, ext string, metadata map<string,string>"
CHUNKS = (
    "path string, chunk_no int, text string, scope string, chunk_type string, start_char int, end_char int, signature string, docstring string, "
    "dependencies array<struct<symbol:string,module:string>>, test_targets array<string>, parent_id string, parent_scope string, parent_text string, "
    "heading_path string, doc_title string, tags array<string>, commit_hash string, commit_date string, commit_msg string"
)
FILES = "path string, title string, is_markdown boolean"
DEFINED_IN = "symbol string, path string, kind string, line int, signature string, docstring string, parent string"
IMPORTS = "path string, symbol string, module string, line int"
REFERENCES = "path string, symbol string, line int, kind string"
LINKS = "src string, target string, is_resolved boolean, label string, line int, link_type string, raw_target string"
SECTIONS = "id string, path string, name string, level int, line int, heading_path string"
TAGS = "path string, tag string"
RELATIONS = "symbol string, other string, rel string, scip_id string"
EPISODES = (
    "name string, content string, created_at timestamp, project string, tags string, superseded boolean, superseded_by string, "
    "superseded_at timestamp, superseded_reason string"
)
ARCHIVE = EPISODES + ", archived_at timestamp"
ENTITIES = "name string, summary string, entity_type string, updated_at timestamp"
MENTIONS = "episode string, entity string"
FACTS = "source string, target string, fact string, relation string, created_at timestamp, superseded boolean, superseded_by string, superseded_at timestamp, superseded_reason string"
INVARIANTS = "rule string, domain string, rationale string, updated_at timestamp"
SUBSYSTEMS = "id string, name string, description string, file_count long, updated_at timestamp"
BELONGS_TO = "path string, subsystem string"
VECTORS = "point_id string, collection string, path string, text string, embedding array<float>, terms map<string,float>"
FILE_CACHE = "path string, collection string, mtime double, sha256 string, point_ids array<string>, updated_at double"
EMBEDDING_CACHE = "chunk_sha256 string, model string, embedding array<float>, dim int, created_at double"
OUTLINES = "path string, l0_summary string, l1_architecture string, l2_references string"

#: Key columns: a table has one row for each.
KEYS = {
    "files": ["path"], "defined_in": ["symbol", "path", "kind", "line", "signature", "docstring", "parent"], "imports": ["path", "symbol", "module", "line"],
    "references": ["path", "symbol", "line", "kind"], "links": ["src", "target", "label", "line", "link_type", "raw_target"], "sections": ["id"], "tags": ["path", "tag"],
    "relations": ["symbol", "other", "rel", "scip_id"], "episodes": ["name"], "archive": ["name", "created_at"], "chunks": ["path", "chunk_no"], "entities": ["name"], "mentions": ["episode", "entity"], "facts": ["source", "target", "fact", "relation"],
    "invariants": ["rule"], "subsystems": ["id", "name"], "belongs_to": ["path", "subsystem"], "vectors": ["point_id"], "file_cache": ["path", "collection"],
    "embedding_cache": ["chunk_sha256", "model"], "outlines": ["path"],
}
TABLES = {
    "documents": DOCUMENTS, "chunks": CHUNKS, "files": FILES, "defined_in": DEFINED_IN, "imports": IMPORTS, "references": REFERENCES, "links": LINKS,
    "sections": SECTIONS, "tags": TAGS, "relations": RELATIONS, "episodes": EPISODES, "archive": ARCHIVE, "entities": ENTITIES, "mentions": MENTIONS, "facts": FACTS,
    "invariants": INVARIANTS, "subsystems": SUBSYSTEMS, "belongs_to": BELONGS_TO, "vectors": VECTORS, "file_cache": FILE_CACHE,
    "embedding_cache": EMBEDDING_CACHE, "outlines": OUTLINES,
}
#: The column whose hash decides a row's bucket: what a write replaces by it touches its buckets alone.
BUCKET_BY = {name: "path" for name in ("files", "defined_in", "imports", "references", "sections", "tags", "belongs_to", "vectors", "file_cache", "outlines", "chunks")} | {
    "links": "src", "relations": "symbol", "episodes": "name", "archive": "name", "entities": "name", "mentions": "episode", "facts": "source", "invariants": "rule", "embedding_cache": "chunk_sha256",
}
