"""Tables of the code graph: schemas, enumerations and keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Fixed values.
SYMBOL_KINDS = ["function", "class", "interface", "variable", "package", "module", "external"]
EDGE_TYPES = ["call", "import", "extends", "implements", "reference", "implements_header", "implements_declaration", "calls_declaration"]
ERROR_TYPES = ["filesystem", "parse", "mapping", "llm", "output"]
EXTERNAL_FILE = "__external__"

SCHEMAS = {
    "repositories": "repo_id string, name string, url string, branch string, commit_hash string, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "files": "file_id string, repo_id string, path string, language string, size bigint, checksum string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "symbols": "symbol_id string, file_id string, name string, kind string, signature string, start_line int, end_line int, start_byte int, end_byte int, docstring string, semantic_summary string, created_at timestamp_ntz",
    "ast_nodes": "node_id string, file_id string, type string, parent_id string, start_line int, end_line int, start_byte int, end_byte int, text string, attributes map<string,string>, created_at timestamp_ntz",
    "edges": "edge_id string, source_id string, target_id string, edge_type string, source_file string, target_file string, target_module string, line_number int, created_at timestamp_ntz",
    "vectors": "vector_id string, entity_id string, entity_type string, embedding array<float>, content string, model string, chunk_index int, created_at timestamp_ntz",
    "docstrings": "doc_id string, symbol_id string, content string, created_at timestamp_ntz",
    "summaries": "summary_id string, entity_id string, entity_type string, summary_type string, content string, created_at timestamp_ntz",
}
KEYS = {
    "repositories": ["repo_id"],
    "files": ["repo_id", "path"],
    "symbols": ["file_id", "name", "start_line", "start_byte"],
    "ast_nodes": ["node_id"],
    "edges": ["edge_id"],
    "vectors": ["entity_id", "entity_type", "chunk_index"],
}
PARSE_OUTPUT = (
    "files array<struct<file_id:string,path:string,language:string,size:bigint,checksum:string,"
    "symbols:array<struct<symbol_id:string,file_id:string,name:string,kind:string,signature:string,span:struct<start_line:int,end_line:int,start_byte:int,end_byte:int>,docstring:string,semantic_summary:string>>,"
    "nodes:array<struct<node_id:string,file_id:string,type:string,span:struct<start_line:int,end_line:int,start_byte:int,end_byte:int>,parent_id:string,text:string,attributes:map<string,string>>>>>,"
    "relationships array<struct<edge_id:string,source_id:string,target_id:string,edge_type:string,source_file:string,target_file:string,target_module:string>>,"
    "metadata struct<version:string,timestamp:string,total_files:int,success_count:int,failure_count:int,errors:array<struct<file:string,message:string,type:string>>>"
)


@dataclass(frozen=True)
class Graph:
    """The tables of a code graph."""

    repos: DataFrame
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    nodes: DataFrame
    vectors: DataFrame
