"""Point and predicate scans: filters that reach the Parquet scan, ordered as the catalogue says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by(df: DataFrame, order: list[str] | None = None, limit: int = 0, **equal: object) -> DataFrame:
    """Rows whose columns equal the given values (a list: any of them), ordered; limit 0 is none."""
    for name, value in equal.items():
        df = df.where(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == F.lit(value))
    if order:
        df = df.orderBy(*order)
    return df.limit(limit) if limit else df


def repo_by_id(repos: DataFrame, repo_id: object) -> DataFrame:
    return by(repos, limit=1, repo_id=repo_id)


def repo_by_name(repos: DataFrame, name: str) -> DataFrame:
    return by(repos, limit=1, name=name)


def all_repos(repos: DataFrame) -> DataFrame:
    return repos.orderBy("name")


def file_by_path(files: DataFrame, repo_id: object, path: str) -> DataFrame:
    return by(files, repo_id=repo_id, path=path)


def files_by_repo(files: DataFrame, repo_id: object) -> DataFrame:
    return by(files, ["path"], repo_id=repo_id)


def files_by_language(files: DataFrame, repo_id: object, language: str) -> DataFrame:
    return files.where((F.col("repo_id") == repo_id) & (F.lower("language") == language.lower())).orderBy("path")


def changed_files(files: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored files whose checksum differs from the one that comes for their path (incoming: path, checksum)."""
    new = incoming.select("path", F.col("checksum").alias("__new"))
    return files.join(new, "path").where(~F.col("checksum").eqNullSafe(F.col("__new"))).select(*files.columns)


def changed_files_any(files: DataFrame, paths: list[str], checksums: list[str]) -> DataFrame:
    """The literal form: the path is among the paths and the checksum differs from any one of the checksums."""
    differs = F.exists(F.array(*map(F.lit, checksums)), lambda c: c != F.col("checksum")) if checksums else F.lit(False)
    return files.where(F.col("path").isin(paths) & differs)


def symbols_by_file(symbols: DataFrame, file_id: object, kind: str | None = None) -> DataFrame:
    found = by(symbols, file_id=file_id)
    return (found if kind is None else found.where(F.col("kind") == kind)).orderBy("start_line", "start_byte")


def symbols_like(symbols: DataFrame, pattern: str) -> DataFrame:
    return symbols.where(F.col("name").ilike(pattern)).orderBy("name")


def symbols_exact(symbols: DataFrame, name: str) -> DataFrame:
    return by(symbols, name=name)


def symbols_with_docstring(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("docstring").isNotNull() & (F.col("docstring") != ""))


def symbols_by_kinds(symbols: DataFrame, file_id: object, kinds: list[str]) -> DataFrame:
    return by(symbols, ["start_line", "start_byte"], file_id=file_id, kind=kinds) if kinds else symbols.limit(0)


def node_roots(nodes: DataFrame, file_id: object = None) -> DataFrame:
    found = nodes.where(F.col("parent_id").isNull())
    return (found if file_id is None else found.where(F.col("file_id") == file_id)).orderBy("start_line", "node_id")


def edges_of(edges: DataFrame, end: str, node: object, types: list[str] | None = None) -> DataFrame:
    """Edges by source_id or target_id, of some types if given."""
    found = by(edges, **{end: node})
    return (found.where(F.col("edge_type").isin(types)) if types else found).orderBy("edge_type", "source_id", "target_id", "target_module")


def edges_by_types(edges: DataFrame, types: list[str]) -> DataFrame:
    return edges.where(F.col("edge_type").isin(types)) if types else edges.limit(0)


def edges_touching(edges: DataFrame, symbol_id: object, types: list[str]) -> DataFrame:
    touches: Column = (F.col("source_id") == symbol_id) | (F.col("target_id") == symbol_id)
    return edges.where(touches & F.col("edge_type").isin(types))


def call_edges(edges: DataFrame, symbol_id: object) -> DataFrame:
    return edges_touching(edges, symbol_id, ["call"])


def import_edges(edges: DataFrame, symbol_id: object) -> DataFrame:
    return edges_touching(edges, symbol_id, ["import"])


def inheritance_edges(edges: DataFrame, symbol_id: object) -> DataFrame:
    return edges_touching(edges, symbol_id, ["extends", "implements"])


def vectors_by_entity(vectors: DataFrame, entity_id: object) -> DataFrame:
    return by(vectors, ["chunk_index"], entity_id=entity_id)


def vectors_by_entity_type(vectors: DataFrame, entity_type: str, limit: int, newest: str = "created_at") -> DataFrame:
    return vectors.where(F.col("entity_type") == entity_type).orderBy(F.desc(newest)).limit(limit)


def embedding_dimension(vectors: DataFrame, model: str) -> DataFrame:
    return vectors.where((F.col("model") == model) & F.col("embedding").isNotNull()).select(F.size("embedding").alias("dimension")).limit(1)
