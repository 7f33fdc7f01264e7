"""Detail joins: callers, callees, dependencies, views, integrity, header and implementation pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernweave.functions.text import basename, dirname, extension, file_symbol_id, normal_signature
from fernweave.plans.schema import Graph

#: Header extensions, and implementation extensions in the order they are tried.
HEADERS = [".h", ".hpp", ".hh", ".hxx"]
IMPLEMENTATIONS = [".c", ".cpp", ".cc", ".cxx", ".m", ".mm"]
INTERNAL = ["import", "extends", "implements", "reference"]


def left_on_target(edges: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join of edges with other by target_id = key. Edges without a target go by their source: by target all would meet in
    one task."""
    edges = edges.withColumns({"__there": F.col("target_id").isNotNull(), "__at": F.coalesce("target_id", "source_id")})
    return edges.join(other.select("*", F.lit(True).alias("__there"), F.col(key).alias("__at")), ["__there", "__at"], "left").drop("__there", "__at")


def _detailed(graph: Graph, edges: DataFrame, end: str) -> DataFrame:
    """Edges with name, kind and path of the symbol at `end`; edges without it drop out."""
    s = graph.symbols.select(F.col("symbol_id").alias(end), "name", "kind", "signature", "start_line", "end_line", "file_id")
    f = graph.files.select("file_id", "path")
    return edges.join(s, end).join(f, "file_id", "left").select(
        "source_id", "target_id", "edge_type", "target_module", "name", "kind", "signature", F.coalesce("path", F.lit("")).alias("path"), "start_line", "end_line"
    )


def callers(graph: Graph, symbol_id: object) -> DataFrame:
    return _detailed(graph, graph.edges.where((F.col("target_id") == symbol_id) & (F.col("edge_type") == "call")), "source_id").orderBy("name")


def callees(graph: Graph, symbol_id: object) -> DataFrame:
    return _detailed(graph, graph.edges.where((F.col("source_id") == symbol_id) & (F.col("edge_type") == "call")), "target_id").orderBy("name")


def internal_dependencies(graph: Graph, symbol_id: object) -> DataFrame:
    mine = graph.edges.where((F.col("source_id") == symbol_id) & F.col("edge_type").isin(INTERNAL) & F.col("target_id").isNotNull())
    return _detailed(graph, mine, "target_id").orderBy("edge_type", "name")


def external_dependencies(graph: Graph, symbol_id: object) -> DataFrame:
    mine = graph.edges.where((F.col("source_id") == symbol_id) & F.col("target_id").isNull() & F.col("target_module").isNotNull())
    empty = [F.lit("").alias(c) for c in ("name", "kind", "signature", "path")]
    return mine.select("source_id", "target_id", "edge_type", "target_module", *empty, F.lit(0).cast("long").alias("start_line"), F.lit(0).cast("long").alias("end_line")).orderBy("edge_type", "target_module")


def dependencies(graph: Graph, symbol_id: object) -> DataFrame:
    """Internal dependencies, then external ones as modules by name, with their order in `ordinal`."""
    inner = internal_dependencies(graph, symbol_id).withColumn("part", F.lit(0))
    outer = external_dependencies(graph, symbol_id).withColumns({"name": F.col("target_module"), "kind": F.lit("module"), "part": F.lit(1)})
    both = inner.unionByName(outer)
    order = Window.orderBy("part", "edge_type", "name")  # one symbol's dependencies
    return both.withColumn("ordinal", F.row_number().over(order)).drop("part")


def symbols_with_files(graph: Graph) -> DataFrame:
    f = graph.files.select("file_id", "repo_id", "path", "language")
    r = graph.repos.select("repo_id", F.col("name").alias("repo_name"))
    return graph.symbols.select("symbol_id", "file_id", "name", "kind", "start_line").join(f, "file_id").join(r, "repo_id")


def edges_with_symbols(graph: Graph) -> DataFrame:
    s = graph.symbols.select(F.col("symbol_id").alias("source_id"), F.col("name").alias("source_name"), F.col("kind").alias("source_kind"))
    t = graph.symbols.select(F.col("symbol_id").alias("__t"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"))
    return left_on_target(graph.edges.join(s, "source_id"), t, "__t").select("source_id", "target_id", "edge_type", "target_module", "source_name", "source_kind", "target_name", "target_kind")


def extracted_edges(graph: Graph, repo_id: object) -> DataFrame:
    s = graph.symbols.select(F.col("symbol_id").alias("source_id"), F.col("name").alias("source_name"), "file_id")
    f = graph.files.where(F.col("repo_id") == repo_id).select("file_id")
    t = graph.symbols.select(F.col("symbol_id").alias("__t"), F.col("name").alias("target_name"))
    joined = left_on_target(graph.edges.join(s.join(f, "file_id", "left_semi"), "source_id"), t, "__t")
    return joined.select("source_id", "source_name", "edge_type", F.coalesce(F.col("target_id").cast("string"), F.lit("")).alias("target_id"), F.coalesce("target_name", "target_module", F.lit("")).alias("target_name"))


def integrity(graph: Graph) -> DataFrame:
    """Rows that refer to nothing, counted by check."""
    def lost(check: str, df: DataFrame, column: str, to: DataFrame, key: str) -> DataFrame:
        other = to.select(F.col(key).alias(column)).distinct()
        return df.where(F.col(column).isNotNull()).join(other, column, "left_anti").agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), "n")

    checks = [
        lost("files_without_repository", graph.files, "repo_id", graph.repos, "repo_id"),
        lost("symbols_without_file", graph.symbols, "file_id", graph.files, "file_id"),
        lost("edges_without_source", graph.edges, "source_id", graph.symbols, "symbol_id"),
        lost("edges_without_target", graph.edges, "target_id", graph.symbols, "symbol_id"),
        lost("vectors_without_symbol", graph.vectors, "entity_id", graph.symbols, "symbol_id"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out


def header_pairs(files: DataFrame) -> DataFrame:
    """Headers with the implementation of their directory and stem; of several the first by extension order."""
    ext = F.lower(extension(F.col("path")))
    parts = files.select("repo_id", "file_id", "path", dirname(F.col("path")).alias("dir"), F.regexp_replace(basename(F.col("path")), r"\.[^.]*$", "").alias("stem"), ext.alias("ext"))
    headers = parts.where(F.col("ext").isin(HEADERS)).select("repo_id", "dir", "stem", F.col("file_id").alias("header_id"), F.col("path").alias("header_path"))
    rank = F.array_position(F.array(*map(F.lit, IMPLEMENTATIONS)), F.col("ext"))
    impl = parts.where(F.col("ext").isin(IMPLEMENTATIONS)).groupBy("repo_id", "dir", "stem").agg(F.min(F.struct(rank.alias("rank"), "path", "file_id")).alias("i"))
    return headers.join(impl, ["repo_id", "dir", "stem"]).select("repo_id", "header_id", "header_path", F.col("i.file_id").alias("impl_id"), F.col("i.path").alias("impl_path"))


def declaration_matches(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Declarations of a header with their implementation: one name, compatible raw kinds, one signature.

    symbols: symbol_id, file_id, name, raw_kind, signature, start_line. Of a header's declarations with one name, letter case
    aside, the last counts.
    """
    key = F.lower(F.trim("name"))
    h = pairs.join(symbols.withColumnRenamed("file_id", "header_id"), "header_id").withColumn("key", key)
    last = Window.partitionBy("header_id", "key").orderBy(F.desc("start_line"), F.desc("symbol_id"))
    h = h.withColumn("n", F.row_number().over(last)).where("n = 1").select("header_id", "impl_id", "key", F.col("symbol_id").alias("declaration_id"), F.col("name").alias("declared"), F.col("raw_kind").alias("hk"), normal_signature(F.col("signature")).alias("hs"))
    i = symbols.select(F.col("file_id").alias("impl_id"), key.alias("key"), F.col("symbol_id").alias("implementation_id"), "name", F.col("raw_kind").alias("ik"), normal_signature(F.col("signature")).alias("is"))
    callable_ = ["function", "function_declaration", "method", "static_function", "inline_function", "virtual_method", "method_implementation"]
    types = ["class", "struct", "interface", "implementation"]
    agree = (F.col("hk") == F.col("ik")) | (F.col("hk").isin(callable_) & F.col("ik").isin(callable_)) | (F.col("hk").isin(types) & F.col("ik").isin(types))
    same = (F.col("hs") == F.col("is")) | (F.col("hs") == "") | (F.col("is") == "")
    return h.join(i, ["impl_id", "key"]).where((F.col("declared") == F.col("name")) & agree & same).select("header_id", "impl_id", "name", "declaration_id", "implementation_id")


def virtual_file_symbols(files: DataFrame) -> DataFrame:
    """The module symbol that stands for a whole file."""
    return files.select(file_symbol_id(F.col("path")).alias("symbol_id"), "file_id", F.concat(F.lit("__file__:"), basename(F.col("path"))).alias("name"), F.lit("module").alias("kind"))
