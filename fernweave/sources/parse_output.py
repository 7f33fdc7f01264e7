"""Parse output as JSON: the nested document to tables and back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.plans.schema import PARSE_OUTPUT


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARSE_OUTPUT).option("multiLine", True).json(path)


def _none(c: str):
    return F.nullif(F.col(c), F.lit("")).alias(c.rsplit(".", 1)[-1])


def tables(output: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, ast_nodes, edges, errors of parse outputs; the wire's empty ids become nulls."""
    files = output.select(F.explode("files").alias("f"))
    spans = ["start_line", "end_line", "start_byte", "end_byte"]
    symbols = files.select(F.explode("f.symbols").alias("s"))
    nodes = files.select(F.explode("f.nodes").alias("n"))
    edges = output.select(F.explode("relationships").alias("e"))
    return {
        "files": files.select("f.file_id", "f.path", "f.language", "f.size", "f.checksum"),
        "symbols": symbols.select("s.symbol_id", "s.file_id", "s.name", "s.kind", "s.signature", *(f"s.span.{x}" for x in spans), "s.docstring", "s.semantic_summary"),
        "ast_nodes": nodes.select("n.node_id", "n.file_id", "n.type", _none("n.parent_id"), *(f"n.span.{x}" for x in spans), "n.text", "n.attributes"),
        "edges": edges.select("e.edge_id", _none("e.source_id"), _none("e.target_id"), "e.edge_type", "e.source_file", _none("e.target_file"), _none("e.target_module")),
        "errors": output.select(F.explode("metadata.errors").alias("e")).select("e.file", "e.message", "e.type"),
        "metadata": output.select("metadata.version", "metadata.total_files", "metadata.success_count", "metadata.failure_count"),
    }


def build(files: DataFrame, symbols: DataFrame, edges: DataFrame, version: str = "1.0") -> DataFrame:
    """One row for each file, with its symbols nested, as JSON lines take it."""
    span = F.struct("start_line", "end_line", "start_byte", "end_byte")
    nested = symbols.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start_line").alias("at"), F.struct("symbol_id", "name", "kind", "signature", span.alias("span"), "docstring").alias("s")))).alias("x"))
    nested = nested.select("file_id", F.transform("x", lambda v: v["s"]).alias("symbols"))
    return files.join(nested, "file_id", "left").withColumn("version", F.lit(version))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(files: DataFrame, edges: DataFrame, path: str, version: str = "1.0") -> None:
    """One complete JSON document, written as rows arrive, so its size is not held in memory."""
    empty = lambda v: "" if v is None else v
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"files":[')
        n = 0
        for r in files.toLocalIterator():
            out.write(("," if n else "") + json.dumps(r.asDict(recursive=True), default=str))
            n += 1
        out.write('],"relationships":[')
        for k, r in enumerate(edges.toLocalIterator()):
            out.write(("," if k else "") + json.dumps({x: empty(v) for x, v in r.asDict().items()}, default=str))
        out.write('],"metadata":' + json.dumps({"version": version, "total_files": n, "success_count": n, "failure_count": 0, "errors": []}) + "}")


