"""Validation: violations as rows (type, message, entity_type, entity_id, field, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.plans.schema import EDGE_TYPES, SYMBOL_KINDS

#: Classes of violations.
REQUIRED, DUPLICATE, INVALID, MISSING, SPAN, MISMATCH = "required_field", "duplicate_id", "invalid_value", "missing_reference", "invalid_span", "mismatch"


def _rows(df: DataFrame, when: Column, kind: str, message: str, entity: str, key: str, field: str) -> DataFrame:
    value = F.col(field).cast("string") if field in df.columns else F.lit(None).cast("string")
    return df.where(when).select(F.lit(kind).alias("type"), F.lit(message).alias("message"), F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), F.lit(field).alias("field"), value.alias("value"))


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def _required(df: DataFrame, entity: str, key: str, fields: list[str]) -> list[DataFrame]:
    return [_rows(df, _empty(f), REQUIRED, f"{f} is required", entity, key, f) for f in fields]


def _unique(df: DataFrame, entity: str, key: str) -> DataFrame:
    again = df.where(~_empty(key)).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return _rows(again, F.lit(True), DUPLICATE, f"{key} is not unique", entity, key, key)


def _refers(df: DataFrame, entity: str, key: str, field: str, to: DataFrame, column: str) -> DataFrame:
    lost = df.where(~_empty(field)).join(to.select(F.col(column).alias(field)).distinct(), field, "left_anti")
    return _rows(lost, F.lit(True), MISSING, f"{field} is not known", entity, key, field)


def spans(df: DataFrame, entity: str, key: str) -> DataFrame:
    bad = (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("start_byte") < 0) | (F.col("end_byte") < F.col("start_byte"))
    return _rows(df, bad, SPAN, "span is out of order", entity, key, "start_line")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def files(df: DataFrame) -> DataFrame:
    return _all([*_required(df, "file", "file_id", ["file_id", "path", "language", "checksum"]), _unique(df, "file", "file_id"), _rows(df, F.col("size") < 0, INVALID, "size is negative", "file", "file_id", "size")])


def symbols(df: DataFrame, files_: DataFrame) -> DataFrame:
    return _all([
        *_required(df, "symbol", "symbol_id", ["symbol_id", "file_id", "name", "kind"]), _unique(df, "symbol", "symbol_id"),
        _rows(df, ~_empty("kind") & ~F.col("kind").isin(SYMBOL_KINDS), INVALID, "kind is not known", "symbol", "symbol_id", "kind"),
        _refers(df, "symbol", "symbol_id", "file_id", files_, "file_id"), spans(df, "symbol", "symbol_id"),
    ])


def nodes(df: DataFrame, files_: DataFrame) -> DataFrame:
    return _all([*_required(df, "node", "node_id", ["node_id", "file_id", "type"]), _unique(df, "node", "node_id"), _refers(df, "node", "node_id", "parent_id", df, "node_id"), _refers(df, "node", "node_id", "file_id", files_, "file_id")])


def edges(df: DataFrame, symbols_: DataFrame) -> DataFrame:
    """Dangling edges are allowed; imports need a target or a module, all others a source."""
    is_import = F.col("edge_type") == "import"
    return _all([
        *_required(df, "edge", "edge_id", ["edge_id", "edge_type", "source_file"]), _unique(df, "edge", "edge_id"),
        _rows(df, ~is_import & _empty("source_id"), REQUIRED, "source_id is required", "edge", "edge_id", "source_id"),
        _rows(df, ~_empty("edge_type") & ~F.col("edge_type").isin(EDGE_TYPES), INVALID, "edge_type is not known", "edge", "edge_id", "edge_type"),
        _rows(df, is_import & _empty("target_id") & _empty("target_module"), REQUIRED, "an import needs a target or a module", "edge", "edge_id", "target_module"),
        _refers(df, "edge", "edge_id", "source_id", symbols_, "symbol_id"), _refers(df, "edge", "edge_id", "target_id", symbols_, "symbol_id"),
    ])


def metadata(df: DataFrame) -> DataFrame:
    """metadata: version, total_files, success_count, failure_count."""
    df = df.withColumn("metadata", F.lit("metadata"))
    return _all([
        _rows(df, _empty("version"), REQUIRED, "version is required", "metadata", "metadata", "version"),
        *(_rows(df, F.col(c) < 0, INVALID, f"{c} is negative", "metadata", "metadata", c) for c in ("total_files", "success_count", "failure_count")),
        _rows(df, F.col("success_count") + F.col("failure_count") != F.col("total_files"), MISMATCH, "successes and failures are not the total", "metadata", "metadata", "total_files"),
    ])
