"""Chunks of symbols and of code blocks, and their embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.functions.text import uuid5

#: Which kind stands for a block.
RANK = {"function": 0, "class": 1, "interface": 2, "variable": 3}


def content() -> Column:
    """Signature, docstring and summary of a symbol, blanks left out."""
    parts = [F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in ("signature", "docstring", "semantic_summary")]
    return F.concat_ws("\n", *parts)


def with_summary(symbols: DataFrame) -> DataFrame:
    return symbols if "semantic_summary" in symbols.columns else symbols.withColumn("semantic_summary", F.lit(None).cast("string"))


def symbol_chunks(symbols: DataFrame) -> DataFrame:
    """One chunk of each symbol that has content."""
    return with_summary(symbols).select(F.col("symbol_id").alias("entity_id"), F.lit("symbol").alias("entity_type"), F.lit(0).alias("chunk_index"), content().alias("content")).where("content <> ''")


def block_chunks(symbols: DataFrame, gap: int = 30) -> DataFrame:
    """Blocks of a file's symbols, in order of lines: a symbol that begins more than `gap` lines after the end of the one
    before opens a new block. A block goes by its first symbol of the lowest rank."""
    order = Window.partitionBy("file_id").orderBy("start_line", "start_byte", "symbol_id")
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[F.col("kind")], F.lit(4))
    s = with_summary(symbols).withColumns({"content": content(), "rank": rank})
    s = s.withColumn("opens", F.coalesce(F.col("start_line") - F.lag("end_line").over(order) > gap, F.lit(True)).cast("int"))
    s = s.withColumns({"block": F.sum("opens").over(order), "place": F.row_number().over(order)})
    out = s.groupBy("file_id", "block").agg(
        F.min_by("symbol_id", F.struct("rank", "place")).alias("entity_id"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("n_symbols"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("content") != "", F.struct("place", "content")))), lambda x: x["content"]), "\n---\n").alias("content"),
    )
    return out.where("content <> ''").select("file_id", (F.col("block") - 1).cast("int").alias("block"), "entity_id", "start_line", "end_line", "n_symbols", "content")


def hashing_embedder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for an embedding service: signed hashed tokens, brought to length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        import hashlib
        import re

        out = np.zeros((len(texts), dimension), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9]+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dimension] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    return embed


def embed(chunks: DataFrame, embedder: Callable[[list[str]], np.ndarray], model: str, dimension: int, batch: int = 100, retries: int = 3) -> DataFrame:
    """Vectors of chunks. A batch that fails after its retries is tried row by row; a row that fails has an error instead."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        def tried(texts: list[str]) -> list:
            for k in range(retries):
                try:
                    found = embedder(texts)
                    if found.shape != (len(texts), dimension):
                        raise ValueError(f"expected {dimension} dimensions, got {found.shape[-1]}")
                    return [v.astype(np.float32) for v in found]
                except ValueError:
                    raise
                except Exception:
                    if k + 1 == retries:
                        raise
                    time.sleep(0.1 * 2**k)
            return []

        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch].copy()
                vectors, errors = [], []
                try:
                    vectors = tried(part["content"].tolist())
                    errors = [None] * len(part)
                except Exception:
                    for text in part["content"]:
                        try:
                            vectors.append(tried([text])[0])
                            errors.append(None)
                        except Exception as e:
                            vectors.append(None)
                            errors.append(str(e))
                part["embedding"], part["error"] = vectors, errors
                yield part[["entity_id", "entity_type", "chunk_index", "content", "embedding", "error"]]

    kind = chunks.schema["entity_id"].dataType.simpleString()
    rows = chunks.select("entity_id", "entity_type", "chunk_index", "content").mapInPandas(run, f"entity_id {kind}, entity_type string, chunk_index int, content string, embedding array<float>, error string")
    return rows.select(uuid5(F.concat_ws(":", F.col("entity_id").cast("string"), "entity_type", F.col("chunk_index").cast("string"))).alias("vector_id"), "*", F.lit(model).alias("model"))
