"""Vector functions in double precision, as column expressions and over blocks in Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one size; null for zero vectors or unequal sizes."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def parse_vector(text: Column) -> Column:
    """'[1,2,3]' as an array of floats."""
    return F.from_json(text, "array<float>")


def format_vector(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def order_key(score: Column) -> Column:
    """What results are ordered by: scores to twelve places, so that equal ones tie in whatever order they were summed."""
    return F.when(F.isnan(score), F.lit(2**62)).otherwise(F.signum(score).cast("long") * F.floor(F.abs(score) * 1e12 + 0.5))


def order_keys(scores: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(scores), 2.0**62, np.sign(scores) * np.floor(np.abs(scores) * 1e12 + 0.5))


def _ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of two matrices, summed from the first number to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def matrices(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size of the vectors their places, their numbers and their squared norms, without those that are zero or hold a null."""
    lists = vectors.combine_chunks()
    flat, sizes = lists.flatten(), lists.value_lengths().to_numpy()
    ends = np.cumsum(sizes)
    lost = np.concatenate([[0], np.cumsum(np.asarray(flat.is_null()))])
    whole = lost[ends] == lost[ends - sizes]
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    out = {}
    for width in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero((sizes == width) & whole)
        m = values[(ends[at] - width)[:, None] + np.arange(width)]
        sq = _ordered_dot(m, m)
        out[width] = at[sq != 0], m[sq != 0], sq[sq != 0]
    return out


def cosines(a: np.ndarray, a_sq: np.ndarray, i: np.ndarray, b: np.ndarray, b_sq: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows i of one matrix with rows j of another, given their squared norms."""
    return np.clip(_ordered_dot(a[i], b[j]) / np.sqrt(a_sq[i] * b_sq[j]), -1, 1)
