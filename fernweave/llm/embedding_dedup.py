"""Embedding near-dedup by cross-polytope hashing.

Vectors are brought to length 1, turned by three fast Hadamard rotations with random signs, and hashed to the nearest signed
axis; HASHES of these make a table's key. Of each vector the PROBES likeliest keys of each of TABLES tables count as its
buckets (multiprobe), and vectors that share a bucket are candidates, verified by cosine in double precision. Pairs with
COSINE or more are linked.

Equal vectors become one row first. A bucket is dealt out in blocks of at most BLOCK vectors, by hash; a task holds two blocks
at most, whatever the bucket's size. A pair is counted only in the smallest bucket that both are in, so sums over blocks are
right without gathering pairs; what leaves a block for the components is a forest of its links, not the links.

Vectors that are null, zero or hold null or non-finite components link with nothing. Vectors of different sizes do not link;
the size is part of a bucket's key, so those of each size are hashed and compared among themselves.
Repeated rows (an equal vec_id and vector) count each as a vector. Rows without vec_id link with nothing. An empty table gives
an empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import components, stash

COSINE = 0.95
TABLES, HASHES, PROBES, BLOCK = 6, 2, 2, 1024
#: Neighbouring keys whose buckets, if of one block each, share a task's call.
TOGETHER = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=4)
def signs(size: int) -> np.ndarray:
    return np.random.default_rng(23).choice([-1.0, 1.0], (TABLES, HASHES, 3, size))


def buckets(x: np.ndarray) -> np.ndarray:
    """Keys (n, TABLES * PROBES) of unit vectors: of each table the PROBES pairs of axes with the largest sums."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    s, keys, each = signs(size), [], np.arange(len(x))[:, None]
    for t in range(TABLES):
        axes, drops = [], []
        for h in range(HASHES):
            v = padded
            for k in range(3):
                v = hadamard(v * s[t, h, k])
            best = np.argsort(-np.abs(v), axis=1, kind="stable")[:, :PROBES]
            value = v[each, best]
            axes.append(best * 2 + (value < 0))
            drops.append(np.abs(value[:, :1]) - np.abs(value))
        loss = drops[0][:, :, None] + drops[1][:, None, :]
        pick = np.argsort(loss.reshape(len(x), -1), axis=1, kind="stable")[:, :PROBES]
        i, j = pick // PROBES, pick % PROBES
        keys.append((np.int64(t) << 40) + axes[0][each, i].astype(np.int64) * (2 * size) + axes[1][each, j])
    return np.concatenate(keys, axis=1)


def unit(values: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, and which of the values have one."""
    sizes = [len(v) if v is not None else 0 for v in values]
    size = max(sizes, default=0)
    x = np.zeros((len(values), size))
    for i, v in enumerate(values):
        if sizes[i] == size and size:
            x[i] = [np.nan if c is None else c for c in v]
    with np.errstate(invalid="ignore", over="ignore"):
        top = np.abs(x).max(1, initial=0, keepdims=True)
        ok = np.isfinite(x).all(1) & (top[:, 0] > 0)
        x = np.where(ok[:, None], x / np.where(top > 0, top, 1), 0)
        x /= np.where(ok, np.linalg.norm(x, axis=1), 1)[:, None]
    return x, ok


def runs(sorted_keys: np.ndarray) -> list[slice]:
    at = [0, *(np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1).tolist(), len(sorted_keys)]
    return [slice(a, b) for a, b in zip(at, at[1:])]


def common_before(keys: np.ndarray, a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Which pairs of rows have a key below bound in common."""
    if len(a) <= 5000:
        return ((keys[a][:, :, None] == keys[b][:, None, :]) & (keys[a][:, :, None] < bound)).any((1, 2))
    low, where = np.unique(keys[keys < bound], return_inverse=True)
    member = np.zeros((len(keys), len(low)), np.float32)
    member[np.nonzero(keys < bound)[0], where] = 1
    member = member[:, member.sum(0) > 1]
    return (member @ member.T)[a, b] > 0


def found_in(key: np.ndarray, rep: np.ndarray, copies: np.ndarray, m: np.ndarray, x: np.ndarray, keys: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks i and j of one bucket: the vectors with links, how many vectors they link, and the root of each."""
    a, b = np.flatnonzero(m == i), np.flatnonzero(m == j)
    near = x[a] @ x[b].T >= COSINE
    if i == j:
        near = np.triu(near, 1)
    u, w = np.nonzero(near)
    u, w = a[u], b[w]
    new = ~common_before(keys, u, w, key[0])
    u, w = u[new], w[new]
    links = np.bincount(u, copies[w], len(rep)) + np.bincount(w, copies[u], len(rep))
    # a forest of the links: each vector to the root of what it is linked with here
    root = np.arange(len(rep))
    while len(u):
        top, low = np.maximum(root[u], root[w]), np.minimum(root[u], root[w])
        np.minimum.at(root, top, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[u] != root[w]
        u, w = u[apart], w[apart]
    some = np.flatnonzero(links > 0)
    return rep[some], links[some], rep[root[some]]


def near_vectors(df: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    # a vector that can link; the key is the vector itself
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    keyed = rows.where("fine").select("id", "v", F.xxhash64("v").alias("h"))
    classes = stash(keyed.groupBy("h", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).to_pylist()
            lengths = np.array([len(v) for v in values], np.int64)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                x, _ = unit([values[i] for i in at])
                keys = (np.int64(size) << 43) + np.sort(buckets(x), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["rep", "copies", "x", "keys"])

    hashes = stash(classes.select("rep", "copies", "v").mapInArrow(hashed, "rep long, copies long, x binary, keys array<long>"))
    sizes = hashes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    sizes = sizes.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    spread = hashes.select("rep", F.explode("keys").alias("key")).join(sizes, "key")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # block pairs (i, j), i <= j, that a vector of block m is needed for: (m, j) and (i, m)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("m")).alias("i"), F.greatest(o, F.col("m")).alias("j")))
    dealt = spread.withColumn("m", mine).select("rep", "key", "blocks", "m", F.explode(pairs).alias("p")).select("rep", "key", "blocks", "m", "p.i", "p.j")
    few = F.when(F.col("blocks") == 1, F.expr(f"-1 - key div {TOGETHER}")).otherwise(F.col("key"))
    dealt = dealt.join(hashes, "rep").select(few.alias("g"), "key", "i", "j", "m", "rep", "copies", "x", "keys")

    def block(table: pa.Table) -> pa.Table:
        key, rep = table.column("key").to_numpy(), table.column("rep").to_numpy()
        order = np.lexsort((rep, key))
        key, rep = key[order], rep[order]
        copies, m = (table.column(c).to_numpy()[order] for c in ("copies", "m"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float64).reshape(len(rep), -1)[order]
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)[order]
        out = [found_in(key[s], rep[s], copies[s], m[s], x[s], keys[s], i, j) for s in runs(key)]
        return pa.table({n: pa.array(np.concatenate([o[k] for o in out]).astype(np.int64), pa.int64()) for k, n in enumerate(("rep", "links", "root"))})

    found = stash(dealt.groupBy("g", "i", "j").applyInArrow(block, "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.select("h", "v", "rep", "copies").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("h", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = keyed.join(named, ["h", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
