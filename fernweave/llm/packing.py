"""Best-fit packing by patterns: a few documents' lengths that fill a sequence, repeated as often as the lengths allow.

The lengths' histogram (at most `cap` numbers, however many documents there are) is all that the driver sees. Patterns of two
to five lengths are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and rounded
down, and the residual is packed by best fit decreasing, by counts. Pieces then find their place by their rank among the
pieces of their length; ranks come from counts for each partition, so a length that a third of all pieces have is no hot key.

Null texts are empty: one piece, the end id alone. Repeated rows are packed each by itself. An empty table gives no pieces.
Extra columns are left alone. No text is cut short: longer ones are cut into pieces of `cap` ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.bpe import load
from fernweave.llm.common import stash, text_of

CAP = 2048
#: Shares of the fitted pattern counts that are tried until the sequences are as few as can be; at 0 best fit packs all.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.0)


def patterns(lengths: np.ndarray, cap: int, waste: int = 4) -> np.ndarray:
    """Rows of up to five lengths (0: none), in falling order, that leave at most `waste` ids of a sequence unused."""
    has = np.zeros(cap + 1, bool)
    has[lengths] = True
    below = np.maximum.accumulate(np.where(has, np.arange(cap + 1), 0))  # the largest length up to each
    spread = lambda top, n: np.unique(below[np.linspace(1, top, n).astype(int)]) if top > 0 else np.zeros(0, int)
    found: list[tuple[int, ...]] = []

    def fill(held: tuple[int, ...], room: int) -> None:
        last = int(below[min(room, held[-1])]) if room > 0 else 0
        if last and room - last <= waste:
            found.append((*held, last))

    for a in lengths[::-1].tolist():
        room = cap - a
        if room <= waste:
            found.append((a,))
        fill((a,), room)
        for b in spread(min(a, room), 16).tolist():
            if b:
                fill((a, b), room - b)
                for c in spread(min(b, room - b), 5).tolist():
                    if c:
                        fill((a, b, c), room - b - c)
                        if d := int(below[max(0, min(c, (room - b - c) // 2))]):
                            fill((a, b, c, d), room - b - c - d)
    if not found:
        return np.zeros((0, 5), np.int64)
    return np.unique(np.array([p + (0,) * (5 - len(p)) for p in found], np.int64), axis=0)[::-1]


def nnls(rows: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that brings the weighted sum of squares of (counts used - target) near its least: FISTA on sparse rows."""
    used = rows > 0
    weight = 1.0 / np.sqrt(target + 1.0)
    at, owner = rows[used], np.nonzero(used)[0]
    goal = target * weight
    ax = lambda x: np.bincount(at, x[owner], len(target)) * weight
    atr = lambda r: np.bincount(owner, (r * weight)[at], len(rows))
    v = np.ones(len(rows))
    for _ in range(12):
        v = atr(ax(v))
        norm = np.linalg.norm(v)
        if not norm:
            return np.zeros(len(rows))
        v /= norm
    step = 1 / (norm * 1.05)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - step * atr(ax(y) - goal))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = z + (t - 1) / u * (z - x), z, u
    return x


def by_patterns(left: np.ndarray, rows: np.ndarray, x: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Sequences of the patterns, as often as fitted and as the lengths that are left allow; what rounding takes from one
    pattern goes to the next."""
    out: list[tuple[tuple[int, ...], int]] = []
    carry = 0.0
    for i in np.lexsort((-x, -rows.sum(1), -rows[:, 0])):
        want = x[i] + carry
        kinds, each = np.unique(rows[i][rows[i] > 0], return_counts=True)
        n = int(min(np.floor(want + 1e-6), (left[kinds] // each).min()))
        carry = min(want - n, 1.0)
        if n > 0:
            left[kinds] -= n * each
            out.append((tuple(rows[i][rows[i] > 0].tolist()), n))
    return out


def plan(histogram: np.ndarray, cap: int = CAP) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up the histogram of lengths 0..cap."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[cap]:
        out.append(((cap,), int(left[cap])))
        left[cap] = 0
    lengths = np.flatnonzero(left)
    lengths = lengths[lengths > 0]
    rows = patterns(lengths, cap) if len(lengths) else np.zeros((0, 5), np.int64)
    if not len(rows):
        return out + best_fit(left, cap)
    x = nnls(rows, left.astype(float))
    least = -(-int((left * np.arange(cap + 1)).sum()) // cap)
    # patterns that use up the short lengths can leave a rest that fits badly; then a smaller share of them is better
    best: tuple[int, list] | None = None
    for share in SHARES:
        rest = left.copy()
        made = by_patterns(rest, rows, x * share)
        made += best_fit(rest, cap)
        n = sum(many for _, many in made)
        if best is None or n < best[0]:
            best = n, made
        if n == least:
            break
    return out + best[1]


def best_fit(left: np.ndarray, cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing of what is left, whole groups of equal bins at a time."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n and length:
            room = next((r for r in range(length, cap) if bins.get(r)), None)
            if room is None:
                whole = cap // length
                if n >= whole:
                    put, many = (length,) * whole, n // whole
                else:
                    put, many = (length,) * n, 1
                free = cap - length * len(put)
            else:
                held, have = next(iter(bins[room].items()))
                k = min(room // length, n)
                many = min(have, n // k)
                put, free = held + (length,) * k, room - length * k
                bins[room][held] -= many
                if not bins[room][held]:
                    del bins[room][held]
            n -= many * (len(put) if room is None else k)
            group = bins.setdefault(free, {})
            group[put] = group.get(put, 0) + many
    return [(held, many) for group in bins.values() for held, many in group.items()]


def places(plan_: list[tuple[tuple[int, ...], int]], cap: int = CAP) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks, first sequences, how many of the length in a sequence, and the first offset."""
    out: dict[int, list[list[int]]] = {}
    sequence, rank = 0, dict.fromkeys(range(cap + 1), 0)
    for lengths, many in plan_:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            k = lengths.count(length)
            out.setdefault(length, []).append([rank[length], sequence, k, offset])
            rank[length] += k * many
            offset += k * length
        sequence += many
    return {k: tuple(np.array(v, np.int64).T) for k, v in out.items()}


def cut(df: DataFrame, path: str, cap: int = CAP, end: int = 0) -> DataFrame:
    """Pieces of the documents' ids, each with its partition and its rank among the partition's pieces of that length."""
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = load(path), TaskContext.get().partitionId()
        seen = np.zeros(cap + 1, np.int64)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            owner, piece, start, length, crc, rank = ([] for _ in range(6))
            for i, each in enumerate(bpe.many(batch.column(1).to_pylist())):
                ids = each.tobytes() + tail
                for k in range(0, len(ids), 4 * cap):
                    some = ids[k : k + 4 * cap]
                    n = len(some) // 4
                    owner.append(i)
                    piece.append(k // (4 * cap))
                    start.append(k // 4)
                    length.append(n)
                    crc.append(zlib.crc32(some))
                    rank.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(owner), pa.int32()), pa.array(rank, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"],
            )

    return df.select("doc_id", text_of(df).alias("text")).mapInArrow(run, schema)


def place(pieces: DataFrame, cap: int = CAP) -> DataFrame:
    """Give every piece of cut() its sequence_id and offset. The pieces must be a stashed table: ranks may not change."""
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = np.zeros(cap + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most cap rows
        histogram[row["length"]] = row["n"]
    where = places(plan(histogram, cap), cap)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                first, base_, each, off = where[int(n)]
                at = np.searchsorted(first, rank[mine], "right") - 1
                q = rank[mine] - first[at]
                sequence[mine] = base_[at] + q // each[at]
                offset[mine] = off[at] + q % each[at] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names)

    ranked = pieces.join(base, ["length", "part"]).select(*names[:5], (F.col("base") + F.col("rank_in_part")).alias("rank"))
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(df: DataFrame, path: str, cap: int = CAP, end: int = 0) -> DataFrame:
    """Pack whole documents into as few sequences of at most cap ids as the plan finds."""
    return place(stash(cut(df, path, cap, end)), cap)
