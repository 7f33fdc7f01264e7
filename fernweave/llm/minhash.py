"""Near-duplicate documents by Order MinHash.

A text's five-word shingles are labelled with their occurrence. Each of SKETCHES hash functions picks the PICKS smallest
labelled shingles and keeps them in text order, so equal picks speak for a small edit distance and not only for a common set;
ROWS sketches make a band, and texts with an equal band are candidates. Candidates are verified by a banded alignment of their
shingles without the labels, which belong to the sampling: similarity is 1 - edit distance / longer length, and texts with
SIMILARITY or more are linked. Groups are the connected components of the links; the smallest doc_id of a group stays.

Equal texts (lower case, words between ASCII white space) become one class first, so thousands of copies cost one candidate.
In a bucket every class is held against PIVOTS pivots, which joins most of what belongs together. What is then still to be told
are a bucket's members outside its main component (its others): a call holds a block of the others against a block of all
members and gives back the links that join components, so a member is sent once, and an other once for each block. A pair is
compared in the first band that it shares. Before an alignment pairs are left out only by their lengths and by how many
shingles they share, which a pair at the bound cannot fail.

Buckets with more others than a block holds (wide buckets) are worked through in pairs of blocks, or their members are dealt by
their rarest shingles, one more than the bound lets a text lose, whichever sends fewer bytes. Two texts at the bound have one
of these shingles in common, and a pair that shares a band is held against each other in the rarest one it shares; so both ways
give the same groups, and a bucket's size decides only how much is sent.

Chance: a pair at the bound (a fifth of its shingles replaced) shares a sketch with 0.44, a band with 0.20 and some band with
0.999. Tests measure it by brute force.

Null texts are empty. Texts without words are one class and link with nothing else; texts of one to four words are one shingle
each. A row without doc_id goes by a stand-in made from its text's hash. Rows that share a doc_id but not the text count each
as a document. An empty table gives an empty result; extra columns are left alone; texts count whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import components, small_enough, stash, text_of, unstash

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, PICKS = 32, 2, 2
SKETCHES = BANDS * ROWS
#: Members of a bucket that all are held against: those of the least and the greatest hash, so that they differ.
PIVOTS = 2
#: Members and bytes of a block; a call holds two blocks of a bucket, or small buckets of about TOGETHER members and bytes.
BLOCK, TOGETHER = (512, 8 << 20), (2000, 16 << 20)
#: Counters by which shingles are put in order of rarity; what shares a counter counts together.
COUNTERS = 1 << 18
#: Shingles of a block that are counted at once.
COUNTED = 1_000_000

MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MUL[0]
    h = (h ^ (h >> np.uint64(29))) * MUL[1]
    return h ^ (h >> np.uint64(32))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


WORDS = Words()


def plain_shingles(text: bytes) -> np.ndarray:
    """Hashes of the shingles of a text, in text order."""
    words = text.lower().split()
    w = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h += w[k : k + n] * MUL[k]
    return mix(h + np.uint64(min(len(w), SHINGLE)))


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes labelled with their occurrence; all differ."""
    n = len(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.flatnonzero(s[1:] == s[:-1]) + 1
    if len(same):
        start = np.ones(n, bool)
        start[same] = False
        first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        label = np.empty(n, np.uint64)
        label[order] = np.arange(n) - first
        h = h.astype(np.uint64, copy=False)
        h = np.where(label > 0, mix(h + label * MUL[2]), h)
    return h


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles of a text, in text order; all differ."""
    return labelled(plain_shingles(text))


@lru_cache(maxsize=1)
def functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(5)
    return r.integers(0, 1 << 32, SKETCHES, np.uint32)[:, None] | np.uint32(1), r.integers(0, 1 << 32, SKETCHES, np.uint32)[:, None]


def sketch(h: np.ndarray) -> np.ndarray:
    """SKETCHES hashes, each of the PICKS smallest shingles in text order."""
    a, b = functions()
    low, n = (h >> np.uint64(32)).astype(np.uint32), len(h)
    picks = min(PICKS, n)
    at = np.empty((SKETCHES, picks), np.int64)
    every = np.arange(SKETCHES)
    step = max(1, 40_000 // n)
    for i in range(0, SKETCHES, step):
        v = (low[None] ^ b[i : i + step]) * a[i : i + step]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        rows = every[: len(v)]
        for k in range(picks):
            at[i : i + step, k] = m = v.argmin(1)
            v[rows, m] = np.uint32(0xFFFFFFFF)
    at.sort(1)
    out = np.zeros(SKETCHES, np.uint64)
    for k in range(picks):
        out = mix(out * MUL[3] + h[at[:, k]])
    return out


def longest_rise(seq: np.ndarray) -> np.ndarray:
    """Indices of a longest rising subsequence."""
    if len(seq) < 2 or (seq[1:] > seq[:-1]).all():
        return np.arange(len(seq))
    from bisect import bisect_left

    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(seq)
    for i, x in enumerate(seq.tolist()):
        k = bisect_left(tails, x)
        if k:
            back[i] = ends[k - 1]
        if k == len(tails):
            tails.append(x)
            ends.append(i)
        else:
            tails[k], ends[k] = x, i
    out, i = [], ends[-1]
    while i >= 0:
        out.append(i)
        i = back[i]
    return np.array(out[::-1])


def banded(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of a and b if it is at most `most`, else most + 1, from the cells within `most` of the diagonal."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    width = 2 * most + 1
    big = np.int64(most + 1 + n + m)
    offset = np.arange(width)
    padded = np.concatenate([np.zeros(most, b.dtype), b, np.zeros(2 * most + 2, b.dtype)])
    inside = lambda i: (offset + i - most >= 0) & (offset + i - most <= m)  # noqa: E731  column j = i + offset - most
    row = np.where(inside(0), offset - most, big)
    for i in range(1, n + 1):
        j = offset + i - most
        change = row + (padded[i - 1 : i - 1 + width] != a[i - 1])
        change[j < 1] = big
        up = np.append(row[1:], big) + 1
        new = np.minimum(change, up)
        new[~inside(i)] = big
        row = np.minimum.accumulate(new - offset) + offset
        row[~inside(i)] = big
        if row.min() > most:
            return most + 1
    return int(min(row[m - n + most], most + 1))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the alignment of two sequences of shingles has SIMILARITY or more."""
    n, m = len(a), len(b)
    if not n or not m:
        return n == m
    most = int((1 - SIMILARITY) * max(n, m) + 1e-9)
    if abs(n - m) > most:
        return False
    # labels pair off as many shingles as both have, and what rises among these pairs is one alignment
    _, at, to = np.intersect1d(labelled(a), labelled(b), assume_unique=True, return_indices=True)
    if max(n, m) - len(at) > most:  # at least so many shingles must be edited
        return False
    order = np.argsort(at)
    at, to = at[order], to[order]
    keep = longest_rise(to)
    x, y = np.diff(at[keep], prepend=-1, append=n), np.diff(to[keep], prepend=-1, append=m)
    if int((np.maximum(x, y) - 1).sum()) <= most:  # one alignment shows it
        return True
    front = 0
    while front < min(n, m) and a[front] == b[front]:
        front += 1
    back = 0
    while back < min(n, m) - front and a[-1 - back] == b[-1 - back]:
        back += 1
    return banded(a[front : n - back], b[front : m - back], most) <= most


def normal(df: DataFrame) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text_of(df), r"[\t-\r ]+", " "), "^ | $", ""))


def node_of(df: DataFrame) -> Column:
    return F.coalesce(df["doc_id"].cast("long"), -F.shiftrightunsigned(F.xxhash64(text_of(df)), 2) - 1)


def sketched(df: DataFrame) -> DataFrame:
    """node, t (hash of the text as it is), c, e (two hashes of the words), keys (of bands), n (number of shingles) and size
    (bytes) of every row; keys and n are null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            c, e, keys, sizes, length = [], [], [], [], []
            for text in batch.column(2):
                plain = b" ".join(text.as_py().lower().split())
                c.append(xxhash.xxh64_intdigest(plain) - (1 << 63))
                e.append(xxhash.xxh64_intdigest(plain, 77) - (1 << 63))
                length.append(len(plain))
                h = shingles(plain)
                if len(h):
                    s = sketch(h)
                    key = seed
                    for r in range(ROWS):
                        key = mix(key * MUL[4] + s[r::ROWS])
                    keys.append(key.view(np.int64))
                    sizes.append(len(h))
                else:
                    keys.append(None)
                    sizes.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(c, pa.int64()), pa.array(e, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(length, pa.int64())],
                ["node", "t", "c", "e", "keys", "n", "size"],
            )

    rows = df.select(node_of(df).alias("node"), F.xxhash64(text_of(df)).alias("t"), text_of(df).cast("binary").alias("text"))
    return rows.mapInArrow(run, "node long, t long, c long, e long, keys array<long>, n long, size long")


def classes_of(every: DataFrame) -> DataFrame:
    """One row per class of equal words: c, e, first (smallest node), rep (first, or a stand-in where classes share it), n_copies,
    t (a text of it), keys, n, size."""
    found = stash(
        every.groupBy("c", "e").agg(
            F.min(F.struct("node", "t")).alias("low"), F.count("*").alias("n_copies"), F.first("keys", True).alias("keys"), F.first("n", True).alias("n"), F.first("size", True).alias("size")
        ).select("c", "e", F.col("low.node").alias("first"), F.col("low.t").alias("t"), "n_copies", "keys", "n", "size")
    )
    twice = stash(found.groupBy("first").agg(F.count("*").alias("k")).where("k > 1").select("first"))
    if twice.isEmpty():
        return found.withColumn("rep", F.col("first"))
    rep = F.when(F.col("shared"), -F.shiftrightunsigned(F.xxhash64("c", "e"), 2) - 1).otherwise(F.col("first"))
    return stash(found.join(twice.withColumn("shared", F.lit(True)), "first", "left").withColumn("rep", rep).drop("shared"))


def texts_of(df: DataFrame, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """b, text of the classes named in needed (b)."""
    needed = stash(classes.select(F.col("rep").alias("b"), F.col("first").alias("node"), "t").join(needed, "b", "left_semi"))
    rows = df.select(node_of(df).alias("node"), F.xxhash64(text_of(df)).alias("t"), text_of(df).cast("binary").alias("text"))
    return rows.join(small_enough(needed), ["node", "t"]).groupBy("b").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, classes: DataFrame, df: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes whose texts are similar."""
    needed = pairs.select(F.col("a").alias("b")).union(pairs.select("b")).distinct()
    texts = texts_of(df, classes, needed)
    both = pairs.join(texts.withColumnRenamed("text", "tb"), "b").join(texts.select(F.col("b").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            yes = []
            for k, (a, ta, tb) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
                if a not in held:
                    held.clear()  # pairs come with the same smaller class in a row
                    held[a] = plain_shingles(ta.as_py())
                if similar(held[a], plain_shingles(tb.as_py())):
                    yes.append(k)
            yield batch.select(["a", "b"]).take(pa.array(yes, pa.int64()))

    return stash(both.mapInArrow(run, "a long, b long"))


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles each of x has in common with each of y."""

    def listed(z: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, at = np.concatenate(z), np.repeat(np.arange(len(z)), [len(v) for v in z])
        order = np.argsort(h)
        return h[order], at[order]

    out = np.zeros((len(x), len(y)), np.int32)
    (h, i), (k, j) = listed(x), listed(y)
    both = np.intersect1d(h, k)
    ends = [np.searchsorted(v, both, side).tolist() for v in (h, k) for side in ("left", "right")]
    for p, q, r, s in zip(*ends):
        out[i[p:q, None], j[None, r:s]] += 1
    return out


def parts(n: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows of about COUNTED shingles."""
    part = np.cumsum(n) // COUNTED
    at = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(n)]
    return list(zip(at, at[1:]))


def counters(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(COUNTERS)).astype(np.int64)


def rarest(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest of a text's labelled shingles, rarest first: one more than it can lose at the bound, so that any two texts at
    the bound have one of them in common. The order is the same for all texts, by counter and hash."""
    most = int((1 - SIMILARITY) * len(h) + 1e-9)
    return h[np.lexsort((h, counts[counters(h)]))[: most + 1]]


def joined(bands: int, depth: int, table: dict[str, np.ndarray], texts: list[bytes], before_it: Callable[[np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Of one call's rows of a bucket: links (places of rows) between the probing rows and the rows of the block that join
    different components, found in order of closeness. At depth 1 a bucket is one of the band after the first `bands`, and pairs
    that share one of these are left to it; at depth 2 it is one of a shingle, for pairs that share one of the first `bands`
    bands but none of the rarer shingles, which before_it gives from a text's labelled shingles."""
    a, b = np.flatnonzero(table["probe"]), np.flatnonzero(table["target"])
    g, n, keys, ids, other = (table[k] for k in ("g", "n", "keys", "b", "other"))
    near = (g[a][:, None] != g[b][None]) & (~other[b][None] | (ids[a][:, None] < ids[b][None]))  # two others meet twice
    met = np.zeros(near.shape, bool)
    for k in range(bands):
        met |= keys[a, k][:, None] == keys[b, k][None]
    near &= ~met if depth == 1 else met
    longer = np.maximum(n[a][:, None], n[b][None])
    least = longer - ((1 - SIMILARITY) * longer + 1e-9).astype(np.int64)  # each shingle that is not shared is an edit
    near &= np.minimum(n[a][:, None], n[b][None]) >= least
    if not near.any():
        return []
    some, more = near.any(1), near.any(0)
    a, b = a[some], b[more]
    near, longer, least = (v[some][:, more] for v in (near, longer, least))
    if before_it:
        near &= shared_counts(*([before_it(shingles(texts[z])) for z in v] for v in (a, b))) == 0
    shared = np.zeros(near.shape, np.int32)
    for p, q in parts(n[a]):
        x = [shingles(texts[z]) for z in a[p:q]]
        for r, s in parts(n[b]):
            shared[p:q, r:s] = shared_counts(x, [shingles(texts[z]) for z in b[r:s]])
    u, w = np.nonzero(near & (shared >= least))
    order = np.argsort(-shared[u, w] / longer[u, w], kind="stable")
    u, w = a[u[order]], b[w[order]]
    root = {x: x for x in g.tolist()}
    held: dict[int, np.ndarray] = {}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    out = []
    for x, y in zip(u.tolist(), w.tolist()):
        p, q = find(int(g[x])), find(int(g[y]))
        if p != q:
            for z in (x, y):
                if z not in held:
                    held[z] = plain_shingles(texts[z])
            if similar(held[x], held[y]):
                root[max(p, q)] = min(p, q)
                out.append((x, y))
    return out


def keyed(key: Column, band: Column) -> Column:
    """A bucket's key, its band in the lowest bits."""
    return key.bitwiseAND(F.lit(-BANDS).cast("long")).bitwiseOR(band.cast("long"))


def mixed_buckets(level: DataFrame, compared: int) -> DataFrame:
    """Buckets of several components: key, main (their largest), blocks of all members, probes (blocks of the others), sent (bytes
    of texts sent for them). In buckets of up to `compared` members all pairs have been compared."""
    by_group = level.groupBy("key", "g").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    found = by_group.groupBy("key").agg(F.max(F.struct("c", "g", "s")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK[0]), F.ceil(s / BLOCK[1]), F.lit(1)).cast("int")
    found = found.where((F.col("main.c") < F.col("c")) & (F.col("c") > compared))
    found = found.withColumns({"blocks": blocks(F.col("c"), F.col("s")), "probes": blocks(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s"))})
    return stash(found.select("key", F.col("main.g").alias("main"), "blocks", "probes", (F.col("s") * F.col("probes") + (F.col("s") - F.col("main.s")) * F.col("blocks")).alias("sent")))


def by_rarest(members: DataFrame, classes: DataFrame, df: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The members (b, g, size) once for each of their rarest shingles that others may have (key), and the counters that tell
    which are rare among the members."""
    texts = stash(texts_of(df, classes, members.select("b")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            counts += np.bincount(counters(np.concatenate([shingles(text.as_py()) for text in batch.column(0)])), minlength=COUNTERS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "c"])

    found = texts.select("text").mapInArrow(count, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).where("c > 1").toArrow()
    counts = np.ones(COUNTERS, np.int64)
    counts[found.column("at").to_numpy()] = found.column("c").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column(1):
                h = rarest(shingles(text.as_py()), counts)
                keys.append(h[counts[counters(h)] > 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["b", "keys"])

    level = stash(members.join(texts.select("b", "text").mapInArrow(run, "b long, keys array<long>"), "b").select("b", "g", "size", F.explode("keys").alias("key")))
    unstash(texts)
    return level, counts


def last_round(shared: DataFrame, groups: DataFrame, classes: DataFrame, df: DataFrame) -> DataFrame:
    """Links (a, b) between members of a bucket that are of different components so far."""
    level = stash(shared.join(groups.withColumnRenamed("node", "b"), "b", "left").select("b", F.coalesce("component", "b").alias("g"), "size", "key"))
    mixed = mixed_buckets(level, PIVOTS + 1)
    members, used, counts = level.join(mixed, "key").withColumn("depth", F.lit(1)), [level, mixed], None
    wide = mixed.where("probes > 1")
    if not wide.isEmpty():
        wide_members = stash(level.join(wide, "key", "left_semi").select("b", "g", "size").distinct())
        finer, counts = by_rarest(wide_members, classes, df)
        by_shingle = mixed_buckets(finer, 1)
        used += [wide_members, finer, by_shingle]
        in_blocks, by_rare = (x.agg(F.coalesce(F.sum("sent"), F.lit(0))).first()[0] for x in (wide, by_shingle))
        if by_rare < in_blocks:
            members = members.where("probes = 1").union(finer.join(by_shingle, "key").withColumn("depth", F.lit(2)))
    members = members.drop("sent").withColumn("other", F.col("g") != F.col("main"))
    m, p = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("b", F.lit(1)), F.col("probes")).cast("int")
    members = stash(members.withColumns({"m": m, "p": p}))
    total = members.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    calls = int(max(1, total[0] // TOGETHER[0], total[1] // TOGETHER[1]))
    # a member is in its block for all probes, an other also among its probes for all blocks
    spots = F.transform(F.sequence(F.lit(0), F.col("probes") - 1), lambda o: F.struct(F.col("m").alias("i"), o.alias("j")))
    more = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(o.alias("i"), F.col("p").alias("j")))
    spots = F.when(F.col("other"), F.array_union(spots, more)).otherwise(spots)
    call = F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("key"), F.lit(calls))).otherwise(F.col("key"))
    sent = members.select("b", "g", "key", "depth", "other", "m", "p", call.alias("call"), F.explode(spots).alias("at"))
    whole_rows = classes.select(F.col("rep").alias("b"), "keys", "n").join(texts_of(df, classes, members.select("b").distinct()), "b")
    rows = sent.join(whole_rows, "b").select(
        "call", "at.i", "at.j", "b", "key", "depth", "g", "other", (F.col("m") == F.col("at.i")).alias("target"), (F.col("other") & (F.col("p") == F.col("at.j"))).alias("probe"), "keys", "n", "text"
    )

    def rarer(than: np.uint64) -> Callable[[np.ndarray], np.ndarray]:
        def before_it(h: np.ndarray) -> np.ndarray:
            h = rarest(h, counts)
            return h[: np.flatnonzero(h == than)[0]]

        return before_it

    def block(found: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        found = found.sort_by([("key", "ascending"), ("b", "ascending")])
        whole = {k: found.column(k).to_numpy() for k in ("b", "g", "n", "other", "target", "probe")}
        whole["keys"] = found.column("keys").combine_chunks().flatten().to_numpy().reshape(len(whole["b"]), -1)
        key, depth, b = found.column("key").to_numpy(), found.column("depth").to_numpy(), whole["b"]
        at = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for x, y in zip(at, at[1:]):
            part = found.column("text").slice(x, y - x).to_pylist()
            how = (int(key[x]) & BANDS - 1, 1) if depth[x] == 1 else (BANDS, 2)
            out += [(int(b[x + u]), int(b[x + w])) for u, w in joined(*how, {k: v[x:y] for k, v in whole.items()}, part, None if depth[x] == 1 else rarer(key[x : x + 1].view(np.uint64)[0]))]
        return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})

    links = stash(rows.groupBy("call", "i", "j").applyInArrow(block, "a long, b long"))
    unstash(members, *used)
    return links


def grouped(df: DataFrame) -> DataFrame:
    """node, t, class_id, root (the group's smallest rep), component_id (its smallest node) and n_copies of every row."""
    every = stash(sketched(df))
    classes = classes_of(every)
    bands = classes.where("keys IS NOT NULL").select(F.col("rep").alias("b"), F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("size")).alias("ns"), F.posexplode("keys").alias("band", "k"))
    bands = bands.select("b", "ns", keyed(F.xxhash64("band", "k"), F.col("band")).alias("key"))
    low = bands.groupBy("key").agg(F.min("b").alias("first"), F.max("b").alias("last")).where("first < last").select("key")
    shared = stash(bands.join(low, "key").select("b", "key", F.shiftright("ns", 32).alias("n"), F.col("ns").bitwiseAND(F.lit((1 << 32) - 1)).alias("size")))
    pivots = F.array(*(by(F.struct("b", "n"), F.xxhash64("b")) for by in (F.min_by, F.max_by)))
    chosen = shared.groupBy("key").agg(pivots.alias("p")).select("key", F.explode("p").alias("p")).select("key", F.col("p.b").alias("a"), F.col("p.n").alias("na"))
    pairs = shared.join(chosen, "key").where(F.col("a") != F.col("b")).where(F.abs(F.col("na") - F.col("n")) <= F.floor(F.greatest("na", "n") * (1 - SIMILARITY) + 1e-9))
    pairs = stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = verified(pairs, classes, df)
    groups = stash(components(links))
    more = last_round(shared, groups, classes, df)
    if not more.isEmpty():
        unstash(groups)
        groups = stash(components(links.union(more)))
    unstash(shared, pairs, links, more)
    least = groups.join(classes.select(F.col("rep").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("smallest"))
    named = groups.join(least, "component").select(F.col("node").alias("rep"), F.col("component").alias("root"), "smallest")
    each = classes.select("c", "e", "first", "rep", "n_copies").join(named, "rep", "left")
    each = each.select("c", "e", F.col("first").alias("class_id"), F.coalesce("root", "rep").alias("root"), F.coalesce("smallest", "first").alias("component_id"), "n_copies")
    return every.select("node", "t", "c", "e").join(each, ["c", "e"]).drop("c", "e")


def near_duplicates(df: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, component_id (smallest doc_id of the group), n_copies of the class, kept."""
    return grouped(df).select(F.col("node").alias("doc_id"), "class_id", "component_id", "n_copies", (F.col("node") == F.col("component_id")).alias("kept"))


def dedup(df: DataFrame) -> DataFrame:
    """The input's rows of the documents that stay, one for each group."""
    stay = grouped(df).where("node = component_id").groupBy("root").agg(F.min(F.struct("node", "t")).alias("x")).select("x.*")
    # the input's row is one column, so no name of it meets one of ours
    own = df.select(F.struct(*df.columns).alias("row"), node_of(df).alias("node"), F.xxhash64(text_of(df)).alias("t"))
    return own.join(stay, ["node", "t"], "left_semi").dropDuplicates(["node", "t"]).select("row.*")
