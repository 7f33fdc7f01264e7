"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over overlapping chunks that cover the whole document, each filter's largest
activation in a chunk is kept, a hidden layer reads these, and the chunks' hidden values are averaged into one probability.
The network learns from a bounded sample of labelled rows (`SAMPLE` of them and `BYTES` in all, by hash, each with its whole
text), in steps until the loss on the rows of one fold that is held back (`crc32 % 5 = 4`) no longer falls; it scores every
document from all its bytes and from nothing else.

Null and empty texts are one chunk of padding and get a score of their own. Repeated rows get equal scores. Labels that are
null are not learnt from; of a doc_id with several labels or texts the smallest is. With no labelled row of one class every score
is the share of label 1 (0.5 without labels). Extra columns are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.llm.common import stash, text_of, unstash

#: Labelled rows to learn from, and bytes of all their texts, at most; a row is taken whole or not at all.
SAMPLE, BYTES = 6000, 48 << 20
#: Documents of a step; steps of a round, after which the held-back loss is taken; rounds without gain before the end; steps at most.
BATCH, ROUND, PATIENCE, STEPS = 64, 50, 3, 800
#: Chunks whose activations are held at once.
SLICE = 4096
#: Chunks of which all places are held at once.
CACHED = 128
#: Bytes of a chunk, bytes from one chunk to the next, bytes of a filter, bytes from one place of a filter to the next.
CHUNK, STEP, WIDTH, STRIDE = 256, 192, 8, 4
EMBED, FILTERS, HIDDEN = 8, 32, 16
THRESHOLD = 0.3


def chunked(text: bytes) -> np.ndarray:
    """Overlapping chunks of a text as rows of bytes, the last padded with zeros."""
    n = max(1, -(-(len(text) - CHUNK) // STEP) + 1)
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP, 1)).copy()


class Net:
    """embed (256, E); filters (W * E, F) and bias; hidden (F, H) and bias; out (H,) and bias."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)).astype(f),
            "filters": r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(f),
            "fbias": np.zeros(FILTERS, f),
            "hidden": r.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(f),
            "hbias": np.zeros(HIDDEN, f),
            "out": r.normal(0, 0.3, HIDDEN).astype(f),
            "obias": np.zeros(1, f),
        }
        self.constant: float | None = None

    def pool(self, chunks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest activation (n, F) of each filter in each chunk, and its place if asked for; few chunks at once stay in the cache.

        A filter is two halves of STRIDE bytes, and one product has both halves at every spot.
        """
        p, half = self.p, STRIDE * EMBED
        both = np.concatenate([p["filters"][:half], p["filters"][half:]], 1)
        top = np.empty((len(chunks), FILTERS), both.dtype)
        place = np.empty(top.shape, np.int64) if places else None
        for i in range(0, len(chunks), CACHED):
            some = chunks[i : i + CACHED]
            ab = (p["embed"].take(some.ravel(), 0).reshape(-1, half) @ both).reshape(len(some), -1, 2 * FILTERS)
            act = ab[:, :-1, :FILTERS] + ab[:, 1:, FILTERS:]
            top[i : i + CACHED] = act.max(1)
            if place is not None:
                place[i : i + CACHED] = act.argmax(1)
        return top + p["fbias"], place

    def logits(self, chunks: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        p = self.p
        pooled = np.maximum(self.pool(chunks)[0], 0)
        each = np.maximum(pooled @ p["hidden"] + p["hbias"], 0) @ p["out"]
        return np.bincount(owner, each, n) / np.bincount(owner, minlength=n) + float(p["obias"][0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = []
        start = 0
        while start < len(texts):
            group, held = [], 0
            while start + len(group) < len(texts) and held < 4_000_000:
                group.append(chunked(texts[start + len(group)]))
                held += group[-1].size
            owner = np.repeat(np.arange(len(group)), [len(g) for g in group])
            out.append(self.logits(np.concatenate(group), owner, len(group)))
            start += len(group)
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def loss(self, docs: list[np.ndarray], labels: np.ndarray) -> float:
        total = 0.0
        for i in range(0, len(docs), 256):
            some = docs[i : i + 256]
            z = np.clip(self.logits(np.concatenate(some), np.repeat(np.arange(len(some)), [len(d) for d in some]), len(some)), -30, 30)
            total += float((np.logaddexp(0, z) - labels[i : i + 256] * z).sum())
        return total / max(1, len(docs))

    def train(self, docs: list[np.ndarray], labels: np.ndarray, held: np.ndarray | None = None, rate: float = 4e-3) -> Net:
        """Learn from the documents that are not held back, until the loss on those that are no longer falls."""
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(np.mean(labels)) if len(labels) else 0.5
            return self
        held = np.zeros(len(labels), bool) if held is None else held
        if not (held.any() and len(set(labels[~held].tolist())) == 2):
            held = np.zeros(len(labels), bool)
        own, back = np.flatnonzero(~held), np.flatnonzero(held if held.any() else ~held)
        test, goal = [docs[i] for i in back], labels[back]
        share = float(labels[own].mean())
        self.p["obias"][0] = np.log(share / (1 - share))
        r = np.random.default_rng(11)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        best, kept, waited, order = np.inf, self.p, 0, np.zeros(0, int)
        for step in range(1, STEPS + 1):
            if len(order) < min(BATCH, len(own)):
                order = np.concatenate([order, r.permutation(own)])
            mine, order = order[:BATCH], order[BATCH:]
            for k, g in self.gradients([docs[j] for j in mine], labels[mine]).items():
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                self.p[k] = self.p[k] - rate * (1 - 0.9 * step / STEPS) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
            if step % ROUND == 0:
                now = self.loss(test, goal)
                if now < best - 1e-4:
                    best, kept, waited = now, dict(self.p), 0
                else:
                    waited += 1
                    if waited >= PATIENCE:
                        break
        self.p = kept
        return self

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss of the documents, by parameter; long documents pass in slices of chunks."""
        p, chunks = self.p, np.concatenate(docs)
        sizes = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), sizes)
        z = self.logits(chunks, owner, len(docs)) if len(chunks) > SLICE else None
        total: dict[str, np.ndarray] = {}
        for i in range(0, len(chunks), SLICE):
            for k, g in self.part(chunks[i : i + SLICE], owner[i : i + SLICE], sizes, labels, z).items():
                total[k] = total[k] + g if k in total else g
        total["obias"] = total["obias"] / -(-len(chunks) // SLICE)
        return total

    def part(self, chunks: np.ndarray, owner: np.ndarray, sizes: np.ndarray, labels: np.ndarray, z: np.ndarray | None) -> dict[str, np.ndarray]:
        p = self.p
        top, place = self.pool(chunks, places=True)
        pooled = np.maximum(top, 0)
        hidden = np.maximum(pooled @ p["hidden"] + p["hbias"], 0)
        if z is None:
            z = np.bincount(owner, hidden @ p["out"], len(sizes)) / sizes + p["obias"][0]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(sizes)).astype(np.float32)
        share = (dz / sizes)[owner].astype(np.float32)
        g = {"out": hidden.T @ share, "obias": np.array([dz.sum()], np.float32)}
        dh = share[:, None] * p["out"] * (hidden > 0)
        g["hidden"], g["hbias"] = pooled.T @ dh, dh.sum(0)
        dp = dh @ p["hidden"].T * (top > 0)
        g["fbias"] = dp.sum(0)
        # only each filter's largest place passes a gradient on: its sum by byte, byte of the filter and filter gives both gradients
        rows, column = np.arange(len(chunks))[:, None], np.arange(FILTERS)
        by_byte = np.empty((WIDTH, 256, FILTERS), dp.dtype)
        for w in range(WIDTH):
            ids = chunks[rows, place * STRIDE + w].astype(np.int64) * FILTERS + column
            by_byte[w] = np.bincount(ids.ravel(), dp.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        filters = p["filters"].reshape(WIDTH, EMBED, FILTERS)
        g["filters"] = (p["embed"].T @ by_byte).reshape(WIDTH * EMBED, FILTERS)
        g["embed"] = (by_byte @ filters.transpose(0, 2, 1)).sum(0)
        return g


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = BYTES) -> Net:
    """Learn from a bounded sample, by hash, of labelled documents outside fold 0."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id")) != 0)
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = df.select("doc_id", text_of(df).cast("binary").alias("text")).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    texts = stash(texts.withColumns({"h": F.xxhash64("doc_id"), "fold": fold(F.col("doc_id"))}))
    # at most `sample` rows of a few numbers; then the texts of those that fit
    each = sorted((r["h"], r["n"]) for r in texts.select("h", F.length("text").alias("n")).collect())
    fits = np.cumsum([n for _, n in each]) <= size
    last = each[int(fits.sum()) - 1][0] if len(each) and fits.any() else None
    rows = texts.where(F.col("h") <= last).orderBy("h", "doc_id").collect() if last is not None else []
    unstash(texts)
    docs = [chunked(bytes(r["text"])) for r in rows]
    return Net().train(docs, np.array([r["quality"] for r in rows], float), np.array([r["fold"] == 4 for r in rows], bool))


def score(df: DataFrame, net: Net, *keep: str) -> DataFrame:
    """One row per document: its kept columns, score, predicted."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = net.scores(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= THRESHOLD).astype("i4"))], [*keep, "score", "predicted"])

    return df.select(text_of(df).cast("binary").alias("__text"), *keep).mapInArrow(run, schema)


def classify(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score(df, fit(df, labels), "doc_id")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
