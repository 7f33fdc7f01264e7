"""LM scoring by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Words are counted over all training documents. The HEAD most frequent of them and the end have vectors of their own; the
others share CLASSES classes by their last bytes, within which a word has its smoothed share. The model predicts the next
symbol from the two before it: a context vector is the sum of two position-weighted vectors, its product with all symbols'
vectors gives scores, and their exponentials are normalised over all symbols, in batches of distinct contexts. It is trained
first on a bounded warm-up sample on the driver, then on all training documents: they are dealt by hash into shards of about
SHARD tokens (at most SHARDS shards), each shard goes on from the warm model by noise-contrastive estimation over its documents
in the order of their hashes, and the models are averaged by their tokens. So the model is the same however the table is
partitioned. What is dealt are symbols, two bytes a token. Words outside the head are few; documents send theirs, by hash, to the
table of all counts, so no vocabulary is broadcast.

Null and empty texts have the end alone. Repeated rows get equal scores and each counts. An empty table gives an empty
result; without training tokens all counts are 0 and the model is uniform. Rows without doc_id are training rows. Extra
columns are left alone. Texts are scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import stash, text_of

HEAD, CLASSES, DIM = 640, 128, 24
NOISE, BATCH = 48, 2048
#: Words that are at least one in so many of all training tokens are known to every task; there can be no more of them.
KNOWN = 400_000
#: Where the sums of squared gradients start.
INIT = 1.0
#: Tokens of a shard of the training documents, as long as there are no more than so many shards.
SHARD, SHARDS = 1_000_000, 4096
#: Documents of the warm-up sample; of each at most 6000 characters are taken.
WARM_DOCS = 1500
END = b"\n"


def held_out(df: DataFrame) -> Column:
    return F.coalesce(F.crc32(df["doc_id"].cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    """Lower-case A-Z, part at ASCII white space, and one end."""
    out = text.lower().split()
    out.append(END)
    return out


def tail_class(word: bytes) -> int:
    return HEAD + 1 + xxhash.xxh32_intdigest(word[-2:]) % CLASSES


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class Symbols(dict):
    """Symbols of words: 0.. HEAD - 1 head words, HEAD the end, then the classes; HEAD + 1 + CLASSES stands before a text."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            for k in [k for k, v in self.items() if v > HEAD]:
                del self[k]
        self[word] = s = tail_class(word)
        return s


class Lexicon(dict):
    """Numbers of words as they come, with their symbols, keys and training counts (-1: not known here)."""

    def __init__(self, symbols: dict[bytes, int], known: dict[bytes, int]):
        self.symbols, self.known = symbols, known
        self.symbol, self.key, self.count = [], [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.symbol)
        self.symbol.append(self.symbols[word] if word in self.symbols else HEAD if word == END else tail_class(word))
        self.key.append(word_key(word))
        self.count.append(self.known.get(word, 0 if word == END else -1))
        return n

    def trim(self) -> None:
        if len(self) > 150_000:
            self.clear()
            self.symbol, self.key, self.count = [], [], []


SIZE = HEAD + 1 + CLASSES
START = SIZE


class Lbl:
    def __init__(self, unigram: np.ndarray):
        r = np.random.default_rng(3)
        f = np.float32
        self.share = (unigram + 0.1) / (unigram + 0.1).sum()
        self.p = {
            "first": r.normal(0, 0.1, (SIZE + 1, DIM)).astype(f),  # of the word before
            "second": r.normal(0, 0.1, (SIZE + 1, DIM)).astype(f),  # of the word before that
            "out": r.normal(0, 0.1, (SIZE, DIM)).astype(f),
            "bias": np.log(self.share).astype(f),
        }

    def train(self, sequences: Iterator[np.ndarray], rate: float, seed: int = 1) -> int:
        """Noise-contrastive estimation: the next symbol against NOISE symbols drawn for each batch. Returns the tokens seen."""
        p, r, seen = self.p, np.random.default_rng(seed), 0
        cumulated = np.cumsum(self.share)
        log_noise = np.log(NOISE * self.share).astype(np.float32)
        square = {k: np.full(v.shape, INIT, np.float32) for k, v in p.items()}
        for a, b, w in batches_of(sequences):
            seen += len(w)
            context = p["first"][a] + p["second"][b]
            noise = np.minimum(np.searchsorted(cumulated, r.random(NOISE)), SIZE - 1)
            good = np.einsum("nd,nd->n", context, p["out"][w]) + p["bias"][w] - log_noise[w]
            bad = context @ p["out"][noise].T + (p["bias"][noise] - log_noise[noise])
            dg = -1 / (1 + np.exp(np.clip(good, -15, 15)))
            db = 1 / (1 + np.exp(-np.clip(bad, -15, 15)))
            dc = dg[:, None] * p["out"][w] + db @ p["out"][noise]
            grads = [("first", a, dc), ("second", b, dc), ("out", np.concatenate([w, noise]), np.concatenate([dg[:, None] * context, db.T @ context])), ("bias", np.concatenate([w, noise]), np.concatenate([dg, db.sum(0)]))]
            for name, ids, g in grads:
                order = np.argsort(ids, kind="stable")
                s = ids[order]
                at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                total, u = np.add.reduceat(g[order], at, axis=0), s[at]
                square[name][u] += total * total
                p[name][u] -= rate * total / np.sqrt(square[name][u])
        return seen

    def prepare(self) -> None:
        self.norms = np.full((SIZE + 1) * (SIZE + 1), np.nan, np.float32)

    def log10(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of symbols w after a (the one before) and b (the one before that)."""
        p = self.p
        code = a.astype(np.int64) * (SIZE + 1) + b
        new = np.unique(code[np.isnan(self.norms[code])])
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            s = (p["first"][some // (SIZE + 1)] + p["second"][some % (SIZE + 1)]) @ p["out"].T + p["bias"]
            top = s.max(1, keepdims=True)
            self.norms[some] = top[:, 0] + np.log(np.exp(s - top).sum(1))
        out = np.empty(len(w))
        for i in range(0, len(w), 1 << 18):
            j = slice(i, i + (1 << 18))
            out[j] = np.einsum("nd,nd->n", p["first"][a[j]] + p["second"][b[j]], p["out"][w[j]]) + p["bias"][w[j]] - self.norms[code[j]]
        return out / math.log(10)


def contexts(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols before, and before those, for a run of texts that each close with the end."""
    a = np.concatenate([[START], seq[:-1]])
    a[1:][seq[:-1] == HEAD] = START
    b = np.concatenate([[START], a[:-1]])
    b[a == START] = START
    return a, b


def batches_of(sequences: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for seq in sequences:
        a, b = contexts(seq)
        for i in range(0, len(seq), BATCH):
            yield a[i : i + BATCH], b[i : i + BATCH], seq[i : i + BATCH]


def joined(sequences: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Texts' symbols in runs of some hundred thousand."""
    held: list[np.ndarray] = []
    n = 0
    for seq in sequences:
        held.append(seq)
        n += len(seq)
        if n > 200_000:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def symbols_of(text: bytes, table: Symbols) -> np.ndarray:
    words = tokens(text)
    return np.fromiter(map(table.__getitem__, words), np.int32, len(words))


def count(df: DataFrame) -> DataFrame:
    """Words of the training documents: key, word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([word_key(w) for w in seen], pa.int64()), pa.array([*seen], pa.binary()), pa.array([*seen.values()], pa.int64())], ["key", "word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        yield out()

    rows = df.where(~held_out(df)).select(text_of(df).cast("binary").alias("text"))
    return rows.mapInArrow(run, "key long, word binary, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, head: dict[bytes, int], unigram: np.ndarray, total: int) -> Lbl:
    """The warm model, trained further on all training documents and averaged."""
    train = df.where(~held_out(df))
    warm = Lbl(unigram)
    # a bounded sample: by hash, and of long texts the part around a place by hash
    key = F.xxhash64(text_of(df))
    few = train.select(key.alias("h")).distinct().orderBy("h").limit(WARM_DOCS)
    size = F.length("text")
    part = F.when(size <= 6000, F.col("text")).otherwise(F.substring("text", F.pmod(F.hash("text"), size - 6000) + 1, F.lit(6000)))
    found = train.select(key.alias("h"), text_of(df).alias("text")).join(F.broadcast(few), "h").select("h", part.alias("text"))
    texts = [r["text"].encode() for r in found.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()]
    table = Symbols(head)
    warm.train(joined(symbols_of(t, table) for t in texts), 0.1)
    shapes = [(k, v.shape) for k, v in warm.p.items()]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Symbols(head)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([symbols_of(t.as_py(), own).astype("<u2").tobytes() for t in batch.column(1)], pa.binary())], ["h", "symbols"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((shard, symbols.as_py()) for batch in batches for shard, symbols in zip(batch.column(0).to_pylist(), batch.column(1)))
        for shard, mine in groupby(rows, itemgetter(0)):
            model = Lbl(unigram)
            model.p = {k: v.copy() for k, v in warm.p.items()}
            seen = model.train(joined(np.frombuffer(x, "<u2").astype(np.int32) for _, x in mine), 0.05, seed=17 + shard)
            flat = np.concatenate([model.p[k].ravel() for k, _ in shapes]).astype(np.float64)
            for i in range(0, len(flat), 256):
                yield pa.RecordBatch.from_arrays([pa.array([i // 256], pa.int32()), pa.array([seen], pa.int64()), pa.array([flat[i : i + 256]], pa.list_(pa.float64()))], ["block", "seen", "values"])

    def mean(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = 0.0, 0
        for batch in rows:
            for seen, values in zip(batch.column("seen").to_pylist(), batch.column("values")):
                total, weight = total + np.array(values.as_py()) * seen, weight + seen
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total / weight], pa.list_(pa.float64()))], ["block", "values"])

    shards = min(SHARDS, max(1, -(-total // SHARD)))
    spelt = train.select(F.xxhash64("doc_id", text_of(df)).alias("h"), text_of(df).cast("binary").alias("text")).mapInArrow(spell, "h long, symbols binary")
    dealt = spelt.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "symbols").repartition(shards, "shard").sortWithinPartitions("shard", "h", "symbols")
    models = dealt.select("shard", "symbols").mapInArrow(run, "block int, seen long, values array<double>")
    rows = models.groupBy("block").applyInArrow(mean, "block int, values array<double>").collect()  # the model's size, whatever the input's
    if rows:
        flat = np.concatenate([r["values"] for r in sorted(rows, key=lambda r: r["block"])])
        at = 0
        for k, shape in shapes:
            n = int(np.prod(shape))
            warm.p[k] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n
    return warm


def score(df: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    counts = stash(count(df))
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = {bytes(r["word"]): r["n"] for r in counts.where(F.col("n") * KNOWN >= F.lit(total)).collect()}
    words = sorted((w for w in known if w != END), key=lambda w: (-known[w], w))[:HEAD]
    head = {w: i for i, w in enumerate(words)} | {END: HEAD}
    symbols = {w: head[w] if w in head else tail_class(w) for w in known}

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([-1 if w in head else tail_class(w) for w in batch.column(1).to_pylist()], pa.int32())], ["key", "n", "class"])

    tail = stash(counts.mapInArrow(classed, "key long, n long, class int"))
    class_n, class_v = np.zeros(SIZE), np.zeros(SIZE)
    for r in tail.where("class >= 0").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # at most CLASSES rows
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    unigram = class_n.copy()
    for w in head:
        unigram[head[w]] = known.get(w, 0)
    model = fit(df, head, unigram, int(total))
    spare = math.log10(total + 0.5 * (types + 1))
    size_log = np.log10(class_n + 0.5 * (class_v + 1))
    size_log[: HEAD + 1] = 0
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.prepare()
        seen = Lexicon(symbols, known)
        for batch in batches:
            texts, start = batch.column(1), 0
            while start < len(texts):
                sizes, parts, n = [], [], 0
                seen.trim()
                while start + len(sizes) < len(texts) and n < 200_000:
                    words = tokens(texts[start + len(sizes)].as_py())
                    parts.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
                    sizes.append(len(words))
                    n += len(words)
                ids, owner = np.concatenate(parts), np.repeat(np.arange(len(sizes)), sizes)
                symbol, count_ = (np.array(x, np.int64)[ids] for x in (seen.symbol, seen.count))
                a, b = contexts(symbol)
                s = np.bincount(owner, model.log10(a, b, symbol), len(sizes))
                here = count_ >= 0
                log = np.where(here, np.log10(np.where(here, count_, 0) + 0.5), 0.0)
                in_class = symbol > HEAD
                s += np.bincount(owner, np.where(in_class, log - size_log[symbol], 0.0), len(sizes))
                base = np.bincount(owner, log, len(sizes))
                hit = np.bincount(owner, count_ > 0, len(sizes)).astype(np.int64)
                far = np.flatnonzero(~here)
                pairs, times = np.unique((owner[far] << 32) | ids[far], return_counts=True)
                offsets = np.searchsorted(pairs, np.arange(len(sizes) + 1) << 32).astype(np.int32)
                keys = np.array(seen.key, np.int64)[pairs & 0xFFFFFFFF] if len(pairs) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(sizes)), batch.column(2).slice(start, len(sizes)), pa.array(sizes, pa.int64()), pa.array(hit), pa.array(base), pa.array(s),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int64))),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_hit", "base", "model", "keys", "times"],
                )
                start += len(sizes)

    rows = df.select("doc_id", text_of(df).cast("binary").alias("text"), held_out(df).alias("held_out"))
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_hit long, base double, model double, keys array<long>, times array<long>")
    scored = stash(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", "x.keys", "x.times")
    found = rare.join(tail.groupBy("key").agg(F.sum("n").alias("n")).select(F.col("key").alias("keys"), "n"), "keys").groupBy("row").agg(
        F.sum(F.log10(F.col("n") + 0.5) * F.col("times")).alias("log"), F.sum("times").alias("found")
    )
    # what a document has outside the known words and the table was never seen in training
    out = scored.select("row", "doc_id", "held_out", "n_tokens", "n_hit", "base", "model", F.aggregate("times", F.lit(0).cast("long"), lambda x, y: x + y).alias("rare")).join(found, "row", "left")
    got, logs = F.coalesce("found", F.lit(0)), F.coalesce("log", F.lit(0.0))
    tail_log = logs + (F.col("rare") - got) * math.log10(0.5)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hit") + got).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + tail_log - F.col("n_tokens") * F.lit(spare)).alias("base_score"), (F.col("model") + tail_log).alias("score"),
    )
