"""BPE encoding and decoding by contiguous rank arrays.

A word is held as a short array of parts with the merge ranks of adjacent parts beside it; the smallest rank is looked for by
scanning, its boundary deleted, and the two neighbouring ranks refreshed. Long words use a heap for the same order of merges.
The encoder follows the tokenizer file (normaliser NFC, white space, lower case; words by pattern; byte-level parts with a
word-end suffix); words are cached in a table of bounded size.

Nulls and empty texts have no ids. Extra columns are left alone: the operators read doc_id and text only. Repeated rows give
repeated results. An empty table gives an empty result. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fernweave.llm.common import text_of

#: What \s means in the tokenizer's patterns.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = re.compile(f"[{SPACE}]+")
CACHED = 400_000
LONG = 200
NONE = 1 << 30
PAD = (1 << 20) - 1
#: A multiplier that spreads keys over the table's slots.
MIX = np.int64(-7046029254386353131)
#: Letters and signs on which all versions of Unicode agree.
PLAIN = re.compile("[\\x00-\u024f\u2010-\u2027\u20ac]*").fullmatch


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Bpe(dict):
    """A cache from a word (or a special token's id) to the bytes of its ids, and the means to fill it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.digits = [str(i) for i in range(len(self.names))]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(self.vocab[a] << 20 | self.vocab[b], (rank, self.vocab[a + b]))
        self.rank = {k: r for k, (r, _) in self.merges.items()}
        self.made = {r: i for r, i in self.merges.values()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # words are lower case when they are cut: some capitals below U+0250 have their small letter above it
        seen = sorted({x for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC] for x in chr(c) + chr(c).lower()})
        kinds = {k: "".join(re.escape(x) for x in seen if unicodedata.category(x)[0] == k) for k in "LN"}
        self.plain_words = re.compile(pattern.replace("\\p{L}", kinds["L"]).replace("\\p{N}", kinds["N"]).replace("\\s", SPACE)).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda x: [x]
        chars = byte_chars()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.rules = Tokenizer.from_file(path)
        self.inner = [self.vocab.get(c, -1) for c in chars]
        self.final = [self.vocab.get(c + self.suffix, -1) for c in chars]
        if min(self.inner + self.final) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        self.inner_at, self.final_at = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        self.made_at = np.array([self.made.get(r, PAD) for r in range(max(self.made, default=0) + 1)], np.int64)
        keys = np.array([*self.rank], np.int64)
        self.slots, self.slot_ranks = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, np.int32)
        for key, at in zip(keys.tolist(), ((keys * MIX).view(np.uint64) >> np.uint64(46)).tolist()):
            while self.slots[at] >= 0:
                at = at + 1 & (1 << 18) - 1
            self.slots[at], self.slot_ranks[at] = key, self.rank[key]

    def merged(self, parts: list[int]) -> list[int]:
        """Merge adjacent parts, least rank first and leftmost among equals."""
        if len(parts) > LONG:
            return self.merged_long(parts)
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            parts[i] = new = made[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 20 | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | new, NONE)
        return parts

    def merged_long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank.get
        left, right, alive = [*range(-1, n - 1)], [*range(1, n + 1)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = self.made[r], False
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (q := rank(parts[i] << 20 | parts[k], NONE)) != NONE:
                    heapq.heappush(heap, (q, i, parts[i], parts[k]))
            if (h := left[i]) >= 0 and (q := rank(parts[h] << 20 | parts[i], NONE)) != NONE:
                heapq.heappush(heap, (q, h, parts[h], parts[i]))
        return [p for p, x in zip(parts, alive) if x]

    def split(self, text: str) -> list[int | str]:
        """Words of a text in order; special tokens as their ids."""
        if "<|" not in text and PLAIN(text):
            return self.plain_words(text.lower())
        out: list[int | str] = []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                out.append(self.special[part])
            elif PLAIN(part):
                out += self.plain_words(part.lower())
            else:
                # scripts whose classes differ between Unicode versions go by the tokenizer's own normaliser and splitter
                for raw in SPLIT.split(part):
                    if PLAIN(raw):
                        out += self.plain_words(raw.lower())
                    else:
                        plain = self.rules.normalizer.normalize_str(raw)
                        out += [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs (left << 20 | right) from an open-addressed table; NONE for pairs that never merge."""
        at = (keys * MIX).view(np.uint64) >> np.uint64(46)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.slots[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_ranks[at[hit]]
            more = (found >= 0) & ~hit
            todo, at = todo[more], (at[more] + np.uint64(1)) & np.uint64(len(self.slots) - 1)
        return out

    def batch(self, words: list[str]) -> None:
        """Encode many words at once into the cache: a row of parts and of adjacent ranks for each word."""
        raw = [w.encode() for w in words]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        start = 0
        while start < len(order):
            n = len(raw[order[start]])
            top = n if n < 6 else n + 2
            stop = start
            while stop < len(order) and len(raw[order[stop]]) <= top and stop - start < 20_000:
                stop += 1
            rows, start = order[start:stop], stop
            if n > 40 or len(rows) < 8:
                for i in rows:
                    b = raw[i]
                    self[words[i]] = np.array(self.merged([p for p in [self.inner[x] for x in b[:-1]] + [self.final[b[-1]]] if p >= 0]), "<u4").tobytes()
                continue
            width = len(raw[rows[-1]])
            sizes = np.array([len(raw[i]) for i in rows])
            grid = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
            parts = self.inner_at[grid]
            each = np.arange(len(rows))
            parts[each, sizes - 1] = self.final_at[grid[each, sizes - 1]]
            parts[np.arange(width)[None] >= sizes[:, None]] = PAD
            ranks = np.full((len(rows), width), NONE, np.int32)
            if width > 1:
                ranks[:, :-1] = self.lookup((parts[:, :-1] << 20 | parts[:, 1:]).ravel()).reshape(-1, width - 1)
            live, column = each, np.arange(width)
            while len(live):
                r = ranks[live]
                at = r.argmin(1)
                low = r[np.arange(len(live)), at]
                go = low != NONE
                live, at, low, r = live[go], at[go], low[go], r[go]
                if not len(live):
                    break
                shift = np.minimum(column[None] + (column[None] > at[:, None]), width - 1)
                p = np.take_along_axis(parts[live], shift, 1)
                p[:, -1] = PAD
                me = np.arange(len(live))
                p[me, at] = self.made_at[low]
                r = np.take_along_axis(r, np.minimum(column[None] + (column[None] >= at[:, None]), width - 1), 1)
                r[:, -1] = NONE
                after = np.minimum(at + 1, width - 1)
                r[me, at] = self.lookup(p[me, at] << 20 | np.where(at + 1 < width, p[me, after], PAD))
                before = np.flatnonzero(at > 0)
                r[before, at[before] - 1] = self.lookup(p[before, at[before] - 1] << 20 | p[before, at[before]])
                parts[live], ranks[live] = p, r
            counts = (parts != PAD).sum(1)
            flat = parts.astype("<u4")
            for k, i in enumerate(rows):
                self[words[i]] = flat[k, : counts[k]].tobytes()

    def many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; texts are taken some megabytes at a time."""
        start = 0
        while start < len(texts):
            stop, held = start, 0
            while stop < len(texts) and held < 4_000_000:
                held += len(texts[stop])
                stop += 1
            words = [self.split(t) for t in texts[start:stop]]
            new = set().union(*words).difference(self)
            if len(self) + len(new) > CACHED:
                self.clear()
                new = set().union(*words)
            self.batch([w for w in new if isinstance(w, str)])
            self.update((i, np.array([i], "<u4").tobytes()) for i in new if not isinstance(i, str))
            for ws in words:
                yield np.frombuffer(b"".join(map(self.__getitem__, ws)), "<u4")
            start = stop

    def ids(self, text: str) -> np.ndarray:
        return next(self.many([text]))

    def decoded(self, ids: list[int]) -> str:
        """As the tokenizer file has no decoder, tokens stand apart by one space."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def digest(df: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, hashes, decoded = [], [], []
            for each in bpe.many(batch.column(1).to_pylist()):
                ids = each.tolist()
                n.append(len(ids))
                hashes.append(hashlib.sha256(" ".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decoded(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", text_of(df).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, path: str) -> DataFrame:
    """The documents' ids themselves: doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids.astype("i4") for ids in bpe.many(batch.column(1).to_pylist())], pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", text_of(df).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """Texts of encode()'s ids: doc_id, text. Null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decoded(t.as_py() or []) for t in batch.column(1)], pa.string())], ["doc_id", "text"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.col("ids")).mapInArrow(run, f"doc_id {kind}, text string")
