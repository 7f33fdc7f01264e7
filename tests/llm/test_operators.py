"""The operators against brute force, and their edge cases: nulls, empty and long texts, repeats, empty tables, clashing names."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fernweave.llm import bpe, embedding_dedup, hamming, html, licenses, line_dedup, lm, minhash, packing, quality
from fernweave.llm.common import components

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Edge cases: nulls, blanks, long texts, a row twice, columns whose names are those of ours."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t\n ", "en", "s", 5), (4, long, "en", "s", len(long)), (5, line + "\nshort\n" + line, "en", "s", 1), (5, line + "\nshort\n" + line, "en", "s", 1), (6, line.replace("seven", "7"), "en", "s", 1), (None, "no id here at all", "en", "s", 1), (7, "Ünïcode 日本 <|endoftext|> \x00 " + "a" * 3000, "xx", "s", 1), (8, long, "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("node", "keys", "a", "b", "rep", "h", "g", "l", "row", "score", "predicted", "__doc", "__hash", "__text", "__gone", "word", "length", "held_out", "component"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# components


def test_components(spark):
    r = np.random.default_rng(4)
    e = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    linked = {x for a, b in e if a != b for x in (a, b)}
    assert got == {x: min(y for y in linked if find(y) == find(x)) for x in linked}


# BPE and packing


def test_bpe_like_the_library(docs, odd):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    b = bpe.Bpe(PATH)
    texts = [r.text or "" for r in docs.collect() + odd.select("text").collect()] + ["it's I'M <|ENDOFTEXT|> ΣΑΣ \x1c\x1d İß ½²³ ١٢", "ab" * 400, "<|startoftext|><|endoftext|><|", "é a b　c"]
    for text, ids in zip(texts, b.many(texts)):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert b.decoded(want) == t.decode(want, skip_special_tokens=False)


def test_bpe_every_code_point():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    b = bpe.Bpe(PATH)
    texts = [f"a{c}b {c} {c}b a{c}" for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000]
    odd = [x for x, ids, want in zip(texts, b.many(texts), t.encode_batch(texts, add_special_tokens=False)) if ids.tolist() != want.ids]
    assert not odd


def test_long_words_merge_in_the_same_order():
    b = bpe.Bpe(PATH)
    r = np.random.default_rng(1)
    for _ in range(20):
        parts = [b.inner[c] for c in r.choice([*b"aeintrs"], 300)]
        short, bpe.LONG = bpe.LONG, 10**9
        want = b.merged(parts.copy())
        bpe.LONG = short
        assert b.merged_long(parts.copy()) == want


def test_bpe_tables(spark, odd):
    out = bpe.digest(odd, PATH).collect()
    assert len(out) == 10 and {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {0}
    back = bpe.decode(bpe.encode(odd.where("doc_id = 5"), PATH), PATH).collect()
    assert len({r.text for r in back}) == 1 and back[0].text.startswith("one</w> two</w>")
    assert bpe.digest(empty(spark), PATH).count() == 0


def check_packing(rows, texts):
    t = bpe.Bpe(PATH)
    seqs = {}
    pieces = Counter()
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[(r.doc_id, r.length, r.start, r.ids_crc32)] += 1
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= packing.CAP
    want = Counter()
    for doc_id, text in texts:
        ids = np.append(t.ids(text or ""), 0).astype("<u4")
        for k in range(0, len(ids), packing.CAP):
            p = ids[k : k + packing.CAP]
            want[(doc_id, len(p), k, zlib.crc32(p.tobytes()))] += 1
    assert pieces == want
    total = sum(k[1] * v for k, v in want.items())
    return len(seqs), -(-total // packing.CAP)


def test_packing(spark, docs, odd):
    for df in (docs, odd):
        n, low = check_packing(packing.pack(df, PATH).collect(), [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        assert n <= low * 1.03 + 2
    assert packing.pack(empty(spark), PATH).count() == 0


def test_plan_is_no_worse_than_best_fit_decreasing():
    r = np.random.default_rng(2)
    for _ in range(3):
        h = np.bincount(np.minimum(1 + r.gamma(1.2, 500, 4000).astype(int), 2048), minlength=2049)
        used = np.zeros(2049, int)
        n = 0
        for lengths, many in packing.plan(h):
            n += many
            assert sum(lengths) <= 2048
            for x in lengths:
                used[x] += many
        assert (used == h).all()
        bins = np.zeros(2049, int)
        best = 0
        for x in range(2048, 0, -1):
            for _ in range(h[x]):
                room = np.flatnonzero(bins[x:])
                if len(room):
                    bins[x + room[0]] -= 1
                    bins[room[0]] += 1
                else:
                    best += 1
                    bins[2048 - x] += 1
        assert n <= best + 2


def test_patterns_carry_most_pieces():
    """Of a thousand documents' lengths most go by patterns, and the sequences are as few as the ids allow, or one more."""
    r = np.random.default_rng(4)
    h = np.bincount(np.minimum(1 + r.lognormal(6, 1, 1000).astype(int), 2048), minlength=2049)
    left = h.copy()
    left[2048] = 0
    lengths = np.flatnonzero(left)
    rows = packing.patterns(lengths, 2048)
    assert rows.sum(1).max() <= 2048
    rest = left.copy()
    made = packing.by_patterns(rest, rows, packing.nnls(rows, left.astype(float)))
    assert sum(len(k) * n for k, n in made) >= 0.5 * left.sum() and (rest >= 0).all()
    assert sum(n for _, n in packing.plan(h)) <= -(-int((h * np.arange(2049)).sum()) // 2048) + 1


# line dedup


def lines_by_force(rows):
    seen, order = {}, []
    split = lambda x: tuple(w for w in re.split(r"[\t\x0b\x0c\r ]+", x) if w)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for _, t in rows:
        for x in (t or "").split("\n"):
            if (w := split(x)) and w not in seen:
                seen[w] = len(order)
                order.append(w)
    near = set()
    for i, x in enumerate(order):
        for y in order[:i]:
            if min(len(x), len(y)) >= line_dedup.MIN_WORDS and abs(len(x) - len(y)) <= 1 and (x[:2] == y[:2] or x[-2:] == y[-2:]):
                p = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
                s = next((k for k, (a, b) in enumerate(zip(x[::-1], y[::-1])) if a != b), min(len(x), len(y)))
                if p + s >= max(len(x), len(y)) - 1:
                    near.add(x)
    done, out = set(), {}
    for i, t in rows:
        if i in out:
            continue
        keep = []
        for x in (t or "").split("\n"):
            w = split(x)
            if not w or w not in done and w not in near:
                keep.append(x)
            done.add(w)
        out[i] = None if t is None else "\n".join(keep)
    return out


def test_line_dedup(spark, docs, odd):
    for df in (docs, odd):
        got = line_dedup.dedup_lines(df)
        assert got.columns == [*df.columns, "__dropped_lines"]
        want = lines_by_force([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        rows = got.collect()
        assert len(rows) == df.count()
        assert all(r.text == want[r.doc_id] for r in rows)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_one_edit_of_a_word(spark):
    base = [f"w{i}" for i in range(14)]
    edits = {"put in": base[:5] + ["new"] + base[5:], "taken out": base[:3] + base[4:], "first": ["x"] + base[1:], "last": base[:-1] + ["x"], "two": base[:1] + ["q"] + base[2:9] + ["r"] + base[10:], "moved": base[1:] + base[:1], "few": base[:4]}
    rows = [(0, " ".join(base))] + [(i + 1, " ".join(w)) for i, w in enumerate(edits.values())] + [(20, " ".join(base[:3] + ["z"]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {list(edits)[i - 1] for i, t in got.items() if t == "" and i}
    assert gone == {"put in", "taken out", "first", "last"}


def test_short_lines(spark):
    """All edits of lines of four to seven words, against brute force."""
    r = np.random.default_rng(7)
    lines = []
    for n in (4, 5, 6, 7):
        for i in range(12):
            w = [f"s{n}x{i}y{k}" for k in range(n)]
            at = int(r.integers(0, n))
            lines += [w, w[:at] + ["z"] + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + ["q"] + w[at:]]
    r.shuffle(lines := [" ".join(w) for w in lines])
    rows = [(i, "\n".join(lines[i::20])) for i in range(20)]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == lines_by_force(rows) and sum(len(t.split("\n")) for t in got.values()) < len(lines)


def test_words_put_in_at_different_places(spark):
    """Lines of one deletion key that are two edits apart from the earliest: each has its own earlier partner."""
    base = [f"w{i}" for i in range(12)]
    put = lambda k, x: " ".join(base[:k] + [x] + base[k:])
    cases = [
        [put(3, "x"), " ".join(base), put(9, "y"), put(9, "z")],  # the whole line after one variant, before two
        [put(3, "x"), put(9, "y"), put(9, "z"), put(6, "u"), put(6, "v")],  # no whole line
        [put(3, "x"), put(9, "y"), " ".join(base)],
    ]
    rows = [(100 * c + i, " ".join(f"{x}c{c}" for x in t.split())) for c, lines in enumerate(cases) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == lines_by_force(rows)
    assert {i for i, t in got.items() if t == ""} == {1, 2, 3, 102, 104, 202}


# near duplicates


def test_minhash(spark, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    h = {i: minhash.shingles(t) for i, t in texts.items()}
    ids = sorted(texts)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(np.intersect1d(h[a], h[b])) >= 0.75 * max(len(h[a]), len(h[b]), 1) and minhash.similar(h[a], h[b])]
    out = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert pairs and all(out[a].component_id == out[b].component_id for a, b in pairs)
    linked = {i for p in pairs for i in p}
    assert all(out[i].kept for i in ids if i not in linked)
    assert minhash.dedup(docs).count() == len({r.component_id for r in out.values()})


def test_minhash_edges(spark, odd):
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    of = {r.doc_id: r.component_id for r in out}
    assert of[1] == of[2] == of[3] == 1 and of[4] == of[8] == 4 and len([r for r in out if r.doc_id == 5]) == 2
    kept = minhash.dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 1, 4, 5, 6, 7]
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_minhash_group_of_near_copies(spark):
    """Many copies with edits of their own, and texts that only share a passage."""
    r = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = base.copy()
        for k in r.choice(120, 2, replace=False):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    for i in range(150, 250):
        rows.append((i, " ".join(base[:50] + [f"o{i}x{k}" for k in range(100)])))
    out = {x.doc_id: x for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {out[i].component_id for i in range(150)} == {0}
    assert all(out[i].kept for i in range(150, 250))


def edits_by_force(x, y):
    """Edit distance of the texts' five-word shingles, without the operator's own functions."""
    a, b = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (x.split(), y.split()))
    p = list(range(len(b) + 1))
    for i, s in enumerate(a, 1):
        c = [i]
        for j, t in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (s != t)))
        p = c
    return p[-1], max(len(a), len(b))


def test_minhash_links_every_near_pair_of_a_bucket(spark):
    """Short pairs at the very bound, which may have few equal sketches."""
    texts = []
    for i in range(600):
        w = [f"p{i}w{k}" for k in range(9)]
        texts += [" ".join(w), " ".join([*w[:8], "z"])]
    assert edits_by_force(*texts[:2]) == (1, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {x.node: x["keys"] for x in minhash.sketched(df).collect()}
    out = {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()}
    met = [i for i in range(0, len(texts), 2) if any(a == b for a, b in zip(keys[i], keys[i + 1]))]
    assert len(met) > 500 and all(out[i] == out[i + 1] for i in met)


def test_minhash_aligns_shingles_without_labels(spark):
    """A line that stands between other text, left out once at the front of the copy."""
    line = [f"l{k}" for k in range(12)]
    own = [[f"o{i}x{k}" for k in range(8)] for i in range(30)]
    whole = " ".join(x for o in own for x in o + line)
    copy = " ".join(x for i, o in enumerate(own) for x in (o + line if i else o))
    d, n = edits_by_force(whole, copy)
    assert 1 - d / n > 0.95
    other = " ".join(f"q{k}" for k in range(300))
    out = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame([(0, whole), (1, copy), (2, other)], "doc_id long, text string")).collect()}
    assert out == {0: 0, 1: 0, 2: 2}


def near_family(n, seed=3, edits=3):
    r = np.random.default_rng(seed)
    texts = []
    for i in range(n):
        w = [f"b{k}" for k in range(40)]
        for k in r.choice(40, int(r.integers(0, edits)), replace=False):
            w[k] = f"e{i}x{k}"
        texts.append(" ".join(w))
    return texts, {(i, j) for i in range(n) for j in range(i + 1, n) for d, m in [edits_by_force(texts[i], texts[j])] if d <= int(0.2 * m + 1e-9)}


def groups_of(n, pairs):
    g = list(range(n))
    for i, j in pairs:
        g = [min(g[i], g[j]) if x in (g[i], g[j]) else x for x in g]
    return g


def test_last_round_links_what_alignment_links():
    """A bucket in one call and in four, against brute force over all its pairs."""
    n = 40
    texts, near = near_family(n)
    keys = np.zeros((n, minhash.BANDS), np.int64)
    keys[:, :3] = np.arange(n)[:, None]
    ids = np.arange(n)
    for blocks, probes in ((1, 1), (2, 2)):
        got = []
        for i in range(blocks):
            for j in range(probes):
                table = {"b": ids, "g": ids, "other": ids > 0, "target": ids % blocks == i, "probe": (ids > 0) & (ids // 3 % probes == j), "n": np.array([len(t.split()) - 4 for t in texts]), "keys": keys}
                got += minhash.joined(3, 1, table, [t.encode() for t in texts])
        assert near and len(set(groups_of(n, near))) > 1 and groups_of(n, got) == groups_of(n, near)
        assert {(min(p), max(p)) for p in got} <= near


@pytest.mark.parametrize("block", [20, 4])
def test_minhash_parts_large_buckets(spark, monkeypatch, block):
    """Buckets of more others than a block: parted by further bands, and what these do not part in pairs of blocks."""
    monkeypatch.setattr(minhash, "BLOCK", (block, 1 << 20))
    texts, near = near_family(120, 5, 9)
    out = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = groups_of(120, near)
    assert len(set(want)) > 10 and max(want.count(x) for x in want) > 20
    together = sum(out[i] == out[j] for i, j in near)
    assert together >= 0.97 * len(near)
    assert all(want[i] == want[out[i]] for i in range(120))  # no group that alignment does not give


def one_bucket(monkeypatch, bucket):
    """Texts share at most the first band, and that as bucket(doc_id) says."""
    sketched = minhash.sketched
    own = lambda k, i: F.when(i == 0, bucket(F.col("node"))).otherwise(F.xxhash64("node", i))
    monkeypatch.setattr(minhash, "sketched", lambda df: sketched(df).withColumn("keys", F.transform("keys", own)))


def slots(n):
    """Texts of one form: ten places of five words each, filled with one of three words; the last ones are alike but for a word."""
    chosen = np.random.default_rng(2).integers(0, 3, (n - 10, 10)).tolist()
    texts = [" ".join(x for k, c in enumerate(of) for x in (f"f{k}", f"g{k}", f"h{k}", f"i{k}", f"v{k}x{c}")) for of in chosen]
    texts += [f"{texts[-1]} e{i}" for i in range(10)]
    return texts, {(i, j) for i in range(n) for j in range(i + 1, n) for d, m in [edits_by_force(texts[i], texts[j])] if d <= int(0.2 * m + 1e-9)}


@pytest.mark.parametrize("block", [512, 20, 4])
@pytest.mark.parametrize("made", ["family", "slots"])
def test_minhash_result_does_not_depend_on_the_size_of_a_bucket(spark, monkeypatch, made, block):
    """Texts that share one band only: the groups of alignment, whether the bucket is one block or many."""
    monkeypatch.setattr(minhash, "BLOCK", (block, 1 << 20))
    one_bucket(monkeypatch, lambda node: F.lit(7).cast("long"))
    texts, near = near_family(120, 5, 9) if made == "family" else slots(70)
    out = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i] for i in range(len(texts))] == groups_of(len(texts), near)


def test_minhash_buckets_of_three(spark, monkeypatch):
    """Two of three texts that share one band are near, whichever are the pivots."""
    one_bucket(monkeypatch, lambda node: F.floor(node / 3))
    w = lambda c: [f"{c}{k}" for k in range(20)]
    texts = [" ".join(x) for i in range(60) for x in (w(f"a{i}x"), w(f"b{i}x"), [*w(f"b{i}x"), "z"])]
    out = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i] for i in range(180)] == [i - (i % 3 == 2) for i in range(180)]


def test_rarest_shingles_meet_at_the_bound():
    """Of any two texts at the bound one of the rarest shingles is shared, whatever the counters hold."""
    r = np.random.default_rng(6)
    texts, near = near_family(120, 5, 9)
    h = [minhash.shingles(t.encode()) for t in texts]
    for counts in (np.ones(minhash.COUNTERS, np.int64), r.integers(1, 50, minhash.COUNTERS)):
        rare = [set(minhash.rarest(x, counts).tolist()) for x in h]
        assert near and all(rare[i] & rare[j] for i, j in near)


def test_minhash_recall_at_the_bound(spark):
    """Isolated pairs with a fifth of their shingles replaced."""
    r = np.random.default_rng(8)
    rows = []
    for i in range(400):
        w = [f"t{i}w{k}" for k in range(104)]
        at = [10, 35, 60, 85]
        copy = w.copy()
        for k in at:
            copy[k] = f"x{i}y{k}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(copy))]
    assert edits_by_force(rows[0][1], rows[1][1]) == (20, 100)
    out = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(out[2 * i] == out[2 * i + 1] for i in range(400))
    assert found >= 0.98 * 400 and len({v for v in out.values()}) == 800 - found


def test_minhash_one_doc_id_for_two_texts(spark):
    words = lambda c: " ".join(f"{c}{k}" for k in range(30))
    rows = [(1, words("a")), (1, words("b")), (2, words("a")), (3, words("b") + " z"), (4, words("c")), (1, words("a"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = Counter((x.doc_id, x.component_id, x.kept) for x in minhash.near_duplicates(df).collect())
    assert out == Counter({(1, 1, True): 3, (2, 1, False): 1, (3, 1, False): 1, (4, 4, True): 1})
    assert sorted((x.doc_id, x.text[0]) for x in minhash.dedup(df).collect()) == [(1, "a"), (1, "b"), (4, "c")]



def test_banded_alignment():
    r = np.random.default_rng(5)

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
            p = c
        return p[-1]

    for _ in range(150):
        a = r.permutation(60)[: r.integers(1, 40)]
        b = [*a]
        for _ in range(r.integers(0, 12)):
            k = int(r.integers(0, len(b) + 1))
            b[k : k + int(r.integers(0, 2))] = [int(r.integers(100, 10**6))] * int(r.integers(0, 2))
        b = np.array([*dict.fromkeys(b)] or [7])
        d = distance(a, b)
        for most in (0, 2, 9):
            assert minhash.banded(a, b, most) == min(d, most + 1)
        assert minhash.similar(a, b) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))


# top-k


def test_top_k(spark):
    r = np.random.default_rng(6)
    codes = [int(x) for x in r.integers(-(2**62), 2**62, 400)]
    rows = [(i, c) for i, c in enumerate(codes)] + [(1000 + i, codes[0]) for i in range(30)] + [(2000, codes[5] ^ 3), (None, 5), (2001, None), (3, codes[3])]
    df = spark.createDataFrame(rows, "id long, code long").withColumn("q", F.lit("x"))
    asked = df.where("id % 100 = 0").select(F.col("id").alias("qid"), "code")
    got = {}
    for x in hamming.top_k(asked, df, 7).collect():
        got.setdefault(x.qid, []).append((x["rank"], x.distance, x.id))
    known = [(i, c) for i, c in set(rows) if i is not None and c is not None]
    for i, c in known:
        if i % 100 == 0:
            best = sorted(((c ^ d) & (2**64 - 1)).bit_count() * 10**6 + j for j, d in known)[:7]
            assert [(n + 1, *divmod(x, 10**6)) for n, x in enumerate(best)] == sorted(got[i])
    few = df.where("id < 3")
    assert hamming.top_k(asked.where("qid = 0"), few, 7).count() == 3
    assert hamming.top_k(asked.limit(0), df, 7).count() == 0


def test_sign_code(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, float("nan"), None, 2.0],), ([],), (None,)], "v array<double>")
    assert [r.c for r in df.select(hamming.sign_code(F.col("v")).alias("c")).collect()] == [33, 0, None]


# language model


def test_lm(spark, docs, odd):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        text = lambda r: lm.tokens((r.text or "").encode())
        c = Counter()
        for r in rows:
            if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
                c.update(text(r))
        n, v = sum(c.values()), len(c)
        want = sorted((str(r.doc_id), len(text(r)), sum(c[w] > 0 for w in text(r)), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in text(r)), 5)) for r in rows)
        out = lm.score(df).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in out) == want
        assert {r.train_tokens for r in out} == {n} and all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert lm.score(empty(spark)).count() == 0


def test_lm_beats_counts_on_held_out_texts(spark):
    out = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_lm_does_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 30_000)
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    one, many = ({r.doc_id: r.score for r in lm.score(df.repartition(n)).collect()} for n in (1, 9))
    assert all(abs(one[i] - many[i]) <= 1e-4 * abs(one[i]) for i in one)


def test_lm_like_a_plain_loop(spark):
    """One symbol at a time: context sum, all products, softmax."""
    r = np.random.default_rng(5)
    m = lm.Lbl(r.random(lm.SIZE) + 0.01)
    m.prepare()
    seq = np.concatenate([r.integers(0, lm.HEAD, 12), [lm.HEAD], r.integers(0, lm.SIZE, 6), [lm.HEAD]])
    want, before = [], (lm.START, lm.START)
    for w in seq.tolist():
        c = m.p["first"][before[0]] + m.p["second"][before[1]]
        z = [sum(float(x) * float(y) for x, y in zip(c, m.p["out"][s])) + float(m.p["bias"][s]) for s in range(lm.SIZE)]
        want.append((z[w] - math.log(sum(map(math.exp, z)))) / math.log(10))
        before = (lm.START, lm.START) if w == lm.HEAD else (w, before[0])
    assert np.allclose(m.log10(*lm.contexts(seq), seq), want, atol=1e-4)


def test_lm_is_normalised():
    m = lm.Lbl(np.ones(lm.SIZE))
    m.prepare()
    every = np.arange(lm.SIZE)
    for a, b in ((3, 9), (lm.START, lm.START)):
        p = 10 ** m.log10(np.full(lm.SIZE, a), np.full(lm.SIZE, b), every)
        assert abs(p.sum() - 1) < 1e-4


# pages


def test_html(spark):
    df = spark.read.parquet(f"{DATA}/pages.parquet").withColumn("token", F.lit("x")).withColumn("host", F.lit(1))
    got = {r.page_id: r for r in html.extract(df).collect()}
    import html as entities

    for r in df.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"<[^>]*>", re.sub(r"</?b>", "", article))
        want = " ".join(x for x in (" ".join(entities.unescape(p).split()) for p in parts) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_html_without_article(spark):
    page = lambda i, body: f"<html><body><div class='menu'><a href=/>Home {i}</a></div><div><span>Our site</span></div><div class=content><p>{body}</p><p>Second&nbsp;&amp; {i}<br>line {i}</div><div id='comments'>bad {i}</div><form><input>{i}</form><!-- c --><script>var x='<p>no</p>'</script><p>Our site</body></html>"
    rows = [(i, f"https://a.org/{i}", page(i, f"Text {i} < 5")) for i in range(6)] + [(10, None, None), (11, "nohost", ""), (12, "https://b.org/x", "plain text only"), (0, "https://a.org/0", page(0, "Text 0 < 5"))]
    got = [(r.page_id, r.text) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == sorted([(i, f"Text {i} < 5 Second & {i} line {i}") for i in [0, *range(6)]] + [(10, ""), (11, ""), (12, "plain text only")])
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template_of_different_pages_only(spark):
    """Copies of a page are no template, and what stands outside the main slot is none of it."""
    page = lambda body: f"<html><body><div><i>Site</i></div><p><b>Note:</b> {body}</p></body></html>"
    rows = [(i, "https://a.org/same", page("alone on its host")) for i in range(2)]
    rows += [(10 + i, f"https://b.org/{i}", page("copied")) for i in range(3)] + [(20 + i, f"https://b.org/x{i}", page(f"unique words {i}")) for i in range(2)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "Site Note: alone on its host", 1: "Site Note: alone on its host", 10: "Note: copied", 11: "Note: copied", 12: "Note: copied", 20: "Note: unique words 0", 21: "Note: unique words 1"}


def texts_by_page(spark, rows):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_finds_the_slot_without_article(spark):
    """The given pages with a nameless element in place of the article give the same texts."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = df.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", "<div class='c7'>"), "</article>", "</div>"))
    assert {r.page_id: r.text for r in html.extract(plain).collect()} == {r.page_id: r.text for r in html.extract(df).collect()}


def test_html_the_template_decides(spark):
    """Nothing here is named; the deduced template leaves out the sidebar and the notice that all articles have."""
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    page = lambda i: f"<html><body><div class=c1><p>About us {i}</p></div><div class=c7><p>Please log in to vote</p><h1>Title {i}</h1><p>{words(i)}</p><p class='share-price'>up {i}</p><p class='side-effects'>none {i}</p></div><div class=c8><i>More of this {i}</i></div></body></html>"
    pages = [(i, f"https://a.org/{i}", page(i)) for i in range(8)]
    pages.append((8, "https://a.org/8", page(8).replace("About us 8", "very long " * 3000)))
    want = {i: f"Title {i} {words(i)} up {i} none {i}" for i in range(9)}
    assert texts_by_page(spark, pages) == want  # one long page has no more weight than another
    bare = html.main_text(page(3), None, set(), set())
    assert bare != want[3] and "More of this 3" in bare and "Please log in" in bare
    assert texts_by_page(spark, [(i, u, h.replace("c7", "sidebar")) for i, u, h in pages[:8]])[3] == "More of this 3"


def test_html_near_copies_keep_their_text(spark):
    page = lambda i: f"<html><body><nav>n {i}</nav><article><h1>One text</h1><p>the same words in all of them</p><p>more words</p></article></body></html>"
    assert set(texts_by_page(spark, [(i, f"https://a.org/{i}", page(i)) for i in range(7)]).values()) == {"One text the same words in all of them more words"}


def test_html_nests_valid_classes():
    """An element outside the nested template is no slot, whatever its text."""
    t = lambda x, parent, chars, vector=7, pages=10, once=10, kind=2, hint=0: {"token": x, "parent": parent, "chars": chars, "vector": vector, "pages": pages, "once": once, "kind": kind, "hint": hint}
    tokens = [t(1, 0, 1000), t(2, 1, 990), t(3, 2, 900), t(4, 3, 890, vector=5, pages=9), t(5, 4, 880), t(6, 2, 0, kind=1), t(7, 3, 0, kind=1, vector=9, pages=6)]
    assert html.deduce(tokens, 10) == (3, [6], [6])
    tokens[2] = t(3, 2, 100)
    assert html.deduce(tokens, 10)[0] == 2
    tokens[2] = t(3, 2, 300, hint=1)
    assert html.deduce(tokens, 10)[0] == 3
    assert html.deduce([], 10) == (None, [], [])


# licences


def test_licenses(spark, docs, odd):
    for df in (docs, odd):
        for r in licenses.scan(df).join(df.select(F.col("doc_id"), "text").distinct(), "doc_id").collect():
            w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes((r.text or ""), "utf-8").translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
            found = [(i, x) for i in range(len(w)) for p, x in licenses.BASE.items() if w[i : i + len(p.split())] == p.encode().split()]
            assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(found), ",".join(sorted({x for _, x in found})))
            assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    notice = dict((t[0], t[1]) for t in licenses.TEMPLATES)
    rows = [(1, "x " + notice["bsd"].upper().replace(" ", "\n") + " y"), (2, notice["gpl"].replace("terms", "word")), (3, notice["mit"].replace("publish ", "")), (4, "cc by nc cc-BY_NC under the MIT license")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "bsd", 2: "", 3: "mit", 4: "cc-by-nc,mit"}
    assert licenses.scan(empty(spark)).count() == 0


# quality


def test_quality(spark, odd):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if out[r.doc_id].held_out}
    good = [out[i].score for i, q in truth.items() if q == 1]
    bad = [out[i].score for i, q in truth.items() if q == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.95
    assert np.mean([s >= 0.3 for s in bad]) <= 0.6 and all(r.predicted == (r.score >= 0.3) for r in out.values())
    some = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = quality.classify(odd, some).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 5}) == 1
    assert {r.score for r in quality.classify(odd, some.limit(0)).collect()} == {0.5}
    assert quality.classify(empty(spark), some).count() == 0


def test_quality_scores_like_a_slow_network():
    """One byte, filter and place at a time."""
    net = quality.Net(3)
    p = {k: v.astype(float) for k, v in net.p.items()}
    r = np.random.default_rng(6)
    texts = [b"", b"short text", bytes(r.integers(0, 256, 700, np.uint8))]
    for text, got in zip(texts, net.scores(texts)):
        z = []
        for start in range(0, max(1, len(text) - quality.CHUNK + quality.STEP), quality.STEP):
            chunk = text[start : start + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            most = [0.0] * quality.FILTERS
            for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                x = [v for byte in chunk[at : at + quality.WIDTH] for v in p["embed"][byte]]
                for f in range(quality.FILTERS):
                    most[f] = max(most[f], sum(a * b for a, b in zip(x, p["filters"][:, f])) + p["fbias"][f])
            hidden = [max(0.0, sum(m * w for m, w in zip(most, p["hidden"][:, h])) + p["hbias"][h]) for h in range(quality.HIDDEN)]
            z.append(sum(a * b for a, b in zip(hidden, p["out"])))
        assert abs(got - 1 / (1 + math.exp(-(sum(z) / len(z) + p["obias"][0])))) < 1e-4


def test_quality_gradients(monkeypatch):
    """Against differences of the loss, in one slice and in several."""
    r = np.random.default_rng(2)
    docs = [quality.chunked(bytes(r.integers(1, 256, n, np.uint8))) for n in (100, 900, 2000)]
    labels = np.array([1.0, 0.0, 1.0])
    for size in (4096, 5):
        monkeypatch.setattr(quality, "SLICE", size)
        net = quality.Net(5)
        net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
        for k, g in net.gradients(docs, labels).items():
            for at in r.integers(0, g.size, 6):
                old, seen = net.p[k].flat[at], []
                for d in (1e-5, -1e-5):
                    net.p[k].flat[at] = old + d
                    seen.append(net.loss(docs, labels))
                net.p[k].flat[at] = old
                assert abs((seen[0] - seen[1]) / 2e-5 - g.flat[at]) < 1e-4


def test_chunks_cover_the_text():
    for n in (0, 1, 256, 257, 448, 449, 5000):
        t = bytes((i * 7 + i // 256) % 255 + 1 for i in range(n))
        c = quality.chunked(t)
        back = c[0].tobytes() + b"".join(x[quality.CHUNK - quality.STEP :].tobytes() for x in c[1:])
        assert back.rstrip(b"\0") == t


# embeddings


def test_embeddings(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(60, 64))
    near = np.repeat(base[:20], 15, axis=0) + r.normal(size=(300, 64)) * 0.13
    x = np.concatenate([base, near, base[:5], base[:1]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [1.0] * 3), (None, x[0].tolist()), (904, [None] * 64), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit("x"))
    out = embedding_dedup.near_vectors(df).collect()
    assert len(out) == len(rows)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    u = np.concatenate([u, u[:1]])
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = {i: [r.n_links for r in out if r.vec_id == i] for i in range(len(x))}
    assert np.mean([got[i][0] == near[i].sum() for i in range(len(x))]) > 0.97
    assert all(got[i][0] <= near[i].sum() for i in range(len(x)))
    by = {r.vec_id: r for r in out}
    assert all(by[i].kept and by[i].n_links == 0 for i in (900, 901, 902, 903, 904)) and by[360].component_id == 0
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_embeddings_of_two_sizes(spark):
    r = np.random.default_rng(12)
    rows = []
    for size, n in ((64, 40), (16, 30), (3, 1)):
        base = r.normal(size=(n, size))
        for v in np.concatenate([base, base, base[:10] + 0.01 * r.normal(size=(n, size))[:10]]):
            rows.append((len(rows), v.tolist()))
    u = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    want = [sum(a != b and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.95 for b in range(len(u))) for a in range(len(u))]
    got = {x.vec_id: x.n_links for x in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert min(want) >= 1 and [got[i] for i in range(len(rows))] == want
