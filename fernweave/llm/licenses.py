"""License scans by a positional index of rare words.

Every template (a licence's wording, with key phrases that must be there) is entered in the index at its highest-IDF words;
IDF is counted over all documents for the words of the templates. A file's words are looked up: each index word found in the
file proposes a template at a start, postings are intersected by relative position, and a start that enough of the template's
index words agree on is verified: all key phrases must stand at their places (a few words' shift allowed), and the share of
the template's words that stand at theirs is the match. The short base phrases are templates that are their own key phrase,
entered at their rarest word, so each of their places is found.

Null and empty texts have no words and no labels. Repeated rows get equal results. An empty table gives an empty result; extra
columns are left alone; files are read whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import text_of

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, wording, key phrases of it. Public licences' own notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["licensed under the apache license version 2", "in compliance with the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify and or distribute this software", "is hereby granted"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["under the terms of the gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["under the terms of the gnu lesser general public license"]),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["under the terms of the gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["subject to the terms of the mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution", ["licensed under a creative commons attribution"]),
    ("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial", ["creative commons attribution noncommercial"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
]
#: Index words of a template, those that must agree on a start, the words' shift allowed, the share of words that must match.
RARE, AGREE, SHIFT, SHARE = 4, 2, 2, 0.8

#: Lower-case A-Z; everything of ASCII that is no letter or digit parts words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Template:
    def __init__(self, label: str, text: str, keys: list[str], base: bool):
        self.label, self.words, self.base = label, words_of(text.encode()), base
        self.keys = [(self.words_at(k := words_of(key.encode())), k) for key in keys]

    def words_at(self, phrase: list[bytes]) -> int:
        return next(i for i in range(len(self.words)) if self.words[i : i + len(phrase)] == phrase)

    def verify(self, words: list[bytes], start: int) -> float:
        """The share of words in place, 0 unless all key phrases are there."""
        for at, phrase in self.keys:
            if not any(start + at + s >= 0 and words[start + at + s : start + at + s + len(phrase)] == phrase for s in ((0,) if self.base else range(-SHIFT, SHIFT + 1))):
                return 0.0
        if self.base:
            return 1.0
        n = 0
        for i, w in enumerate(self.words):
            n += w in words[max(0, start + i - SHIFT) : max(0, start + i + SHIFT + 1)]
        return n / len(self.words)


def all_templates() -> list[Template]:
    return [Template(label, text, [text], True) for text, label in BASE.items()] + [Template(*t, False) for t in TEMPLATES]


def document_counts(df: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the templates stands, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in batch.column(0):
                n += 1
                for w in vocabulary.intersection(words_of(text.as_py())):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*seen, b""], pa.binary()), pa.array([*seen.values(), n], pa.int64())], ["word", "n"])

    rows = df.select(text_of(df).cast("binary").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {bytes(r["word"]): r["n"] for r in rows}  # the templates' vocabulary, whatever the input's size
    return got, got.pop(b"", 0)


def index_of(templates: list[Template], idf: dict[bytes, float]) -> dict[bytes, list[tuple[int, int]]]:
    """Postings (template, place) of each template's highest-IDF words."""
    index: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for t, template in enumerate(templates):
        ranked = sorted(set(template.words), key=lambda w: (-idf.get(w, 0.0), w))[: 1 if template.base else RARE]
        for place, w in enumerate(template.words):
            if w in ranked and (not template.base or template.words.index(w) == place):
                index[w].append((t, place))
    return dict(index)


def scan_words(words: list[bytes], templates: list[Template], index: dict[bytes, list[tuple[int, int]]]) -> list[tuple[int, int, float]]:
    """(template, start, match) of every verified place."""
    votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
    found = []
    for i in [i for i, w in enumerate(words) if w in index]:
        for t, place in index[words[i]]:
            start = i - place
            if templates[t].base:
                if start >= 0 and words[start : start + len(templates[t].words)] == templates[t].words:
                    found.append((t, start, 1.0))
            else:
                for s in range(-SHIFT, SHIFT + 1):
                    votes[t, start + s].add(words[i])
    best: dict[int, tuple[int, float]] = {}
    for (t, start), who in sorted(votes.items()):
        if len(who) >= AGREE:
            share = templates[t].verify(words, start)
            if share >= SHARE and share > best.get(t, (0, 0.0))[1]:
                best[t] = (start, share)
    return found + [(t, start, share) for t, (start, share) in best.items()]


def scan(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places of every document."""
    templates = all_templates()
    counts, total = document_counts(df, {w for t in templates for w in t.words})
    index = index_of(templates, {w: math.log((total + 1) / (n + 1)) for w, n in counts.items()})
    kind = df.schema["doc_id"].dataType.simpleString()
    place = pa.struct([("label", pa.string()), ("word", pa.int64()), ("match", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = scan_words(words, templates, index)
                base = [(templates[t].label, start) for t, start, _ in found if templates[t].base]
                row = (
                    len(words), len(base), min((s for _, s in base), default=None), max((s for _, s in base), default=None), ",".join(sorted({x for x, _ in base})),
                    ",".join(sorted({templates[t].label for t, _, _ in found})), max((m for _, _, m in found), default=0.0),
                    [{"label": templates[t].label, "word": s, "match": m} for t, s, m in sorted(found, key=lambda x: x[1])],
                )
                for o, v in zip(out, row):
                    o.append(v)
            kinds = [*(pa.int64(),) * 4, pa.string(), pa.string(), pa.float64(), pa.list_(place)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, k) for o, k in zip(out, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,word:long,match:double>>"
    return df.select("doc_id", text_of(df).cast("binary").alias("text")).mapInArrow(run, schema)
