"""License scans with a positional index of rare template words.

Templates are licence texts (well-known passages) and the base phrases. A first pass counts in how many documents each
template word occurs, over all documents. The index posts, for every template, its ``ANCHORS`` words of highest inverse
document frequency with their positions. A file looks up every occurrence of indexed words, rarest first in effect: each
(occurrence, posting) pair votes for a relative position (file minus template). Alignments with votes are verified over the
relative positions up to ``BAND`` words away: the share of template words found in order must reach ``COVERAGE`` and all
mandatory key phrases must stand in the passage, so inserted or dropped words do not lose a licence. Verified alignments of
a template that overlap are one passage. Base phrases must match in every word; all their places count, without a cap, as each place holds the phrase's anchor.

Null or empty text: no words, no labels, score 0. Repeated documents: a row each. Empty table: no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import Words, alnum_words, ragged, text_slices

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Passages of public licences as (label, passage, mandatory key phrases).
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
     "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
     "software", ["without restriction", "to use copy modify merge publish"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 "
     "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
     ["source and binary forms", "must retain the above copyright notice"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
     "copyright notice and this permission notice appear in all copies", ["with or without fee", "appear in all copies"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license "
     "2 0", ["in compliance with the license", "apache org licenses"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation", ["redistribute it and or modify it", "free software foundation"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
     "by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
     "can obtain one at", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
     "distribute this software", ["unencumbered software", "public domain"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
     "from the use of this software", ["provided as is", "held liable for any damages arising from the use"]),
    ("boost", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt", ["boost software license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
]

ANCHORS = 8
COVERAGE = 0.8
#: words inserted or dropped before or behind a voting word
BAND = 8


class Templates:
    """Templates over numbered words (from 1) and the index of their rarest words."""

    def __init__(self):
        texts = [*BASE, *(p for _, p, _ in PASSAGES)]
        self.labels = [*BASE.values(), *(x for x, _, _ in PASSAGES)]
        w = alnum_words(pa.array(texts))
        self.words = w.values.cast(pa.large_string())
        self.codes = [w.ids[a:b] + 1 for a, b in zip(w.offsets, w.offsets[1:])]
        self.base = len(BASE)
        place = {v: i + 1 for i, v in enumerate(self.words.to_pylist())}
        self.keys = [[]] * self.base + [[np.array([place[x] for x in k.split()]) for k in keys] for _, _, keys in PASSAGES]
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def rank(self, df: np.ndarray, documents: int) -> None:
        """Build the index from document frequencies (by word number)."""
        idf = np.log((documents + 1) / (df + 1))
        posts: dict[int, list[tuple[int, int]]] = {}
        for t, codes in enumerate(self.codes):
            distinct = sorted(set(codes.tolist()), key=lambda c: (-idf[c], c))
            for c in distinct[: 1 if t < self.base else ANCHORS]:
                for at in np.flatnonzero(codes == c).tolist():
                    posts.setdefault(c, []).append((t, at))
        top = len(self.words) + 1
        size = np.array([len(posts.get(c, [])) for c in range(top)])
        flat = [p for c in range(top) for p in posts.get(c, [])]
        self.post_count, self.post_start = size, np.cumsum(size) - size
        self.post_template, self.post_at = (np.array([p[k] for p in flat], dtype=np.int64) for k in (0, 1))


def _symbols(w: Words, t: Templates) -> np.ndarray:
    code = pc.fill_null(pc.index_in(w.values, t.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return code[w.ids]


def document_frequencies(documents: DataFrame, t: Templates) -> tuple[np.ndarray, int]:
    """Documents that hold each template word, and the number of documents, over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(t.words) + 1, dtype=np.int64), 0
        for b in text_slices(batches, "text"):
            w = alnum_words(b.column("text"))
            symbols = _symbols(w, t)
            at = np.flatnonzero(symbols)
            doc = np.searchsorted(w.offsets, at, side="right") - 1
            df += np.bincount(np.unique(doc * len(df) + symbols[at]) % len(df), minlength=len(df))
            n += b.num_rows
        df[0] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], ["word", "n"])

    rows = documents.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(t.words) + 1, dtype=np.int64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out, int(out[0])


def _alignments(symbols: np.ndarray, offsets: np.ndarray, t: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, template, start): every relative position an indexed word votes for (may start before the text)."""
    at = np.flatnonzero(t.post_count[symbols])
    n = t.post_count[symbols[at]]
    post = ragged(t.post_start[symbols[at]], n)
    at = np.repeat(at, n)
    doc = np.searchsorted(offsets, at, side="right") - 1
    found = np.unique(np.stack([doc, t.post_template[post], at - t.post_at[post]]), axis=1)
    return found[0], found[1], found[2]


def _free(taken: list[tuple[int, int]], first: int, last: int) -> bool:
    """Whether words first to last are free; if so they are taken now. ``taken`` is sorted and without overlaps."""
    k = bisect.bisect(taken, (first, last))
    if k and taken[k - 1][1] >= first or k < len(taken) and taken[k][0] <= last:
        return False
    taken.insert(k, (first, last))
    return True


def _in_order(seen: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of ``codes`` found in order, place of the first, place of the last) per row of ``seen``, which has the words
    from BAND before an alignment to BAND behind it; word i of the template is looked for at the places i to i + 2 * BAND."""
    rows, width = len(seen), 2 * BAND + 1
    count, first, last = (np.full((rows, width + 1), x, dtype=np.int32) for x in (0, -1, -1))  # the last column has nothing
    for i, c in enumerate(codes):
        hit = seen[:, i : i + width] == c
        left = [np.zeros(rows, dtype=np.int32), np.full(rows, -1, dtype=np.int32), np.full(rows, -1, dtype=np.int32)]  # the place before, same word
        for d in range(width):
            # up to this place without this word: the column d + 1 of the word before; with it: column d of the word before
            old = [count[:, d].copy(), first[:, d].copy(), last[:, d].copy()]
            best = [count[:, d + 1], first[:, d + 1], last[:, d + 1]]
            more = left[0] > best[0]
            best = [np.where(more, x, y) for x, y in zip(left, best)]
            with_it = [old[0] + 1, np.where(old[0] > 0, old[1], i + d), np.full(rows, i + d, dtype=np.int32)]
            more = hit[:, d] & (with_it[0] > best[0])
            left = [np.where(more, x, y) for x, y in zip(with_it, best)]
            count[:, d], first[:, d], last[:, d] = left
        count[:, width], first[:, width], last[:, width] = left
    return count[:, width], first[:, width], last[:, width]


def scan_texts(texts: pa.Array, t: Templates) -> dict[str, list]:
    w = alnum_words(texts)
    symbols = _symbols(w, t)
    n = len(texts)
    n_base, first, last = [0] * n, [None] * n, [None] * n
    base: list[set] = [set() for _ in range(n)]
    labels: list[set] = [set() for _ in range(n)]
    score = np.zeros(n)
    spans: list[list[dict]] = [[] for _ in range(n)]
    doc, template, start = _alignments(symbols, w.offsets, t)
    for k, codes in enumerate(t.codes):
        here = template == k
        d, s = doc[here], start[here]
        if not len(d):
            continue
        margin = 0 if k < t.base else BAND
        place = s[:, None] + np.arange(-margin, len(codes) + margin)
        inside = (place >= w.offsets[d][:, None]) & (place < w.offsets[d + 1][:, None])
        seen = np.where(inside, symbols[np.clip(place, 0, max(len(symbols) - 1, 0))], 0)
        share = (seen[:, margin : margin + len(codes)] == codes).mean(axis=1)
        first_at, last_at = s - w.offsets[d], s - w.offsets[d] + len(codes) - 1
        if margin:
            near = np.zeros((len(d), len(codes)), dtype=bool)
            for x in range(2 * margin + 1):
                near |= seen[:, x : x + len(codes)] == codes
            near = np.flatnonzero(near.mean(axis=1) >= COVERAGE)  # no other can reach it in order
            if len(near):
                count, one, two = _in_order(seen[near], codes)
                share[near] = count / len(codes)
                last_at[near] = first_at[near] - margin + two
                first_at[near] += one - margin
        good = share >= (1.0 if k < t.base else COVERAGE)
        for key in t.keys[k]:
            hit = np.zeros(len(d), dtype=bool)
            for a in range(seen.shape[1] - len(key) + 1):
                hit |= (seen[:, a : a + len(key)] == key).all(axis=1)
            good &= hit
        np.maximum.at(score, d, np.where(good, share, share * 0.5))
        at = np.flatnonzero(good)
        if margin:  # several words vote for a passage: of those that overlap, the one with most words
            at = at[np.lexsort((first_at[at], -share[at], d[at]))]
            taken: dict[int, list[tuple[int, int]]] = {}
            at = [x for x in at.tolist() if _free(taken.setdefault(int(d[x]), []), int(first_at[x]), int(last_at[x]))]
        for i, a, z in zip(d[at].tolist(), first_at[at].tolist(), last_at[at].tolist()):
            labels[i].add(t.labels[k])
            spans[i].append({"label": t.labels[k], "first": a, "last": z})
            if k < t.base:
                base[i].add(t.labels[k])
                n_base[i] += 1
                first[i] = a if first[i] is None else min(first[i], a)
                last[i] = a if last[i] is None else max(last[i], a)
    return {
        "n_words": w.counts.tolist(), "n_base": n_base, "first_word": first, "last_word": last,
        "base_labels": [",".join(sorted(x)) for x in base], "labels": [",".join(sorted(x)) for x in labels], "score": score.tolist(),
        "spans": [sorted(x, key=lambda y: (y["first"], y["last"], y["label"])) for x in spans],
    }


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))),
])


def scan(documents: DataFrame) -> DataFrame:
    """Licence findings of every row of ``documents``, with the spans (words from 0) of all verified passages."""
    t = Templates()
    t.rank(*document_frequencies(documents, t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            found = scan_texts(b.column("text"), t)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(found[f.name], f.type) for f in list(RESULT)[1:])], schema=RESULT)

    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long>>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
