from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import licenses
from tests.llm.conftest import ODD, rows_of
from tests.llm.test_decontam import words

EXTRA = [
    "CC BY cc-by 4.0 cc by", "the Apache License, apache license apache LICENSE; " + licenses.PASSAGES[0][1], "gnu general public license " * 3,
    "x " + licenses.PASSAGES[4][1].upper(), licenses.PASSAGES[1][1].replace("binary", "bin"), "mit\nlicense MIT-License mit x license", "by cc by cc cc by",
]


def base_of(text):
    w, places, found = words(text), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                found.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


def ours(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_query_equals_brute_force(spark, sf):
    d = rows_of("documents")
    got = {r.doc_id: r for r in licenses.op5_licenses(spark, sf).collect()}
    assert {i: ours(r) for i, r in got.items()} == {i: base_of(t) for i, t in zip(d["doc_id"], d["text"])}
    for r in got.values():
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_odd_documents(spark, documents):
    texts = ODD + EXTRA
    rows = {r.doc_id: r for r in licenses.scan(documents(texts, extra=True)).collect()}
    assert [ours(rows[i]) for i in range(len(texts))] == [base_of(t) for t in texts]
    labels = [rows[len(ODD) + k]["labels"] for k in range(len(EXTRA))]
    assert labels == ["cc-by", "apache,mit", "gpl", "gpl", "", "mit", "cc-by"]  # the fifth lacks a mandatory phrase
    assert licenses.scan(documents(texts).limit(0)).count() == 0


@pytest.mark.parametrize("number", range(len(licenses.PASSAGES)))
def test_every_passage_is_found_with_gaps(number):
    label, passage, keys = licenses.PASSAGES[number]
    t = licenses.Templates()
    t.rank(np.zeros(len(t.words) + 1), 100)
    w = passage.split()
    kept = set(re.findall(r"\w+", " ".join(keys)))
    free = [k for k, x in enumerate(w) if x not in kept]
    assert label in licenses.scan_texts(pa.array(["before " + passage + " after"]), t)["labels"][0].split(",")
    for k in free[: len(w) // 10]:
        w[k] = "qqq"
    found = licenses.scan_texts(pa.array([" ".join(w)]), t)
    assert label in found["labels"][0].split(",") and 0.8 <= found["score"][0] <= 1


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize(("label", "text"), [("mit", MIT), ("bsd", BSD)])
def test_published_texts_are_whole_passages(label, text):
    t = licenses.Templates()
    t.rank(np.zeros(len(t.words) + 1), 100)
    found = licenses.scan_texts(pa.array([f"some words before {text} and behind", text.replace("1.", "*"), text.replace(" (the \"Software\")", "")]), t)
    assert found["labels"] == [label] * 3 and found["score"][0] == 1
    assert [(x["label"], x["first"]) for x in found["spans"][0]] == [(label, 3)] and len(found["spans"][1]) == 1


@pytest.mark.parametrize("number", range(len(licenses.PASSAGES)))
def test_words_inserted_or_dropped_in_the_middle(number):
    label, passage, keys = licenses.PASSAGES[number]
    t = licenses.Templates()
    t.rank(np.zeros(len(t.words) + 1), 100)
    w = passage.split()
    key_at = [a for k in keys for a in range(len(w)) if w[a : a + len(k.split())] == k.split() for a in range(a, a + len(k.split()))]
    places = [a for a in range(1, len(w)) if a not in key_at or a - 1 not in key_at]
    for a in places:
        more = ["before", *w[:a], "qqq", "rrr", *w[a:], "after"]
        found = licenses.scan_texts(pa.array([" ".join(more)]), t)
        assert label in found["labels"][0].split(",") and found["score"][0] == 1
        assert {"label": label, "first": 1, "last": len(w) + 2} in found["spans"][0]
        if a not in key_at:
            assert label in licenses.scan_texts(pa.array([" ".join([*w[:a], *w[a + 1 :]])]), t)["labels"][0].split(",")


def test_words_in_order_equal_the_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for n in (1, 5, 30):
        codes = rng.integers(1, 6, n)
        seen = np.zeros((50, n + 2 * licenses.BAND), dtype=np.int64)
        seen[:, licenses.BAND : licenses.BAND + n] = codes
        for row in seen:  # up to BAND / 2 words are replaced
            row[rng.integers(0, len(row), 4)] = rng.integers(0, 9, 4)
        count = licenses._in_order(seen, codes)[0]
        full = np.array([lcs(codes.tolist(), row.tolist()) for row in seen])
        assert (count <= full).all() and (count >= (seen[:, licenses.BAND : licenses.BAND + n] == codes).sum(axis=1)).all()
        assert n > 2 * licenses.BAND or (count == full).all()


def test_document_frequencies(spark, documents):
    t = licenses.Templates()
    df, n = licenses.document_frequencies(documents(["license license", "LICENSE x", None, "x"] * 3).repartition(4), t)
    assert n == 12 and df[t.words.to_pylist().index("license") + 1] == 6
