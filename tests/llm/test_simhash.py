from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ledgerlens.llm import simhash
from ledgerlens.llm.components import components
from tests.llm.conftest import ODD, rows_of
from tests.llm.test_text_helpers import LOWER


def mark(text: str | None) -> int:
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(marks: dict, radius: int = 2) -> dict:
    """Smallest reachable key of every key, by comparing all pairs."""
    root = {k: k for k in marks}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(marks)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= radius:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def test_query_equals_brute_force(spark, sf):
    d = rows_of("documents")
    marks = {i: mark(t) for i, t in zip(d["doc_id"], d["text"])}
    expected = groups(marks)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, sf).collect()}
    assert got == {i: (f"{m:016x}", expected[i]) for i, m in marks.items()}


def test_odd_texts():
    texts = ODD + ["One two", "one TWO three", "x y z w"]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [mark(t) for t in texts]
    assert simhash.fingerprints(pa.array([], pa.string())).tolist() == []


@pytest.mark.parametrize("hot", [4096, 4])
def test_links_of_dense_groups(spark, hot):
    rng = np.random.default_rng(0)
    marks = set()
    for base in rng.integers(0, 1 << 63, 25, dtype=np.uint64):
        for _ in range(40):
            v = base
            for k in rng.integers(0, 64, rng.integers(0, 4)):
                v ^= np.uint64(1) << np.uint64(k)
            marks.add(int(v.view(np.int64)))
    frame = spark.createDataFrame([(m,) for m in marks], "fp long")
    found = {r.node: r.component for r in components(simhash.fingerprint_links(frame, 2, hot)).collect()}
    expected = groups({m: m & (1 << 64) - 1 for m in marks})
    assert {m: found.get(m, m) for m in marks} == expected


def test_portions_do_not_change_links(monkeypatch):
    fp = np.array([0, 1, 3, 7, 1 << 40, 5], dtype=np.uint64)
    whole = sorted(zip(*map(list, map(np.concatenate, zip(*simhash._near_pairs(fp, np.zeros(6, dtype=int), 2))))))
    monkeypatch.setattr(simhash, "PORTION", 1)
    parts = [p for i, j in simhash._near_pairs(fp, np.zeros(6, dtype=int), 2) for p in zip(i.tolist(), j.tolist())]
    assert sorted(parts) == whole == [(i, j) for i in range(6) for j in range(i + 1, 6) if int(fp[i] ^ fp[j]).bit_count() <= 2]


def test_one_document_of_each_group_stays(spark, documents):
    texts = ["a b c d e", "a b c d e", "q w e r t y", None, "", "lonely text of null id", "lonely text of null id"]
    frame = documents(texts, ids=[5, 3, 4, 8, 8, None, None], extra=True)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert [i for i, _ in rows if i is not None] == [3, 4, 8]
    assert sum(i is None for i, _ in rows) == 1
    assert simhash.keep_one(frame.limit(0)).count() == 0
    assert simhash.simhash_groups(documents(["x"] * 4, ids=[1, 1, 1, 2])).count() == 4


def test_rows_that_share_an_id_keep_one_text_of_each_group(spark, documents):
    a, b = "first text of many words here", "another thing altogether with its own words"
    rows = lambda frame: sorted((r.doc_id, r.text) for r in simhash.keep_one(frame).collect())
    assert rows(documents([a, a, b, b], ids=[3, 5, 5, 9])) == [(3, a), (5, b)]
    assert rows(documents([a, b, a, b], ids=[5, 5, 5, 5])) == sorted([(5, a), (5, b)])
    kept = simhash.keep_one(documents([a, b, a], ids=[None, 1, None])).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == [(1, b), (None, a)]
    # near copies under one id are one group
    assert len(rows(documents([a + " x" * 200, a + " x" * 201], ids=[7, 7]))) == 1
