from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import ngram
from tests.llm.conftest import ODD, rows_of
from tests.llm.test_text_helpers import LOWER


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), None]


class Model:
    """The same model from plain counters."""

    def __init__(self, texts):
        rows = [tokens(t) for t in texts]
        self.c1 = Counter(w for r in rows for w in r)
        self.c2 = Counter(p for r in rows for p in zip(r, r[1:]))
        self.c3 = Counter(p for r in rows for p in zip(r, r[1:], r[2:]))
        self.N, self.V = sum(self.c1.values()), len(self.c1)
        self.d2, self.d3 = (self.discount(c) for c in (self.c2, self.c3))
        self.deg1, self.deg2 = Counter(p[0] for p in self.c2), Counter(p[:2] for p in self.c3)
        self.sum2 = Counter()
        for p, n in self.c3.items():
            self.sum2[p[:2]] += n

    @staticmethod
    def discount(c):
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 else 0.5

    def p(self, row, k):
        w = row[k]
        p = (self.c1[w] + 0.5) / (self.N + 0.5 * (self.V + 1))
        if k and self.deg1[u := row[k - 1]]:
            n = self.c2[u, w]
            p = (n - self.d2 if n else 0) / self.c1[u] + self.d2 * self.deg1[u] / self.c1[u] * p
            if k > 1 and self.sum2[h := (row[k - 2], u)]:
                n = self.c3[(*h, w)]
                p = (n - self.d3 if n else 0) / self.sum2[h] + self.d3 * self.deg2[h] / self.sum2[h] * p
        return p

    def row(self, text):
        r = tokens(text)
        base = sum(math.log10((self.c1[w] + 0.5) / (self.N + 0.5 * (self.V + 1))) for w in r)
        return len(r), sum(self.c1[w] > 0 for w in r), self.N, base, sum(math.log10(self.p(r, k)) for k in range(len(r)))


def same(got, expected, per_token=0.03):
    assert tuple(got)[:3] == expected[:3]
    assert got[3] == pytest.approx(expected[3], rel=1e-9)
    assert abs(got[4] - expected[4]) <= per_token * expected[0]  # probabilities have 8 bits


def test_query_equals_counters(spark, sf, monkeypatch):
    monkeypatch.setattr(ngram, "SHARD_TOKENS", 20_000)
    monkeypatch.setattr(ngram, "HELD", 30_000)
    d = rows_of("documents")
    learned = [t for i, t in zip(d["doc_id"], d["text"]) if zlib.crc32(str(i).encode()) % 5 != 1]
    model = Model(learned)
    rows = {r.doc_id: r for r in ngram.op1_lm_score(spark, sf).collect()}
    held = []
    for i, t in zip(d["doc_id"], d["text"]):
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), model.row(t))
        held += [r.score - r.base_score] if r.held_out else []
    assert sum(held) > 0  # better than the base on held-out documents


def test_odd_documents(spark, documents):
    texts = [*ODD, "a b", "a b a b", "c"]
    frame = documents(texts, extra=True)
    meta = ngram.build(frame.where("doc_id <> 12"))
    model = Model(texts[:12])
    rows = {r.doc_id: r for r in ngram.score(frame, meta).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), model.row(t))
    nothing = ngram.build(frame.limit(0))
    assert {(r.n_known, r.score, r.base_score) for r in ngram.score(frame, nothing).collect()} == {(0, 0.0, 0.0)}
    assert ngram.score(frame.limit(0), meta).count() == 0


def test_hot_word_is_spread_over_shards(spark, documents, monkeypatch):
    monkeypatch.setattr(ngram, "SHARD_TOKENS", 500)
    texts = [" ".join(f"the w{(i * 37 + k) % 400}" for k in range(40)) for i in range(60)]
    meta = ngram.build(documents(texts))
    assert meta["parts2"] >= 9
    n = np.diff(meta["first2"])
    assert n.max() <= 0.5 * n.sum()
    model = Model(texts)
    rows = {r.doc_id: r for r in ngram.score(documents(texts), meta).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), model.row(t))


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 1), (1, 1 << 60), (1000, 2000), (5000, 1 << 60), (3000, 10), (70, 64), (4096, 1 << 40), (513, 3)):
        v = np.sort(rng.integers(0, top, n))
        packed = ngram.unpack_arrays(np.frombuffer(ngram.pack_arrays(ngram.EliasFano.pack(v, "x")), dtype=np.uint8))
        e = ngram.EliasFano(packed, "x")
        assert (e[np.arange(n)] == v).all()
        q = np.concatenate([rng.integers(0, top + 5, 2000), v, v + 1, np.maximum(v - 1, 0)])
        at, hit = e.find(q)
        assert (at == np.searchsorted(v, q)).all() and (hit == np.isin(q, v)).all()


def test_runs_and_tallies():
    a = np.array([3, 1, 3, 1, 1 << 50])
    b = np.array([1 << 40, 2, 1 << 40, 2, 0])
    x, y, n = ngram.tally(a, b, np.arange(5))
    assert list(zip(x.tolist(), y.tolist(), n.tolist())) == [(1, 2, 4), (3, 1 << 40, 2), (1 << 50, 0, 4)]
    assert (ngram.unsqueeze(ngram.squeeze(a)) == a).all() and len(ngram.unsqueeze(ngram.squeeze(a[:0]))) == 0


def test_word_hashes_depend_on_the_word_alone():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(1, 128, k, dtype=np.uint8)).decode() for k in list(range(70)) * 300]
    words += ["a" * k for k in range(100)] + ["a" * k + "\x00" for k in range(100)] + ["é" * k for k in range(40)] + ["\x00" * k for k in range(40)]
    words = sorted(set(words))
    whole = ngram.word_hashes(pa.array(words, pa.large_string()))
    assert len(set(whole.tolist())) == len(words)
    assert [ngram.word_hashes(pa.array(["x", w, "y" * 50], pa.large_string()))[1] for w in words[::97]] == whole[::97].tolist()
    assert ngram.word_hashes(pa.array(words, pa.large_string()).slice(5, 9)).tolist() == whole[5:14].tolist()
    # spread evenly over shards
    counts = np.bincount(ngram.word_shard((whole >> np.uint64(64 - ngram.HASH_BITS)).astype(np.int64), 16), minlength=16)
    assert counts.min() > 0.8 * counts.mean()
    assert len(ngram.word_hashes(pa.array([], pa.large_string()))) == 0


def test_a_context_is_located_once_for_all_its_tokens(monkeypatch):
    """Word pairs repeat far more than word triples: pointers are read per distinct pair, not per token."""
    import numpy as np

    from ledgerlens.llm import ngram

    pointers = np.array([0, 2, 3], dtype=np.int64)  # the successors of two contexts
    arrays = ngram.EliasFano.pack(np.array([0, 2, 4], dtype=np.int64), "ids") | ngram.EliasFano.pack(pointers, "ptr")
    level = {"ids": ngram.EliasFano(arrays, "ids"), "ptr": ngram.EliasFano(arrays, "ptr")}
    codes = {"freq": np.array([1, 2, 3], dtype=np.uint8), "back": np.array([4, 5], dtype=np.uint8)}
    trie = ngram.Trie({"folder": "", "N": 1, "V": 1, "first2": np.array([0, 2]), "scale": np.arange(256) / 256})
    monkeypatch.setattr(trie, "level", lambda name, shard, *sequences: level if name == "l3" else codes)
    read = []
    get = ngram.EliasFano.__getitem__
    monkeypatch.setattr(ngram.EliasFano, "__getitem__", lambda self, i: read.append(len(i)) or get(self, i))
    freq, back = trie.triples(np.array([1, 0] * 500), np.array([1, 0, 0, 2, 1, -1, 7, 1] * 125))
    assert sum(read) <= 8
    assert (freq * 256).tolist() == [3, 1, 0, 2, 3, 0, 0, 0] * 125
    assert (back * 256).tolist() == [5, 4] * 500


def test_sequence_far_from_zero_has_small_buckets():
    """The last shard of hashes is as cheap to search as the first: entries are kept relative to the first."""
    rng = np.random.default_rng(3)
    v = np.sort(rng.integers(0, 1 << 50, 5000))
    near, far = (ngram.EliasFano(ngram.EliasFano.pack(x, "x"), "x") for x in (v, v + (1 << 60)))
    assert far.bits == near.bits and len(far.high) == len(near.high)
    q = np.concatenate([v, v - 1, v + 1, np.array([0, 1 << 51])]) + (1 << 60)
    q = np.concatenate([q, [0, 5, (1 << 61) + 7]])
    at, hit = far.find(q)
    assert (at == np.searchsorted(v + (1 << 60), q)).all() and (hit == np.isin(q, v + (1 << 60))).all()


def test_long_runs_in_one_bucket():
    v = np.concatenate([np.arange(0, 70), np.arange(1000, 1700), [1 << 20], np.arange((1 << 24), (1 << 24) + 64)])
    e = ngram.EliasFano(ngram.EliasFano.pack(v, "x"), "x")
    q = np.concatenate([v, v + 1, np.arange(0, 3000, 7), [1 << 23, 1 << 30]])
    at, hit = e.find(q)
    assert (at == np.searchsorted(v, q)).all() and (hit == np.isin(q, v)).all() and (e[np.arange(len(v))] == v).all()


def test_lookups_go_through_the_trie_in_order(spark, documents, monkeypatch):
    """Words, pairs and triples of a slice are each looked up once and in the order of the trie."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.4, 200) % 500) for _ in range(30)]
    meta = ngram.build(documents(texts))
    asked = []
    find = ngram.EliasFano.find
    monkeypatch.setattr(ngram.EliasFano, "find", lambda self, x: asked.append(x) or find(self, x))
    ngram.score_texts(meta, pa.array(texts + texts))
    assert len(asked) >= 3 and all((np.diff(x) > 0).all() for x in asked)


def test_counted_equals_tally():
    rng = np.random.default_rng(6)
    for top in (1, 50, 1 << 40):
        a, b = rng.integers(0, 30, 500) * top, rng.integers(0, 30, 500) * top
        for x, y in zip(ngram.counted(a, b), ngram.tally(a, b, np.ones(500, dtype=np.int64))):
            assert (x == y).all()
    assert [len(x) for x in ngram.counted(a[:0], b[:0])] == [0, 0, 0]
