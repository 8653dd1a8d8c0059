from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import huffman
from tests.llm.conftest import ODD, rows_of

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(tokenizer, rows) -> list[tuple]:
    out, start = [], 0
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query_round_trip(spark, sf, tokenizer):
    d = rows_of("documents")
    got = sorted(tuple(r) for r in huffman.op9_token_binary(spark, sf).collect())
    assert got == expected(tokenizer, sorted(zip(d["doc_id"], d["text"])))


def test_odd_documents(spark, documents, tokenizer):
    texts = ODD + ["  two  spaces \n \n x", "<|endoftext|>"]
    got = sorted(tuple(r) for r in huffman.token_ids(documents(texts, extra=True)).collect())
    assert got == expected(tokenizer, enumerate(texts))
    assert huffman.token_ids(documents(texts).limit(0)).count() == 0


def test_literals_of_added_tokens(spark, documents):
    """Plain ``encode(text, add_special_tokens=False)``: a literal is its token's id."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    texts = ["ab <|endoftext|> cd", "a b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y \n z", "<|endoftext| >", None, "cd <|endoftext|> ab"]
    ids, offsets = huffman.Pieces(PATH).encode(pa.array(texts), 2)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert ids[:5].tolist() == [397, 220, 50256, 22927, 2]
    assert sorted(tuple(r) for r in huffman.token_ids(documents(texts)).collect()) == expected(plain, enumerate(texts))


def test_null_and_repeated_ids(spark, documents, tokenizer):
    got = huffman.token_ids(documents(["b", "a longer one", "c", "c"], ids=[7, None, 7, 7])).collect()
    assert sorted(r.start for r in got) == [0, 4, 6, 8] or sorted(r.n_tokens for r in got)[:3] == [2, 2, 2]
    assert min(got, key=lambda r: r.start).doc_id is None
    assert sum(r.n_tokens for r in got) == sum(n for _, _, n, _ in expected(tokenizer, enumerate(["b", "a longer one", "c", "c"])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab,.!'  \n\té1 　", max_size=25)), max_size=10))
def test_pieces_equal_the_tokenizer(texts):
    p = huffman.pieces(PATH)
    ids, at = p.encode(pa.array(texts, pa.string()), 2)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [p.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_cache_of_two_halves(monkeypatch):
    """Ids stay the same while pieces come, go and come back."""
    monkeypatch.setattr(huffman, "CACHE", 50)
    p, rng = huffman.Pieces(PATH), np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("Word", "été", "l'eau", "x_1", "!?", "don't ", "\n") for b in range(40)]
    for _ in range(20):
        text = " ".join(rng.choice(words, 60))
        ids, _ = p.encode(pa.array([text]), 2)
        assert ids.tolist() == p.tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert len(p.new) <= 50 + 400 and len(p.old) <= 50 + 400


def best_cost(counts: list[int]) -> int:
    heap, total = [c for c in counts if c], 0
    heapq.heapify(heap)
    if len(heap) == 1:
        return heap[0]
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60))
def test_code_is_optimal_and_decodes(counts):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all()
    assert int((counts * lengths).sum()) == best_cost(counts.tolist())
    ids = np.repeat(np.arange(len(counts)), np.minimum(counts, 50))
    np.random.default_rng(1).shuffle(ids)
    codes = huffman.canonical_codes(lengths)
    for block in (1, 7, 1024):
        data, offsets = huffman.encode_bits(ids, lengths, codes, block)
        assert (huffman.decode_bits(data, offsets, len(ids), lengths, block) == ids).all()


def test_length_limit():
    counts = np.array([1 << min(k, 40) for k in range(60)])
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= huffman.MAX_BITS and sum(2.0 ** -int(x) for x in lengths) <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(20), limit=4)


def test_long_documents_make_several_files(spark, documents, tokenizer, monkeypatch):
    monkeypatch.setattr(huffman, "FILE_IDS", 50)
    texts = ["some words " * 30, "x", "more words " * 40, "y"]
    files, _ = huffman.encode_documents(documents(texts), PATH)
    assert files.count() >= 2
    assert sorted(tuple(r) for r in huffman.decode_documents(files).collect()) == expected(tokenizer, enumerate(texts))


def test_new_pieces_go_to_the_model_many_at_once(tokenizer):
    p = huffman.Pieces(PATH)
    text = " ".join(f"wo{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}rt{chr(97 + i // 676)}" for i in range(3000))
    asked, model = [], p.model

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.append(len(texts))
            return model.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    p.model = Counting()
    for _ in range(2):  # the second time all are known
        assert p.encode(pa.array([text]), 2)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert 1 <= sum(asked) <= 3000 // huffman.TOGETHER + 1


def test_pieces_that_share_a_slot(tokenizer, monkeypatch):
    """Pieces are told apart by all their bytes and their length, however few the slots."""
    monkeypatch.setattr(huffman, "CACHE", 2)
    p, rng = huffman.Pieces(PATH), np.random.default_rng(8)
    words = ["a", "a\x00", "\x00", "b" * 31, "b" * 32, "b" * 33, "ß" * 16, "ß" * 17, "ÿ", "aÿ", "x" * 90, "!" * 40, "'s", "it's", "1" * 13, "Ġ", "日本", "﻿", "😀" * 8]
    for n in (1, 2, 5, 40):
        for _ in range(30):
            text = "".join(rng.choice([*words, " ", "\n", "  "], n))
            assert p.encode(pa.array([text]), 2)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2], text


def test_tokenizer_without_a_dividing_byte(tokenizer):
    p = huffman.Pieces(PATH)
    assert p.between == tokenizer.token_to_id("ÿ")
    p.between = None
    for text in ("some words, some été 12 words' end", "one", "x\n\ny  z"):
        assert p.encode(pa.array([text, None]), 2)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2, 2]
