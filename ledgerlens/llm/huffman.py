"""Token ids in canonical length-limited Huffman files.

``encode_documents`` tokenises whole texts once into a shared table, counts ids over all documents, derives one
canonical code of at most ``MAX_BITS`` bits (package-merge) and writes files in ascending ``doc_id`` order. A file holds
documents of one key range: code lengths, ids and sizes of its documents, a bit offset for every ``block`` ids, then the
bit stream. Blocks are independent: ``decode_file`` reads all blocks of a file side by side through a lookup table.

Ranges of ``doc_id`` come from approximate quantiles of that column alone; a file is closed at ``FILE_IDS`` ids, so a task
holds one file's ids, whatever the range holds. Only code lengths (one byte per vocabulary entry), the totals of ranges
and names of files pass through the driver.

Null or empty text: just the end id. Null ``doc_id``: first in order. Rows with the same ``doc_id`` stay separate, ordered
by number of ids, then ids. Empty table: no files, no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_file, pack_arrays, put_file, shared_path, stored, text_slices, unpack_arrays

MAX_BITS = 16
BLOCK = 1024
RUN = 128
FILE_IDS = 2 << 20
#: pieces in each half of the per-process cache, the longest kept (bytes) and the most ids of a kept one
CACHE = 400_000
SHORT = 32
MOST = 12
#: new pieces that go to the tokenizer's model at once
TOGETHER = 256
#: bytes of text tokenised at once
SLICE = 3 << 20


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    n, weights, kinds = len(order), counts[order].astype(np.int64), []
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        at = np.argsort(merged, kind="stable")
        kinds.append(at < n)  # for each entry of this level: a leaf, or a package of the level below
        weights = merged[at]
    take = 2 * n - 2
    lengths = np.zeros(n, dtype=np.int64)
    for kind in reversed(kinds):
        leaf = int(kind[:take].sum())
        lengths[:leaf] += 1
        take = 2 * (take - leaf)
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the one before plus one, shifted at each longer length."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = np.uint64(1) << (np.uint64(MAX_BITS) - lengths[order].astype(np.uint64))
    first = np.cumsum(span) - span
    codes[order] = first >> (np.uint64(MAX_BITS) - lengths[order].astype(np.uint64))
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The ids' codes as a bit stream (most significant bit first) and the bit offset of every ``block`` ids.

    The stream is made of runs of ``RUN`` blocks, each padded to a whole number of 32-bit words, so that temporary arrays
    stay small.
    """
    parts, offsets, at = [], [], 0
    for k in range(0, len(ids), RUN * block):
        data, first = _encode_run(ids[k : k + RUN * block], lengths, codes, block)
        parts.append(data)
        offsets.append(first + np.uint64(at))
        at += 8 * len(data)
    if not parts:
        return np.zeros(4, dtype=np.uint8), np.zeros(0, dtype=np.uint64)
    return np.concatenate(parts), np.concatenate(offsets)


def _encode_run(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    words = int(end[-1] if len(end) else 0) // 32 + 2
    window = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    high = np.bincount(at >> 5, weights=(window >> np.uint64(32)).astype(np.float64), minlength=words)
    low = np.bincount((at >> 5) + 1, weights=(window & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
    return (high[:words] + low[:words]).astype(">u4").view(np.uint8), at[::block].astype(np.uint64)


def decode_bits(data: np.ndarray, offsets: np.ndarray, n: int, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Ids of a stream: one table step a time, for all blocks at once."""
    if n == 0:
        return np.zeros(0, dtype=np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    symbol = np.zeros(1 << MAX_BITS, dtype=np.uint32)
    step = np.ones(1 << MAX_BITS, dtype=np.int64)
    filled = int(span.sum())
    symbol[:filled] = np.repeat(order, span)
    step[:filled] = np.repeat(lengths[order], span)
    b = np.concatenate([data, np.zeros(4, dtype=np.uint8)]).astype(np.uint32)
    window = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    at = offsets.astype(np.int64)
    out = np.zeros((min(block, n), len(at)), dtype=np.uint32)
    last = n - (len(at) - 1) * block
    for i in range(out.shape[0]):
        if i == last:
            at = at[:-1]
        key = (window[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[i, : len(at)] = symbol[key]
        at = at + step[key]
    return out.T.reshape(-1)[:n]


def file_bytes(docs: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, start: int, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    data, offsets = encode_bits(ids, lengths, codes)
    used = np.flatnonzero(lengths).astype(np.uint32)
    return pack_arrays({
        "format": np.array([1, BLOCK, MAX_BITS, start, len(ids)], dtype=np.int64),
        "used": used, "lengths": lengths[used], "doc_id": docs, "null_id": nulls.astype(np.uint8), "sizes": sizes.astype(np.int64),
        "offsets": offsets, "data": data,
    })


def decode_file(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """(doc_id, null mask, ids per document, start, ids) of a file."""
    a = unpack_arrays(raw)
    _, block, _, start, n = (int(x) for x in a["format"])
    lengths = np.zeros(int(a["used"].max(initial=0)) + 1, dtype=np.uint8)
    lengths[a["used"]] = a["lengths"]
    ids = decode_bits(a["data"], a["offsets"], n, lengths, block)
    return a["doc_id"], a["null_id"].astype(bool), a["sizes"], start, ids


# ---- tokenising ----

_state: dict = {}

#: classes of bytes: unknown, letter, digit, mark, apostrophe, space, line break
_LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _BREAK = 1, 2, 3, 4, 5, 6
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39], _CLASS[32], _CLASS[10] = _QUOTE, _SPACE, _BREAK
#: first bytes of characters of two bytes that are all letters (U+00C0-U+023F but for two signs, U+0400-U+047F)
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xD0, 0xD1]] = True
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u023f\u0400-\u047f"
#: one unit of the pre-tokenizer: letters, digits or marks, after a space or not
_UNIT = re.compile(rf" ?(?:[{_LETTERS}]+|[0-9]+|[!-/:-@\[-`{{-~]+)").fullmatch
#: a change of class that always ends a unit; letters may go on after an apostrophe
_CHANGE = np.zeros((8, 8), dtype=bool)
_CHANGE[_LETTER, [_DIGIT, _MARK, _QUOTE]] = _CHANGE[_DIGIT, [_LETTER, _MARK, _QUOTE]] = _CHANGE[_MARK, [_LETTER, _DIGIT]] = True


def cuts(raw: np.ndarray) -> np.ndarray:
    """Whether the pre-tokenizer always begins a unit at each byte, as far as the bytes beside it tell."""
    kind = _CLASS[raw]
    lead = np.flatnonzero(_LEADS[raw[:-1]]) if len(raw) else np.zeros(0, dtype=np.int64)
    lead = lead[~((raw[lead] == 0xC3) & np.isin(raw[lead + 1], (0x97, 0xB7)))]
    kind[lead] = kind[lead + 1] = _LETTER
    out = np.zeros(len(raw) + 1, dtype=bool)
    if len(raw) < 3:
        return out[:-1]
    out[1 : len(raw)] = _CHANGE.reshape(-1)[(kind[:-1] << 3) | kind[1:]]
    known = (kind >= _LETTER) & (kind <= _QUOTE)
    between = np.flatnonzero((kind[1:-1] >= _SPACE) & known[:-2] & known[2:]) + 1  # one space or line break between two others
    out[between] = True
    out[between[kind[between] == _BREAK] + 1] = True
    return out[:-1]


def _keys(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether kept, bytes and size as a row of integers, a hash) of each piece."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.zeros(int(at[-1] - at[0]) + SHORT, dtype=np.uint8)
    if data is not None:
        raw[:-SHORT] = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    size = np.diff(at)
    table = np.lib.stride_tricks.sliding_window_view(raw, SHORT)[at[:-1] - at[0]]
    table[np.arange(SHORT) >= size[:, None]] = 0
    keys = np.empty((len(size), SHORT // 8 + 1), dtype=np.uint64)
    keys[:, :-1] = table.view(np.uint64)
    keys[:, -1] = size
    h = np.zeros(len(size), dtype=np.uint64)
    for lane in range(keys.shape[1]):
        h = (h ^ keys[:, lane]) * np.uint64(0x9E3779B185EBCA87)
        h ^= h >> np.uint64(29)
    return size <= SHORT, keys, h


class Kept:
    """Ids of pieces, found by the pieces' bytes: the entry is in one of two slots for the hash (a later one may take both)."""

    def __init__(self, kind: type):
        self.slots = np.zeros(1 << (2 * CACHE).bit_length(), dtype=np.int32)
        self.keys = np.zeros((0, SHORT // 8 + 1), dtype=np.uint64)
        self.ids = np.zeros((0, MOST), dtype=kind)
        self.sizes = np.zeros(0, dtype=np.int8)
        self.n = 0

    def __len__(self) -> int:
        return self.n

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Entry of each piece, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int32)
        rows = np.arange(len(keys))
        for slot in self.places(hashes):
            entry = self.slots[slot[rows]] - 1
            some = np.flatnonzero(entry >= 0)
            some = some[(self.keys[entry[some]] == keys[rows[some]]).all(axis=1)]
            out[rows[some]] = entry[some]
            rows = np.flatnonzero(out < 0)
        return out

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        return hashes & mask, (hashes >> np.uint64(32)) & mask

    def add(self, keys: np.ndarray, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keep pieces; returns their entries."""
        end = self.n + len(keys)
        if end > len(self.keys):
            room = max(end, min(2 * len(self.keys), CACHE + end - self.n))
            for name in ("keys", "ids", "sizes"):
                old = getattr(self, name)
                new = np.empty((room, *old.shape[1:]), dtype=old.dtype)
                new[: self.n] = old[: self.n]
                setattr(self, name, new)
        entries = np.arange(self.n, end, dtype=np.int32)
        self.keys[self.n : end], self.ids[self.n : end], self.sizes[self.n : end] = keys, ids, sizes
        one, two = self.places(hashes)
        free = np.flatnonzero(self.slots[one] == 0)
        self.slots[one[free]] = entries[free] + 1
        rest = np.flatnonzero(self.slots[one] != entries + 1)
        self.slots[two[rest]] = entries[rest] + 1
        self.n = end
        return entries


class Pieces:
    """Ids of pieces of texts, the recent ones kept between slices of a worker process.

    Texts are cut where a byte-level BPE's pre-tokenizer always begins a new unit (see ``cuts``), so a piece's ids do not
    depend on what stands around it. New pieces that are one unit go straight to the tokenizer's model, many at once with a
    byte between them that no text holds and no merge takes in; any other goes through the whole tokenizer. Up to ``CACHE``
    short pieces are kept twice over: when the newer half is full it becomes the older, and what the older half still serves
    moves to the newer. A text with the literal of an added token (which is that token's id) is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        split, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        if self.tokenizer.normalizer is not None or type(split).__name__ != "ByteLevel" or split.add_prefix_space or type(model).__name__ != "BPE":
            raise ValueError(f"not a plain byte-level BPE: {path}")
        self.model = Tokenizer(model)  # the merges alone
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = np.arange(256, dtype="<u4")
        self.alphabet[hidden] = 256 + np.arange(len(hidden))
        self.between = self.divider(model)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32
        self.clear()

    def divider(self, model) -> int | None:
        """Id of the byte 0xFF, which UTF-8 never holds, if no merge can take it in and units do not change beside it."""
        if model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix or model.ignore_merges:
            return None
        vocabulary, mark = self.tokenizer.get_vocab(with_added_tokens=False), chr(self.alphabet[0xFF])
        return vocabulary.get(mark) if sum(mark in token for token in vocabulary) == 1 else None

    def clear(self) -> None:
        self.new, self.old = Kept(self.kind), Kept(self.kind)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids one piece after another, ids of each piece), in parts."""
        ids, sizes = [], []
        for k in range(0, len(pieces), TOGETHER):
            raw = "\n".join(pieces[k : k + TOGETHER]).encode().replace(b"\n", b"\xff")  # a unit holds no line break
            spelt = self.alphabet[np.frombuffer(raw, dtype=np.uint8)].tobytes().decode("utf-32-le")
            part = np.array(self.model.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, dtype=self.kind)
            mark = part == self.between
            sizes.append(np.diff(np.flatnonzero(mark), prepend=-1, append=len(part)) - 1)
            ids.append(part[~mark])
        return ids, sizes

    def fresh(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, where each piece's begin, how many it has)."""
        unit = np.fromiter((_UNIT(v) is not None for v in pieces), dtype=bool, count=len(pieces))
        if self.between is None:
            unit[:] = False
        rows = [np.flatnonzero(unit), np.flatnonzero(~unit)]
        ids, sizes = self.units([pieces[i] for i in rows[0].tolist()])
        found = self.whole([pieces[i] for i in rows[1].tolist()])
        ids += [np.array(x, dtype=self.kind) for x in found]
        sizes.append(np.array([len(x) for x in found], dtype=np.int64))
        size = np.concatenate(sizes)
        out = np.empty((2, len(pieces)), dtype=np.int64)
        out[:, np.concatenate(rows)] = np.cumsum(size) - size, size
        return np.concatenate(ids) if ids else np.zeros(0, dtype=self.kind), out[0], out[1]

    def pool(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, where each piece's begin, how many it has) of distinct pieces."""
        short, keys, hashes = _keys(values)
        entry = np.full(len(values), -1, dtype=np.int32)
        rows = np.flatnonzero(short)
        entry[rows] = self.new.find(keys[rows], hashes[rows])
        rows = rows[entry[rows] < 0]
        had = self.old.find(keys[rows], hashes[rows])
        again, had = rows[had >= 0], had[had >= 0]
        entry[again] = self.new.add(keys[again], hashes[again], self.old.ids[had], self.old.sizes[had])
        known, lost = np.flatnonzero(entry >= 0), np.flatnonzero(entry < 0)
        ids = self.new.ids[entry[known]]
        begin, size = np.empty((2, len(values)), dtype=np.int32)
        begin[known], size[known] = np.arange(len(known)) * MOST, self.new.sizes[entry[known]]
        extra, first, n = self.fresh(values.take(pa.array(lost)).to_pylist())
        begin[lost], size[lost] = ids.size + first, n
        keep = np.flatnonzero(short[lost] & (n <= MOST))
        table = np.zeros((len(keep), MOST), dtype=self.kind)
        inside = np.arange(MOST) < n[keep][:, None]
        table[inside] = extra[(first[keep][:, None] + np.arange(MOST))[inside]]
        self.new.add(keys[lost[keep]], hashes[lost[keep]], table, n[keep])
        if len(self.new) > CACHE:
            self.new, self.old = Kept(self.kind), self.new
        return np.concatenate([ids.ravel(), extra]), begin, size

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets); each text closed by ``end``."""
        texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
        odd = np.zeros(len(texts), dtype=bool)
        for literal in self.added:
            odd |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        at = at - at[0]
        begins = cuts(raw)
        begins[at[:-1][at[1:] > at[:-1]]] = True
        begins = np.flatnonzero(begins)
        per_text = np.diff(np.searchsorted(begins, at))
        parts = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = parts.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        pool, begin, size = self.pool(coded.dictionary)
        size, begin = size[code], begin[code]
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        if odd.any():
            size[np.repeat(odd, per_text)] = 0
        ends = np.cumsum(size, dtype=np.int32)  # ids of a text of 2 GB at most
        length = np.diff(np.concatenate([[0], ends])[bounds]).astype(np.int64)
        place = np.repeat(begin - (ends - size), size)
        place += np.arange(len(place), dtype=np.int32)
        ids = np.take(pool, place)
        del place
        if odd.any():
            found = self.whole([texts[int(i)].as_py() for i in np.flatnonzero(odd)])
            extra = np.fromiter((i for x in found for i in x), dtype=np.uint32)
            where = np.repeat((np.cumsum(length) - length)[odd], [len(x) for x in found])
            ids = np.insert(ids, where, extra)
            length[odd] = [len(x) for x in found]
        offsets = np.concatenate([[0], np.cumsum(length + 1)])
        out = np.empty(len(ids) + len(texts), dtype=np.uint32)
        body = np.ones(len(out), dtype=bool)
        body[offsets[1:] - 1] = False
        out[body] = ids
        out[offsets[1:] - 1] = end
        return out, offsets


def pieces(path: str) -> Pieces:
    if path not in _state:
        _state[path] = Pieces(path)
    return _state[path]


def _squeezer():
    """Function that compresses an array of ids (16 bits each where they fit)."""
    compress = zstandard.ZstdCompressor(level=1).compress

    def run(ids: np.ndarray) -> bytes:
        return compress(ids.astype(np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32).tobytes())

    return run


def _reader():
    """Function that gives back the ids."""
    decompress = zstandard.ZstdDecompressor().decompress

    def run(blob: bytes, n: int) -> np.ndarray:
        raw = decompress(blob)
        return np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * n else np.uint32)

    return run


def tokenised(documents: DataFrame, tokenizer: str, end: int, bounds: list[int]) -> DataFrame:
    """(doc_id, span, n_tokens, ids): span numbers the key range, ids are compressed."""
    edges = np.array(bounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, squeeze = pieces(tokenizer), _squeezer()
        for b in text_slices(batches, "text", SLICE):
            ids, at = p.encode(b.column("text"), end)
            doc = b.column("doc_id")
            span = np.searchsorted(edges, pc.fill_null(doc, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(span.astype(np.int32)), pa.array(np.diff(at)), pa.array([squeeze(ids[x:y]) for x, y in zip(at, at[1:])], pa.binary())],
                ["doc_id", "span", "n_tokens", "ids"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, span int, n_tokens long, ids binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """Occurrences of each id over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, read = np.zeros(1 << 16, dtype=np.int64), _reader()
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                ids = np.concatenate([read(blob, n) for blob, n in zip(part.column("ids").to_pylist(), part.column("n_tokens").to_pylist())])
                c = np.bincount(ids)
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), dtype=np.int64)])
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = tokens.select("n_tokens", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, dtype=np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def encode_documents(documents: DataFrame, tokenizer: str, end: int = 2) -> tuple[DataFrame, str]:
    """Write all documents; returns (table of file names, folder)."""
    spark = documents.sparkSession
    folder = shared_path(spark, "huffman")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / (4 * parts) for i in range(1, 4 * parts)]
    bounds = documents.agg(F.percentile_approx(F.col("doc_id").cast("long"), cuts, 10 * len(cuts)).alias("q")).first()["q"]
    tokens = stored(tokenised(documents, tokenizer, end, sorted(set(bounds or []))), "tokens")
    lengths = code_lengths(id_counts(tokens))
    codes = canonical_codes(lengths)
    totals = {r["span"]: r["n"] for r in tokens.groupBy("span").agg(F.sum("n_tokens").alias("n")).collect()}
    first, at = {}, 0
    for span in sorted(totals):
        first[span], at = at, at + totals[span]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, held, count, start, number = None, [], 0, 0, 0
        read = _reader()

        def close() -> list[tuple]:
            nonlocal held, count, start, number
            if not held:
                return []
            ids = np.concatenate([x for *_, x in held])
            sizes = np.array([len(x) for *_, x in held], dtype=np.int64)
            nulls = np.array([d is None for d, _ in held])
            docs = np.array([d or 0 for d, _ in held], dtype=np.int64)
            name = f"{folder}/ids-{span:08d}-{number:06d}.huf"
            put_file(name, file_bytes(docs, nulls, sizes, start, ids, lengths, codes))
            held, count, start, number = [], 0, start + len(ids), number + 1
            return [name]

        done: list = []
        for b in batches:
            for doc, s, n, blob in zip(*(b.column(c).to_pylist() for c in ("doc_id", "span", "n_tokens", "ids"))):
                if s != span:
                    done += close()
                    span, start, number = s, first[s], 0
                held.append((doc, read(blob, n)))
                count += n
                if count >= FILE_IDS:
                    done += close()
        done += close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["file"])

    ordered = tokens.repartition(parts, "span").sortWithinPartitions(F.col("span"), F.col("doc_id").asc_nulls_first(), "n_tokens", "ids")
    return stored(ordered.mapInArrow(write, "file string"), "huffman-files"), folder


def decode_documents(files: DataFrame) -> DataFrame:
    """Read files back: (doc_id, start, n_tokens, ids_crc32) of each document."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                docs, nulls, sizes, start, ids = decode_file(map_file(name))
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=nulls), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.repartition(parts).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(documents: DataFrame, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """Encode all documents, read the files back and digest them."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    files, _ = encode_documents(documents, tokenizer, end)
    return decode_documents(files)


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
