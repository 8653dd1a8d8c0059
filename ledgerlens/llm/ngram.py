"""Language-model scores from an Elias-Fano n-gram trie.

The model is an interpolated trigram model with absolute discounting: p(w | u v) = a3 + b3 * (a2 + b2 * p1(w)), where a is the
discounted relative frequency of the longer n-gram, b the mass its discount frees, and p1 = (c + 0.5) / (N + 0.5 (V + 1)). The
discounts are n1 / (n1 + 2 n2) of each order, from counts of all n-grams. Nothing is pruned or sampled.

The trie lies in the shared folder, one file per shard and level, and is memory-mapped:

* level 1: hashes of words in rising order (Elias-Fano; a word's id is its rank) and their running counts;
* level 2: for every word, a monotone pointer to its successors and their ids, made monotone by the rank of the parent;
* level 3: for every word pair, a pointer to its successors, each stored as its position among the successors of the pair's
  second word (ids relative to the context), made monotone by running sums;
* probabilities and back-off masses: 8 bits, uniform on a logarithmic scale.

A lookup is a successor search (next greater or equal) in the range of its context. Levels 2 and 3 are sharded by ranges of
(first word, second word) that hold equal shares of all tokens, so a word that makes up a third of the corpus is spread over
a third of the shards. Tasks count n-grams locally and send sorted, compressed runs to shards; a shard holds about
``SHARD_TOKENS`` tokens' n-grams. Only sizes of shards pass through the driver.

Words are told apart by 60 bits of XXH64 (two words in a vocabulary of ten million share one with a chance of 4e-5).

Null or empty text: just the end token. Null ``doc_id``: learned from (it is in no held-out fold). Repeated rows count each.
Empty training data: every token is unknown. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_file, pack_arrays, put_file, segment_sums, shared_path, space_words, text_slices, unpack_arrays

HASH_BITS = 60
#: n-grams a task holds before it sends a run
HELD = 3 << 20
SHARD_TOKENS = 1 << 20
SLICE = 12 << 20
#: queries answered at once
PART = 1 << 16

U = np.uint64
RUNS = "shard int, data binary"
EMPTY = np.zeros(0, dtype=np.int64)


# ---- Elias-Fano sequences ----

_ONES, _HIGHS = U(0x0101010101010101), U(0x8080808080808080)
#: position of set bit number r of a byte
_SELECT = np.array([[([k for k in range(8) if byte >> k & 1] + [0] * 8)[r] for r in range(8)] for byte in range(256)], dtype=np.int64)


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of set bit number r of each word: running counts per byte in one multiplication, then a table."""
    s = word - ((word >> U(1)) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + ((s >> U(2)) & U(0x3333333333333333))
    s = ((s + (s >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _ONES
    rank = r.astype(np.uint64)
    reached = ((s | _HIGHS) - (rank + U(1)) * _ONES) & _HIGHS
    place = (U(8) - np.bitwise_count(reached).astype(np.uint64)) << U(3)
    place = np.minimum(place, U(56))
    within = rank - (((s << U(8)) >> place) & U(0xFF))
    return place.astype(np.int64) + _SELECT[(word >> place) & U(0xFF), within & U(7)]


class EliasFano:
    """Random access and successor search in a rising sequence of integers below 2**62."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.bits, self.base = (int(x) for x in arrays[f"{name}.size"])
        self.low, self.high, self.ones = (arrays[f"{name}.{k}"] for k in ("low", "high", "ones"))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def pack(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        n = len(values)
        base = int(values[0]) if n else 0  # entries are kept relative to the first
        top = int(values[-1]) - base + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        v = (values - base).astype(np.uint64)
        at = (v >> U(bits)).astype(np.int64) + np.arange(n)
        words = (int(at[-1]) if n else 0) // 64 + 2
        mask = np.zeros(words * 64, dtype=np.uint8)
        mask[at] = 1
        high = np.packbits(mask, bitorder="little").view(np.uint64)
        count = np.bitwise_count(high).astype(np.int64)
        low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
        if bits and n:
            part = v & U((1 << bits) - 1)
            place = np.arange(n, dtype=np.int64) * bits
            word, off = place >> 6, (place & 63).astype(np.uint64)
            # entries that start in the same word are next to each other
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low[word[first]] |= np.bitwise_or.reduceat(part << off, first)
            over = off + U(bits) > U(64)
            low[word[over] + 1] |= part[over] >> (U(64) - off[over])
        return {f"{name}.size": np.array([n, bits, base]), f"{name}.low": low, f"{name}.high": high, f"{name}.ones": (np.cumsum(count) - count)}

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        place = i * self.bits
        word, off = place >> 6, (place & 63).view(np.uint64)
        value = self.low.take(word) >> off
        value |= (self.low.take(word + 1) << U(1)) << (U(63) - off)  # nothing where off is 0
        value &= U((1 << self.bits) - 1)
        return value

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        high = word * 64 + _select_in_word(self.high[word], i - self.ones[word]) - i
        return ((high.astype(np.uint64) << U(self.bits)) | self.lows(i)).astype(np.int64) + self.base

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of entries whose high part is below h, and at most h."""
        r = np.maximum(h - 1, 0)
        word = np.searchsorted(self.zeros, r, side="right") - 1
        at = word * 64 + _select_in_word(~self.high.take(word), r - self.zeros.take(word)) + 1
        at[h == 0] = 0
        low = at - h
        # the bucket's entries are the set bits from here on
        word, off = at >> 6, (at & 63).view(np.uint64)
        window = ~((self.high.take(word) >> off) | ((self.high.take(word + 1, mode="clip") << U(1)) << (U(63) - off)))
        high = low + np.bitwise_count((window & (~window + U(1))) - U(1))
        far = np.flatnonzero(window == 0)
        if len(far):
            r = h[far]
            word = np.searchsorted(self.zeros, r, side="right") - 1
            high[far] = word * 64 + _select_in_word(~self.high.take(word), r - self.zeros.take(word)) - r
        return np.minimum(low, self.n), np.minimum(high, self.n)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first entry >= x, whether it equals x); neighbouring x are found fastest."""
        x = x - self.base
        last_high = len(self.high) * 64 - self.n  # no entry has a high part beyond
        h = x >> self.bits
        beyond = h > last_high - 2
        low, end = self._bucket(np.clip(h, 0, last_high - 2))
        wanted = x.view(np.uint64) & U((1 << self.bits) - 1)
        open_ = np.flatnonzero(low < end)
        a, z, target = low[open_], end[open_], wanted[open_]
        while len(open_):
            mid = (a + z) >> 1
            less = self.lows(mid) < target
            a, z = np.where(less, mid + 1, a), np.where(less, z, mid)
            low[open_] = a
            on = np.flatnonzero(a < z)
            open_, a, z, target = open_[on], a[on], z[on], target[on]
        low[beyond] = self.n
        before = x < 0
        low[before] = 0
        hit = (low < end) & ~(beyond | before)
        some = np.flatnonzero(hit)
        hit[some] = self.lows(low[some]) == wanted[some]
        return low, hit


# ---- runs of counts ----

def squeeze(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.zeros((8, len(a)), dtype=np.uint8)
    v = a.astype(np.int64).view(np.uint64)
    for k in range((int(v.max(initial=0)).bit_length() + 7) // 8):
        planes[k] = v >> U(8 * k)
    return len(a).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return EMPTY
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), dtype=np.uint8).reshape(8, n).T.copy().view("<i8").ravel()


def tally(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) in order with their summed counts."""
    if not len(a):
        return a, b, n
    width = int(b.max()) + 1
    if (int(a.max()) + 1) * width < 1 << 62:
        order = np.argsort(a * width + b)
    else:
        order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(n, first)


def counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) in order with their numbers: plain values are sorted, not positions."""
    width = int(b.max(initial=0)) + 1
    if (int(a.max(initial=0)) + 1) * width >= 1 << 62:
        return tally(a, b, np.ones(len(a), dtype=np.int64))
    key = a * width + b
    key.sort()
    first = np.flatnonzero(_changes(key))
    key = key[first]
    a = key // width
    return a, key - a * width, np.diff(first, append=len(b))


def _changes(a: np.ndarray) -> np.ndarray:
    """Whether each entry differs from the one before."""
    out = np.ones(len(a), dtype=bool)
    np.not_equal(a[1:], a[:-1], out=out[1:])
    return out


def _pieces(shard: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of sorted rows, one per shard (``shard`` rises)."""
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else EMPTY
    out = []
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(shard)]):
        parts = [squeeze(np.diff(columns[0][a:z], prepend=0)), *(squeeze(c[a:z]) for c in columns[1:])]
        out.append(b"".join(len(p).to_bytes(8, "little") + p for p in parts))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32)), pa.array(out, pa.binary())], ["shard", "data"])


def _gather(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    held: list[list[np.ndarray]] = [[] for _ in range(columns)]
    for blob in blobs:
        at = 0
        for k in range(columns):
            n = int.from_bytes(blob[at : at + 8], "little")
            a = unsqueeze(blob[at + 8 : at + 8 + n])
            held[k].append(np.cumsum(a) if k == 0 else a)
            at += 8 + n
    return [np.concatenate(x) if x else EMPTY for x in held]


# ---- the trie ----

#: bytes of the words that are hashed as a table; longer ones one by one
LANES = 32


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: eight bytes of all words at a time, each lane mixed by steps that lose nothing."""
    words = pa.concat_arrays([words.cast(pa.large_string())])
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(at)
    raw = np.zeros(int(at[-1]) + LANES, dtype=np.uint8)
    if data is not None:
        raw[: int(at[-1])] = np.frombuffer(data, dtype=np.uint8)[: int(at[-1])]
    out = np.empty(len(words), dtype=np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(raw, LANES)
    short = np.flatnonzero(size <= LANES)
    for k in range(0, len(short), PART):
        rows = short[k : k + PART]
        table = windows[at[:-1][rows]]
        table[np.arange(LANES) >= size[rows][:, None]] = 0
        lanes = table.view(np.uint64)
        h = size[rows].astype(np.uint64) * U(0x9E3779B97F4A7C15)
        for lane in range(LANES // 8):
            x = lanes[:, lane] * U(0xC2B2AE3D27D4EB4F)
            x ^= x >> U(29)
            h ^= x * U(0x165667B19E3779F9)
            h = ((h << U(27)) | (h >> U(37))) * U(0x9E3779B185EBCA87) + U(0x85EBCA77C2B2AE63)
        h ^= h >> U(33)
        h *= U(0xC2B2AE3D27D4EB4F)
        h ^= h >> U(29)
        h *= U(0x165667B19E3779F9)
        out[rows] = h ^ (h >> U(32))
    for i in np.flatnonzero(size > LANES).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[at[i] : at[i + 1]].tobytes())
    return out


class Tokens:
    """Tokens of some texts: ``codes`` index ``hashes``, which rise, as ids of known words do."""

    def __init__(self, texts: pa.Array):
        w = space_words(texts)
        n = len(w.values)
        words = np.append(word_hashes(w.values), word_hashes(pa.array([""], pa.large_string())))
        words >>= U(64 - HASH_BITS)
        order = np.argsort(words)
        self.hashes = words[order].view(np.int64)
        rank = np.empty(n + 1, dtype=np.int64)
        rank[order] = np.arange(n + 1)
        self.offsets = w.offsets + np.arange(len(w.offsets))
        word = np.ones(len(w.ids) + len(w.offsets) - 1, dtype=bool)
        word[self.offsets[1:] - 1] = False
        self.codes = np.full(len(word), rank[n], dtype=np.int64)
        self.codes[word] = rank[w.ids]
        self.start = np.zeros(len(self.codes) + 1, dtype=bool)
        self.start[self.offsets] = True


_open: dict = {}


class Trie:
    """The mapped files of a model; ``meta`` has the folder, sizes of shards and discounts."""

    def __init__(self, meta: dict):
        self.meta, self.files = meta, {}
        self.N, self.V = meta["N"], meta["V"]

    @staticmethod
    def of(meta: dict) -> Trie:
        key = meta["folder"]
        if _open.get("folder") != key:
            _open.clear()
            _open.update(folder=key, files={})
        trie = Trie(meta)
        trie.files = _open["files"]
        return trie

    def level(self, name: str, shard: int, *sequences: str) -> dict:
        key = (name, shard)
        if key not in self.files:
            arrays = unpack_arrays(map_file(f"{self.meta['folder']}/{name}-{shard:06d}.bin"))
            self.files[key] = arrays | {s: EliasFano(arrays, s) for s in sequences}
        return self.files[key]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, count, tokens of smaller ids) of words, best in order."""
        ids, count, before = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        parts, first, tokens = self.meta["parts1"], self.meta["first1"], self.meta["tokens1"]
        for s, rows in _by_shard(word_shard(hashes, parts), np.arange(len(hashes))):
            if first[s + 1] == first[s]:
                continue
            f = self.level("l1", s, "hash", "run")
            at, hit = f["hash"].find(hashes[rows])
            rows, at = rows[hit], at[hit]
            run = f["run"][at]
            prior = np.where(at > 0, f["run"][np.maximum(at - 1, 0)], 0)
            ids[rows], count[rows], before[rows] = first[s] + at, run - prior, tokens[s] + prior
        return ids, count, before

    def pairs(self, ids: np.ndarray, count: np.ndarray, before: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in level 2 or -1, frequency a2) of word pairs, best in order; a and b index the words."""
        at, freq = np.full(len(a), -1, dtype=np.int64), np.zeros(len(a))
        some = np.flatnonzero((ids[a] >= 0) & (ids[b] >= 0))
        shard = pair_shard(before[a[some]], count[a[some]], ids[b[some]], self.V, self.N, self.meta["parts2"])
        first = self.meta["first2"]
        for s, rows in _by_shard(shard, some):
            if first[s + 1] == first[s]:
                continue
            f = self.level("l2", s, "ids", "ptr")
            low, high = f["range"]
            u = ids[a[rows]]
            rows = rows[(u >= low) & (u <= high)]
            for k in range(0, len(rows), PART):
                r = rows[k : k + PART]
                i, hit = f["ids"].find((ids[a[r]] - low) * self.V + ids[b[r]])
                r, i = r[hit], i[hit]
                at[r] = first[s] + i
                if "scale" in self.meta:
                    freq[r] = self.meta["scale"][self.level("p2", s)["freq"][i]]
        return at, freq

    def successors(self, ids: np.ndarray, count: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first position in level 2, number) of the successors of words."""
        bounds = []
        for second, after in ((0, 0), (self.V - 1, 1)):
            out = np.zeros(len(ids), dtype=np.int64)
            some = np.flatnonzero(ids >= 0)
            shard = pair_shard(before[some], count[some], np.full(len(some), second), self.V, self.N, self.meta["parts2"])
            for s, rows in _by_shard(shard, some):
                n = self.meta["first2"][s + 1] - self.meta["first2"][s]
                here = np.zeros(len(rows), dtype=np.int64)
                if n:
                    f = self.level("l2", s, "ids", "ptr")
                    low, high = f["range"]
                    u = ids[rows] + after
                    here[u > high] = n
                    inside = (u > low) & (u <= high)
                    here[inside] = f["ptr"][u[inside] - low]
                out[rows] = self.meta["first2"][s] + here
            bounds.append(out)
        return bounds[0], bounds[1] - bounds[0]

    def triples(self, parent: np.ndarray, relative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a3, b3) of successors (by position relative to the context) of word pairs (by position in level 2)."""
        first = self.meta["first2"]
        width = int(relative.max(initial=0)) + 2
        if (int(parent.max(initial=0)) + 1) * width < 1 << 62:
            order = np.argsort(parent * width + relative)  # neighbours in the trie are looked up together
        else:
            order = np.lexsort((relative, parent))
        parents, relatives = parent[order], relative[order]
        once = np.flatnonzero(_changes(parents) | _changes(relatives))
        freq, back = np.zeros(len(once)), np.ones(len(once))  # of distinct triples
        shard = np.searchsorted(first, parents[once], side="right") - 1
        for s, rows in _by_shard(shard, np.arange(len(once))):
            f, p = self.level("l3", s, "ids", "ptr"), self.level("p3", s)
            for k in range(int(rows[0]), int(rows[-1]) + 1, PART):
                part = slice(k, min(k + PART, int(rows[-1]) + 1))
                j = parents[once[part]] - first[s]
                new = _changes(j)
                times = np.diff(np.flatnonzero(new), append=len(j))
                j = j[new]  # a context's successors are located once for all its tokens
                a, z = f["ptr"][j], f["ptr"][j + 1]
                back[part] = np.repeat(self.meta["scale"][p["back"][j]], times)
                base = np.full(len(j), -1, dtype=np.int64)
                some = np.flatnonzero(z > a)
                base[some] = 0
                some = some[a[some] > 0]
                base[some] = f["ids"][a[some] - 1] + 1
                base, z = np.repeat(base, times), np.repeat(z, times)
                rel = relatives[once[part]]
                open_ = np.flatnonzero((base >= 0) & (rel >= 0))
                i, hit = f["ids"].find(base[open_] + rel[open_])
                hit &= i < z[open_]
                freq[k + open_[hit]] = self.meta["scale"][p["freq"][i[hit]]]
        times = np.diff(once, append=len(order))
        out = np.empty(len(order)), np.empty(len(order))
        out[0][order], out[1][order] = np.repeat(freq, times), np.repeat(back, times)
        return out


def _shard_order(shard: np.ndarray) -> np.ndarray:
    """Stable order by shard; small numbers sort by radix."""
    return np.argsort(shard.astype(np.int16) if len(shard) and shard.max() < 1 << 15 else shard, kind="stable")


def _by_shard(shard: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if (shard[1:] < shard[:-1]).any():
        order = _shard_order(shard)
        shard, rows = shard[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else EMPTY
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(shard)]):
        yield int(shard[a]), rows[a:z]


def word_shard(hashes: np.ndarray, parts: int) -> np.ndarray:
    return np.minimum((hashes / float(1 << HASH_BITS) * parts).astype(np.int64), parts - 1)


def pair_shard(before: np.ndarray, count: np.ndarray, second: np.ndarray, vocabulary: int, tokens: int, parts: int) -> np.ndarray:
    """Shard of a word pair: its first word's share of all tokens, cut evenly by the second word; rises with the pair."""
    return np.minimum(((before + count * (second / vocabulary)) / tokens * parts).astype(np.int64), parts - 1)


class _Held:
    """Counts a task holds until they are sent."""

    def __init__(self, columns: int):
        self.rows: list[list[np.ndarray]] = [[] for _ in range(columns)]
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        for r, c in zip(self.rows, columns):
            r.append(c)
        self.size += len(columns[0])

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(r) if r else EMPTY for r in self.rows]
        self.rows, self.size = [[] for _ in self.rows], 0
        return out


def _sizes(runs: DataFrame, reduce, kind: str) -> list:
    """Reduce each shard's runs and collect one row of sizes per shard."""
    return runs.groupBy("shard").applyInArrow(reduce, kind).orderBy("shard").collect()


def _starts(rows: list, parts: int, field: str) -> np.ndarray:
    n = np.zeros(parts + 1, dtype=np.int64)
    for r in rows:
        n[r["shard"] + 1] = r[field]
    return np.cumsum(n)


def _level1(training: DataFrame, folder: str, parts: int) -> dict:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(2)

        def send() -> Iterator[pa.RecordBatch]:
            h, n = held.take()
            h, _, n = tally(h, np.zeros(len(h), dtype=np.int64), n)
            yield from _pieces(word_shard(h, parts), h, n)

        for b in text_slices(batches, "text", SLICE):
            t = Tokens(b.column("text"))
            n = np.bincount(t.codes, minlength=len(t.hashes))
            held.add(t.hashes[n > 0], n[n > 0])
            if held.size > HELD:
                yield from send()
        yield from send()

    def reduce(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        h, n = _gather(table["data"].to_pylist(), 2)
        h, _, n = tally(h, np.zeros(len(h), dtype=np.int64), n)
        put_file(f"{folder}/l1-{shard:06d}.bin", pack_arrays(EliasFano.pack(h, "hash") | EliasFano.pack(np.cumsum(n), "run")))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(h)], "tokens": [int(n.sum())]})

    rows = _sizes(training.mapInArrow(run, RUNS), reduce, "shard int, n long, tokens long")
    first, tokens = _starts(rows, parts, "n"), _starts(rows, parts, "tokens")
    return {"folder": folder, "parts1": parts, "first1": first, "tokens1": tokens, "V": int(first[-1]), "N": int(tokens[-1])}


def _write_ids(name: str, parent: np.ndarray, child: np.ndarray, parents: int, monotone: np.ndarray, extra: dict[str, np.ndarray]) -> None:
    pointers = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=parents))])
    put_file(name, pack_arrays(EliasFano.pack(monotone, "ids") | EliasFano.pack(pointers, "ptr") | extra))


def _level2(training: DataFrame, meta: dict) -> list:
    vocabulary, tokens, parts, folder = meta["V"], meta["N"], meta["parts2"], meta["folder"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held = Trie.of(meta), _Held(4)

        def send() -> Iterator[pa.RecordBatch]:
            a, b, n, shard = held.take()
            for s, rows in _by_shard(shard, np.arange(len(shard))):
                x, y, m = tally(a[rows], b[rows], n[rows])
                yield from _pieces(np.full(len(x), s), x, y, m)

        for batch in text_slices(batches, "text", SLICE):
            t = Tokens(batch.column("text"))
            ids, count, before = trie.words(t.hashes)
            two = np.flatnonzero(~t.start[1:-1]) + 1
            a, b, n = counted(t.codes[two - 1], t.codes[two])
            held.add(ids[a], ids[b], n, pair_shard(before[a], count[a], ids[b], vocabulary, tokens, parts))
            if held.size > HELD:
                yield from send()
        yield from send()

    def reduce(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        a, b, n = tally(*_gather(table["data"].to_pylist(), 3))
        low, high = int(a[0]), int(a[-1])
        _write_ids(f"{folder}/l2-{shard:06d}.bin", a - low, b, high - low + 1, (a - low) * vocabulary + b, {"range": np.array([low, high])})
        put_file(f"{folder}/c2-{shard:06d}.bin", squeeze(n))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(a)], "n1": [int((n == 1).sum())], "n2": [int((n == 2).sum())]})

    return _sizes(training.mapInArrow(run, RUNS), reduce, "shard int, n long, n1 long, n2 long")


def _level3(training: DataFrame, meta: dict) -> list:
    first, folder = meta["first2"], meta["folder"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held = Trie.of(meta), _Held(3)

        def send() -> Iterator[pa.RecordBatch]:
            g, r, n = tally(*held.take())
            yield from _pieces(np.searchsorted(first, g, side="right") - 1, g, r, n)

        for batch in text_slices(batches, "text", SLICE):
            t = Tokens(batch.column("text"))
            pair, relative, _ = _contexts(trie, t)
            three = np.flatnonzero(~t.start[1:-1] & ~t.start[:-2]) + 1
            held.add(*counted(pair[three - 1], relative[three]))
            if held.size > HELD:
                yield from send()
        yield from send()

    def reduce(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        g, r, n = tally(*_gather(table["data"].to_pylist(), 3))
        j = g - first[shard]
        last = np.flatnonzero(np.concatenate([j[1:] != j[:-1], [True]]))
        base = np.zeros(len(last), dtype=np.int64)
        base[1:] = np.cumsum(r[last] + 1)[:-1]  # a parent's ids start behind the last one of the parent before
        values = r + np.repeat(base, np.diff(np.concatenate([[-1], last])))
        _write_ids(f"{folder}/l3-{shard:06d}.bin", j, r, int(first[shard + 1] - first[shard]), values, {})
        put_file(f"{folder}/c3-{shard:06d}.bin", squeeze(n))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(g)], "n1": [int((n == 1).sum())], "n2": [int((n == 2).sum())]})

    return _sizes(training.mapInArrow(run, RUNS), reduce, "shard int, n long, n1 long, n2 long")


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the position of each value among them."""
    order = np.argsort(values)
    found = values[order]
    new = _changes(found)
    rank = np.empty(len(values), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    return found[new], rank


def _contexts(trie: Trie, t: Tokens) -> tuple[np.ndarray, np.ndarray, dict]:
    """Per token: position in level 2 of (token before, token) and that position among the successors of the token before (-1:
    unknown or the first token), and what scoring needs."""
    ids, count, before = trie.words(t.hashes)
    two = np.flatnonzero(~t.start[1:-1]) + 1
    key, inverse = distinct(t.codes[two - 1] * len(t.hashes) + t.codes[two])
    a = key // len(t.hashes)
    b = key - a * len(t.hashes)
    at, freq = trie.pairs(ids, count, before, a, b)
    head, degree = trie.successors(ids, count, before)
    pair, relative, a2 = (np.full(len(t.codes), -1, dtype=np.int64) for _ in range(3))
    pair[two] = at[inverse]
    relative[two] = np.where(at >= 0, at - head[a], -1)[inverse]
    a2 = np.zeros(len(t.codes))
    a2[two] = freq[inverse]
    return pair, relative, {"ids": ids, "count": count, "degree": degree, "a2": a2, "two": two}


def _finish(spark: SparkSession, meta: dict, have3: set) -> None:
    """Quantise frequencies and back-off masses of all shards."""
    first, folder, scale_low, d2, d3 = meta["first2"], meta["folder"], meta["low"], meta["d2"], meta["d3"]

    def code(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.clip(np.rint(255 + np.log10(np.maximum(p, 1e-300)) / -scale_low * 254), 1, 255), 0).astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie.of(meta)
        for batch in batches:
            for s in batch.column("shard").to_pylist():
                m = int(first[s + 1] - first[s])
                n = unsqueeze(map_file(f"{folder}/c2-{s:06d}.bin").tobytes())
                f = trie.level("l2", s, "ids", "ptr")
                low, high = (int(x) for x in f["range"])
                total = _counts_of(trie, np.arange(low, high + 1))
                pointers = f["ptr"][np.arange(high - low + 2)]
                put_file(f"{folder}/p2-{s:06d}.bin", pack_arrays({"freq": code((n - d2) / np.repeat(total, np.diff(pointers)))}))
                if s in have3:
                    n = unsqueeze(map_file(f"{folder}/c3-{s:06d}.bin").tobytes())
                    pointers = trie.level("l3", s, "ids", "ptr")["ptr"][np.arange(m + 1)]
                    sums, degree = segment_sums(n, pointers), np.diff(pointers)
                    back = np.where(degree > 0, d3 * degree / np.maximum(sums, 1), 1.0)
                    freq = code((n - d3) / np.repeat(sums, degree))
                else:
                    put_file(f"{folder}/l3-{s:06d}.bin", pack_arrays(EliasFano.pack(EMPTY, "ids") | EliasFano.pack(np.zeros(m + 1, dtype=np.int64), "ptr")))
                    back, freq = np.ones(m), EMPTY.astype(np.uint8)
                put_file(f"{folder}/p3-{s:06d}.bin", pack_arrays({"freq": freq, "back": code(back)}))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], ["shard"])

    shards = [(int(s),) for s in np.flatnonzero(np.diff(first))]
    if shards:
        spark.createDataFrame(shards, "shard int").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "shard int").count()


def _counts_of(trie: Trie, ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), dtype=np.int64)
    first = trie.meta["first1"]
    for s, rows in _by_shard(np.searchsorted(first, ids, side="right") - 1, np.arange(len(ids))):
        run = trie.level("l1", s, "hash", "run")["run"]
        at = ids[rows] - first[s]
        out[rows] = run[at] - np.where(at > 0, run[np.maximum(at - 1, 0)], 0)
    return out


def discount(rows: list) -> float:
    n1, n2 = sum(r["n1"] for r in rows), sum(r["n2"] for r in rows)
    return n1 / (n1 + 2 * n2) if n1 else 0.5


def build(training: DataFrame) -> dict:
    """Count all n-grams of ``training`` (column ``text``) and write the trie; returns its description."""
    spark = training.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = training.select("text")
    meta = _level1(text, shared_path(spark, "ngrams"), parts)
    if not meta["N"]:
        return meta
    meta["parts2"] = max(1, -(-meta["N"] // SHARD_TOKENS))
    rows = _level2(text, meta)
    meta["first2"], meta["d2"] = _starts(rows, meta["parts2"], "n"), discount(rows)
    rows = _level3(text, meta)
    meta["d3"] = discount(rows)
    meta["low"] = -float(np.log10(meta["N"])) - 1
    _finish(spark, meta, {r["shard"] for r in rows})
    meta["scale"] = np.concatenate([[0.0], 10 ** ((255 - np.arange(1, 256)) / 254 * meta["low"])])
    return meta


def score_texts(meta: dict, texts: pa.Array) -> dict[str, np.ndarray]:
    t = Tokens(texts)
    n = len(t.codes)
    if not meta["N"]:
        p1, known, p = np.ones(n), np.zeros(n, dtype=np.int64), np.ones(n)
        return {"n_tokens": np.diff(t.offsets), "n_known": segment_sums(known, t.offsets), "base": segment_sums(np.log10(p1), t.offsets), "score": segment_sums(np.log10(p), t.offsets)}
    trie = Trie.of(meta)
    pair, relative, c = _contexts(trie, t)
    uni = (c["count"] + 0.5) / (meta["N"] + 0.5 * (meta["V"] + 1))
    p1 = uni[t.codes]
    p = p1.copy()
    two = c["two"]
    context = t.codes[two - 1]
    free = np.where((c["count"] > 0) & (c["degree"] > 0), meta["d2"] * c["degree"] / np.maximum(c["count"], 1), 1.0)
    p[two] = c["a2"][two] + free[context] * p1[two]
    three = np.flatnonzero(~t.start[1:-1] & ~t.start[:-2]) + 1
    three = three[pair[three - 1] >= 0]
    a3, b3 = trie.triples(pair[three - 1], relative[three])
    p[three] = a3 + b3 * p[three]
    known = (c["count"] > 0)[t.codes]
    return {
        "n_tokens": np.diff(t.offsets), "n_known": segment_sums(known, t.offsets), "base": segment_sums(np.log10(p1), t.offsets),
        "score": segment_sums(np.log10(p), t.offsets),
    }


def score(documents: DataFrame, meta: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text", SLICE):
            s = score_texts(meta, b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s["n_tokens"]), pa.array(s["n_known"]), pa.array(np.full(b.num_rows, meta["N"])), pa.array(s["base"]), pa.array(s["score"])],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out: Column = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = score(documents, build(documents.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
