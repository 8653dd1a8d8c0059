"""Benchmark decontamination by an FM-index over each training shard.

Windows (10 consecutive item words, or a whole shorter item) are the query set; their vocabulary numbers the symbols. In a
task, runs of document words of that vocabulary that are long enough for the shortest window form the shard's text (no
occurrence can leave such a run). The shard gets a suffix array (prefix doubling), its Burrows-Wheeler transform in a
wavelet matrix with popcount ranks, and suffix positions sampled at every 16th place and at run starts. All windows are
searched backward together; occurrences are located by stepping back to a sample, and merged to spans of document words.

Documents are never shuffled. Tasks build the windows in blocks of about ``BLOCK_BYTES`` of item text and write them to the
shared folder; a search task reads one block after another, so neither the driver nor a worker holds the benchmark, however
it grows. An item goes to one block; equal items go once.

Null or empty text: no words, not contaminated. Items without words have no window. Repeated documents: a row each.
Repeated item_ids: their windows are united. Null item_id: searched, but not listed. No benchmark: nothing is hit.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import alnum_words, bits_of, map_file, put_file, ragged, segment_sums, shared_path, stored, text_slices

WINDOW = 10
SAMPLE = 16
#: symbols of a shard's text; longer runs are cut with an overlap
SHARD = 1 << 20
BLOCK_BYTES = 8 << 20

RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>"


class Ranks:
    """Counts of set bits before a position."""

    def __init__(self, mask: np.ndarray):
        self.words = bits_of(mask)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def __call__(self, at: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Order of all suffixes of ``text`` (symbols 0 and up; 0 separates runs and is smallest, the earlier one first)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(3, dtype=np.int64)])
    second = np.where(text == 0, 0, padded[1 : n + 1])
    third = np.where(second == 0, 0, padded[2 : n + 2])
    key = (text * alphabet + second) * alphabet + third
    low = max(n - 1, 1).bit_length()
    if 3 * (alphabet - 1).bit_length() + low <= 62:
        order = np.sort((key << low) | np.arange(n)) & ((1 << low) - 1)
    else:
        order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    done = third[order] == 0  # a separator was reached: equal ones stay in order of position
    head = np.maximum.accumulate(np.where(new | done, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = head
    step = 3
    while True:
        tie = np.zeros(n, dtype=bool)
        tie[1:] = head[1:] == head[:-1]
        tie[:-1] |= tie[1:]
        at = np.flatnonzero(tie)
        if not len(at):
            return order
        rows = order[at]
        after = rows + step
        follow = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        sort = np.lexsort((follow, head[at]))
        order[at] = rows[sort]
        group, follow = head[at], follow[sort]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        head[at] = np.maximum.accumulate(np.where(new, at, 0))
        rank[order[at]] = head[at]
        step *= 2


class FMIndex:
    """FM-index of a text of symbols (0 separates runs)."""

    def __init__(self, text: np.ndarray, alphabet: int):
        n = len(text)
        order = suffix_array(text, alphabet)
        bwt = text[order - 1]  # the row of position 0 gets the last symbol, which is a separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        start = np.ones(n, dtype=bool)
        start[1:] = text[:-1] == 0
        kept = (start | (np.arange(n) % SAMPLE == 0))[order]
        self.marked, self.marks = Ranks(kept), kept
        self.samples = order[kept]
        self.levels = max(alphabet - 1, 1).bit_length()
        self.planes, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1 == 1
            self.planes.append((Ranks(bit), bit))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol in the transform before row ``at``."""
        low = np.zeros_like(at)
        for level, (ones, _), zeros in zip(range(self.levels - 1, -1, -1), self.planes, self.zeros):
            up = (symbol >> level) & 1 == 1
            a, b = ones(low), ones(at)
            low, at = np.where(up, zeros + a, low - a), np.where(up, zeros + b, at - b)
        return at - low

    def back(self, at: np.ndarray) -> np.ndarray:
        """Row of the suffix one position earlier."""
        symbol, row, low = np.zeros_like(at), at, np.zeros_like(at)
        for (ones, bit), zeros in zip(self.planes, self.zeros):
            up = bit[row]
            symbol = symbol * 2 + up
            a, b = ones(low), ones(row)
            low, row = np.where(up, zeros + a, low - a), np.where(up, zeros + b, row - b)
        return self.first[symbol] + row - low

    def search(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each window; windows are rows of symbols, filled up on the left."""
        low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), self.first[-1], dtype=np.int64)
        live = np.arange(len(windows))
        for k in range(windows.shape[1] - 1, -1, -1):
            live = live[(high[live] > low[live]) & (sizes[live] >= windows.shape[1] - k)]
            symbol = windows[live, k]
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, steps, todo = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            hit = self.marks[rows[todo]]
            there = todo[hit]
            out[there] = self.samples[self.marked(rows[there])] + steps[there]
            todo = todo[~hit]
            rows[todo] = self.back(rows[todo])
            steps[todo] += 1
        return out


class Queries:
    """Distinct windows of some items over the numbered words of those windows (numbers from 1)."""

    def __init__(self, items: list[tuple[str | None, str]], width: int = WINDOW):
        w = alnum_words(pa.array([t for _, t in items], pa.large_string()))
        self.words = w.values.cast(pa.large_string())
        n = w.counts
        per = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        size = np.repeat(np.minimum(n, width), per)
        first = ragged(w.offsets[:-1], per)
        rows = np.zeros((len(first), width), dtype=np.int64)
        for k in range(width):
            some = size > k
            rows[some, width - 1 - k] = w.ids[first[some] + size[some] - 1 - k] + 1
        self.windows, code = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, dtype=np.int64))
        self.sizes = (self.windows > 0).sum(axis=1)
        pairs = np.unique(np.stack([code.reshape(-1), np.repeat(np.arange(len(items)), per)]), axis=1)
        self.items = [i for i, _ in items]
        self.owner = pairs[1]
        self.owners = np.searchsorted(pairs[0], np.arange(len(self.windows) + 1))

    @property
    def shortest(self) -> int:
        return int(self.sizes.min(initial=WINDOW))


def _runs(known: np.ndarray, offsets: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of maximal runs of known words inside a document, at least ``shortest`` long."""
    edge = np.zeros(len(known) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], known[:-1]])
    start = np.flatnonzero(known & (~before | edge[:-1]))
    after = np.concatenate([known[1:], [False]])
    end = np.flatnonzero(known & (~after | edge[1:])) + 1
    keep = end - start >= shortest
    return start[keep], (end - start)[keep]


def occurrences(symbols: np.ndarray, offsets: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(flat word position, window) of every occurrence in documents of symbols (0: a word outside the vocabulary)."""
    start, length = _runs(symbols > 0, offsets, queries.shortest)
    widest = queries.windows.shape[1]
    pieces = np.maximum(1, -(-(length - widest + 1) // SHARD))
    k = ragged(np.zeros(len(start), dtype=np.int64), pieces)
    start, length = np.repeat(start, pieces) + k * SHARD, np.minimum(np.repeat(length, pieces) - k * SHARD, SHARD + widest - 1)
    found_at, found_w = [], []
    shard = (np.cumsum(length + 1) - 1) // (2 * SHARD)
    for s in np.unique(shard):
        a, n = start[shard == s], length[shard == s]
        text_start = np.cumsum(n + 1) - n - 1
        text = np.zeros(int((n + 1).sum()), dtype=np.int64)
        text[ragged(text_start, n)] = symbols[ragged(a, n)]
        index = FMIndex(text, len(queries.words) + 1)
        low, high = index.search(queries.windows, queries.sizes)
        number = np.maximum(high - low, 0)
        at = index.locate(ragged(low, number))
        run = np.searchsorted(text_start, at, side="right") - 1
        found_at.append(a[run] + at - text_start[run])
        found_w.append(np.repeat(np.arange(len(low)), number))
    if not found_at:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_at), np.concatenate(found_w)


def contamination_of(texts: pa.Array, blocks: Iterable[Queries]) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[dict]]]:
    """(words, hit words, item ids, merged spans) of each text."""
    w = alnum_words(texts)
    delta = np.zeros(len(w.ids) + 1, dtype=np.int64)
    doc_of, item_of = [], []
    for number, q in enumerate(blocks):
        if not len(q.windows):
            continue
        code = pc.index_in(w.values, q.words)
        symbols = (pc.fill_null(code, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1)[w.ids]
        at, window = occurrences(symbols, w.offsets, q)
        delta += np.bincount(at, minlength=len(delta)) - np.bincount(at + q.sizes[window], minlength=len(delta))
        doc = np.searchsorted(w.offsets, at, side="right") - 1
        pairs = np.unique(np.stack([doc, window]), axis=1) if len(at) else np.zeros((2, 0), dtype=np.int64)
        n = q.owners[pairs[1] + 1] - q.owners[pairs[1]]
        doc_of += np.repeat(pairs[0], n).tolist()
        item_of += [q.items[i] for i in q.owner[ragged(q.owners[pairs[1]], n)]]
    hit = np.cumsum(delta[:-1]) > 0
    items: list[set] = [set() for _ in range(len(texts))]
    for d, i in zip(doc_of, item_of):
        if i is not None:
            items[d].add(i)
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    start, length = _runs(hit, w.offsets, 1)
    for d, a, n in zip((np.searchsorted(w.offsets, start, side="right") - 1).tolist(), start.tolist(), length.tolist()):
        spans[d].append({"first": a - int(w.offsets[d]), "last": a - int(w.offsets[d]) + n - 1})
    return w.counts, segment_sums(hit, w.offsets), [sorted(x) for x in items], spans


class Blocks:
    """The benchmark's windows, written in blocks; a lone block is kept, of several one is held at a time."""

    def __init__(self, folder: str, numbers: list[int]):
        self.folder, self.numbers, self.held = folder, numbers, None

    def __iter__(self) -> Iterator[Queries]:
        for n in self.numbers:
            if self.held is None or len(self.numbers) > 1:
                self.held = pickle.loads(map_file(f"{self.folder}/windows-{n}").tobytes())
            yield self.held


def _blocks(benchmark: DataFrame, width: int) -> Blocks:
    """Write the benchmark's windows in blocks of about ``BLOCK_BYTES`` of text; only the blocks' numbers reach the driver."""
    folder = shared_path(benchmark.sparkSession, "windows")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    number = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES + 1

    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["item_id"].to_pylist(), table["text"].to_pylist()), key=str)
        put_file(f"{folder}/windows-{key[0].as_py()}", pickle.dumps(Queries(rows, width)))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32())})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(number)).cast("int"))
    return Blocks(folder, sorted(r["block"] for r in stored(dealt.groupBy("block").applyInArrow(write, "block int"), "window-blocks").collect()))


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for every row of ``documents``: items as strings, spans of words from 0."""
    shared = _blocks(benchmark, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(shared.folder, shared.numbers)
        for b in text_slices(batches, "text"):
            words, hits, items, spans = contamination_of(b.column("text"), blocks)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(words), pa.array(hits), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without any occurrence of a window (all columns, decided row by row where the row lies)."""
    shared = _blocks(benchmark, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(shared.folder, shared.numbers)
        for b in text_slices(batches, "text"):
            _, hits, _, _ = contamination_of(b.column("text"), blocks)
            yield b.filter(pa.array(hits == 0))

    return documents.mapInArrow(run, documents.schema)


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

#: the same result from every window of every document, for DuckDB
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, list_slice(w, i, i + {WINDOW - 1}) AS g, least(len(w), {WINDOW}) AS n
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
places AS (SELECT rid, n, i, list_slice(w, i, i + n - 1) AS g
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM win))),
occ AS (SELECT p.rid, p.i, p.n, win.item_id FROM places p JOIN win ON win.g = p.g),
hit AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT rid, i, unnest(range(0, n)) AS k FROM occ) GROUP BY rid),
its AS (
    SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
    coalesce(its.h, sha256('')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.rid = d.rid LEFT JOIN its ON its.rid = d.rid
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
