"""Ranked lexical search: the best documents for each query, by accumulator-limited term-at-a-time evaluation.

Scores are integers: a term's weight falls with the number of documents that hold it, its impact in a document grows with
its occurrences and falls with the document's length (see ``weights`` and ``impacts``); a score sums weight x impact over
the query's terms, repeats included.

1. Queries become (item, term, count) rows, dealt by item into blocks of about ``BLOCK_BYTES`` of query text; a task writes
   each block to the shared folder. Neither the driver nor a task holds all queries.
2. A pass over the documents for each block counts them, their terms, and the documents that hold each of its terms.
   Sums go to a second file beside each block. Only two totals and the blocks' numbers reach the driver.
3. A second pass ranks, for each block apart, so a task holds one block. It inverts a slice of texts into postings of the
   block's terms and evaluates each query over them: rarest term first; each posting adds to its document's accumulator;
   as soon as the best that all remaining terms together could give a document is below the k-th partial score (of this
   slice, or of what the task has kept from earlier ones), no accumulator is made any more, since such a document cannot
   reach the best k; documents that have one are still updated by all remaining terms, so their scores are exact.
4. Tasks give their k best for each query; a window limited to k per (query, group of tasks), then per query, ends it.

No postings are shuffled, nothing is cut: every document and every term counts. Documents: null text has no terms; rows with
the same ``doc_id`` are documents of their own; null ``doc_id`` is the smallest in ties. Queries: null text has no terms;
rows with the same ``item_id`` (null too) are one item with the terms of all of them. Items without a hit have no rows.
A very long text is a slice of its own. Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import SLICE_BYTES, Words, alnum_words, map_file, put_file, shared_path, stored, text_slices

K = 10
BLOCK_BYTES = 16 << 20
#: the tasks' results for a query meet in so many groups before they meet in one
GROUPS = 32
_NULL = np.iinfo(np.int64).min


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """Weight of terms that ``df`` documents hold: floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return np.floor(1000.0 * np.log((2.0 * documents + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def lengths_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A document's length against the mean, in percent, moved a quarter towards 100."""
    return 25 + (75 * n * documents) // max(total, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# ---- queries ----

def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term, n) of all queries."""
    item = queries.schema["item_id"].dataType
    kind = T.StructType([T.StructField("item_id", item), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            w = alnum_words(b.column("text"))
            key, n = np.unique(np.repeat(np.arange(b.num_rows), w.counts) * max(len(w.values), 1) + w.ids, return_counts=True)
            row, word = np.divmod(key, max(len(w.values), 1))
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(row)), w.values.take(pa.array(word)).cast(pa.string()), pa.array(n)], ["item_id", "term", "n"])

    return queries.select("item_id", "text").mapInArrow(run, kind).groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(uri: str) -> pa.Table:
    return pa.ipc.open_file(pa.py_buffer(map_file(uri))).read_all()


def write_blocks(queries: DataFrame, folder: str, block_bytes: int) -> list[int]:
    """Write ``items-<block>`` files of (item_id, term, n), ordered by item; the blocks' numbers."""
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = size // block_bytes + 1

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.select(["item_id", "term", "n"]).sort_by([("item_id", "ascending"), ("term", "ascending")])
        put_file(f"{folder}/items-{key[0].as_py()}", _packed(rows.combine_chunks()))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32())})

    dealt = query_terms(queries).withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(number)).cast("int"))
    return sorted(r["block"] for r in stored(dealt.groupBy("block").applyInArrow(run, "block int"), "query-blocks").collect())


class Block:
    """The items of a block: ``words`` (distinct terms), and of item i the codes[at[i]:at[i + 1]] with counts n."""

    def __init__(self, folder: str, number: int):
        t = _unpacked(f"{folder}/items-{number}").combine_chunks()
        coded = t.column("term").combine_chunks().dictionary_encode()
        self.words = coded.dictionary.cast(pa.large_string())
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.n = t.column("n").to_numpy()
        item = t.column("item_id").combine_chunks()
        same = pc.equal(item[1:], item[:-1]).fill_null(False).to_numpy(zero_copy_only=False) if len(item) > 1 else np.zeros(0, dtype=bool)
        null = pc.is_null(item).to_numpy(zero_copy_only=False)
        change = ~(same | (null[1:] & null[:-1]))
        self.at = np.concatenate([[0], np.flatnonzero(change) + 1, [len(item)]])
        self.items = item.take(pa.array(self.at[:-1]))

    def postings(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, document, occurrences), ordered by code, then document."""
        docs = np.repeat(np.arange(len(words.counts)), words.counts)
        code = pc.fill_null(pc.index_in(words.values, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[words.ids]
        known = code >= 0
        key, tf = np.unique(code[known] * len(words.counts) + docs[known], return_counts=True)
        term, doc = np.divmod(key, max(len(words.counts), 1))
        return term, doc, tf.astype(np.int64)


# ---- statistics ----

def write_weights(documents: DataFrame, folder: str, blocks: list[int]) -> tuple[int, int]:
    """Write ``weights-<block>`` files of (code, n), n documents holding the term; returns (documents with a term, their terms)."""
    kind = "block int, code int, n long"

    def counter(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, df, count, total = Block(folder, number), 0, 0, 0
            for b in text_slices(batches, "text"):
                w = alnum_words(b.column("text"))
                count += int((w.counts > 0).sum())
                total += len(w.ids)
                df += np.bincount(block.postings(w)[0], minlength=len(block.words))
            code = np.flatnonzero(df)
            yield _columns(kind, [np.full(len(code), number), code, df[code]] if len(code) else [[], [], []])
            if number == blocks[0]:
                yield _columns(kind, [[-1, -1], [0, 1], [count, total]])

        return run

    texts = documents.select("text")
    counted = reduce(DataFrame.unionByName, [texts.mapInArrow(counter(k), kind) for k in blocks])
    sums = stored(counted.groupBy("block", "code").agg(F.sum("n").alias("n")), "query-terms")

    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        put_file(f"{folder}/weights-{key[0].as_py()}", _packed(table.select(["code", "n"]).combine_chunks()))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32())})

    stored(sums.where("block >= 0").groupBy("block").applyInArrow(write, "block int"), "query-weights")
    totals = {r["code"]: r["n"] for r in sums.where("block < 0").collect()}
    return totals.get(0, 0), totals.get(1, 0)


def _columns(kind: str, columns: list) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in kind.split(", ")))
    as_arrow = {"int": pa.int32(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, as_arrow[t]) for c, t in zip(columns, types)], list(names))


# ---- ranking ----

class Ranker:
    """The best k of a task's documents for each item of a block."""

    def __init__(self, folder: str, number: int, documents: int, total: int, k: int):
        self.block, self.documents, self.total, self.k = Block(folder, number), documents, total, k
        try:
            t = _unpacked(f"{folder}/weights-{number}")
            code, n = t.column("code").to_numpy(), t.column("n").to_numpy()
        except FileNotFoundError:  # no document holds a term of the block
            code = n = np.zeros(0, dtype=np.int64)
        df = np.zeros(len(self.block.words), dtype=np.int64)
        df[code] = n
        weight = np.where(df > 0, weights(df, documents), 0)
        self.terms: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(self.block.at, self.block.at[1:]):
            codes = self.block.codes[a:b]
            use = np.flatnonzero(weight[codes] > 0)
            use = use[np.argsort(df[codes[use]], kind="stable")]  # rarest first
            self.terms.append((codes[use], weight[codes[use]] * self.block.n[a:b][use]))
        self.scores = [np.zeros(0, dtype=np.int64) for _ in self.terms]
        self.docs = [np.zeros(0, dtype=np.int64) for _ in self.terms]

    def add(self, words: Words, ids: np.ndarray) -> None:
        """Rank the documents of a slice; ``ids``: their numbers."""
        term, doc, tf = self.block.postings(words)
        if len(term) == 0:
            return
        impact = impacts(tf, lengths_norm(words.counts.astype(np.int64), self.documents, self.total)[doc])
        begin = np.searchsorted(term, np.arange(len(self.block.words) + 1))
        best = np.zeros(len(self.block.words), dtype=np.int64)
        held = np.flatnonzero(begin[1:] > begin[:-1])
        best[held] = np.maximum.reduceat(impact, begin[held])
        totals = np.zeros(len(ids), dtype=np.int64)
        for i, (codes, factor) in enumerate(self.terms):
            here = best[codes] > 0
            if here.any():
                self._item(i, codes[here], factor[here], doc, impact, begin, best, totals, ids)

    def _item(self, i, codes, factor, doc, impact, begin, best, totals, ids) -> None:
        bound = factor * best[codes]
        left = np.cumsum(bound[::-1])[::-1]  # what the terms from here on can give a document at most
        floor = int(self.scores[i][-1]) if len(self.scores[i]) == self.k else 0
        if left[0] < floor:
            return
        totals[:] = 0
        making = True
        for code, f, rest in zip(codes.tolist(), factor.tolist(), left.tolist()):
            at, gain = doc[begin[code] : begin[code + 1]], impact[begin[code] : begin[code + 1]] * f
            # k partial scores above what is left: the k-th of them is, so a document without an accumulator cannot reach it
            if making and (rest < floor or np.count_nonzero(totals > rest) >= self.k):
                making = False
            if making:
                totals[at] += gain
            else:
                old = totals[at] > 0
                totals[at[old]] += gain[old]
        found = np.flatnonzero(totals >= max(floor, 1))
        if len(found) > self.k:
            found = found[totals[found] >= np.partition(totals[found], len(found) - self.k)[len(found) - self.k]]
        score, number = np.concatenate([self.scores[i], totals[found]]), np.concatenate([self.docs[i], ids[found]])
        top = np.lexsort((number, -score))[: self.k]
        self.scores[i], self.docs[i] = score[top], number[top]

    def rows(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        items = self.block.items.take(pa.array(np.repeat(np.arange(len(self.terms)), [len(s) for s in self.scores])))
        return items, np.concatenate([np.zeros(0, dtype=np.int64), *self.docs]), np.concatenate([np.zeros(0, dtype=np.int64), *self.scores])


def search(documents: DataFrame, queries: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query with a score above 0."""
    spark = documents.sparkSession
    folder = shared_path(spark, "queries")
    blocks = write_blocks(queries, folder, block_bytes)
    if not blocks:  # no query has a term
        return spark.createDataFrame([], T.StructType([queries.schema["item_id"], *T._parse_datatype_string("rank int, doc_id long, score long").fields]))
    count, total = write_weights(documents, folder, blocks)
    item = queries.schema["item_id"].dataType
    kind = T.StructType([T.StructField("item_id", item), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("part", T.IntegerType())])

    def ranker(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranking = Ranker(folder, number, count, total, k)
            for b in text_slices(batches, "text", slice_bytes):
                ranking.add(alnum_words(b.column("text")), pc.fill_null(b.column("doc_id"), int(_NULL)).to_numpy(zero_copy_only=False))
            items, found, score = ranking.rows()
            part = pa.array(np.full(len(score), TaskContext.get().partitionId() % GROUPS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([items, pa.array(found, mask=found == _NULL), pa.array(score), part], ["item_id", "doc_id", "score", "part"])

        return run

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = reduce(DataFrame.unionByName, [texts.mapInArrow(ranker(n), kind) for n in blocks])
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
postings AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n, term, count(*) AS tf FROM (SELECT rid, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
corpus AS (SELECT count(DISTINCT rid) AS docs, CAST(sum(tf) AS BIGINT) AS total FROM postings),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term) CROSS JOIN corpus),
item_terms AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
    SELECT i.item_id, p.rid, p.doc_id,
        CAST(sum(i.n * weight.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * docs) // total)))) AS BIGINT) AS score
    FROM item_terms i JOIN postings p USING (term) JOIN weight USING (term) CROSS JOIN corpus GROUP BY i.item_id, p.rid, p.doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0
) WHERE rank <= {K}
"""
