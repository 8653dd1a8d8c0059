"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance.

Distinct fingerprints are cut into ``radius + 3`` blocks of bits; two within the radius agree on all bits of some choice of
three blocks, so each fingerprint is dealt to a bucket for every choice. Sorted buckets are compared by bit planes: plane p
holds bit p of 64 neighbours in a word, a shift by d lines every fingerprint up with the one d places on, and carry-save
counters add up differing bits for 64 pairs at once; words whose pairs all exceed the radius are abandoned. A bucket with
more than ``HOT`` fingerprints is dealt again by parts of its free bits, one of which must agree, so no bucket is capped.
Only a spanning forest of the links leaves a task; components then link documents.

Null or blank text: fingerprint zero, linked like any other. Equal fingerprints always link. Null ``doc_id``: gets the
smallest id of its group, null if no member has one. Repeated rows: one result row each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import bits_of, space_words, stored, text_slices
from ledgerlens.llm.components import EDGE, components, spanning

SEED = 42
HOT = 4096
#: fingerprints compared together by a task
WINDOW = 1 << 16
#: pairs held before they are folded into the task's forest
PORTION = 200_000
#: bytes of text whose shingles are hashed at once
SLICE = 1 << 20


def fingerprints(texts: pa.Array, width: int = 3) -> np.ndarray:
    """64-bit SimHash of each text's shingles of ``width`` words (repeats count)."""
    w = space_words(texts)
    sizes = pc.binary_length(w.values).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes[w.ids] + 1)  # in the words joined by one space
    all_words = pa.ListArray.from_arrays(pa.array([0, len(w.ids)], pa.int32()), w.values.take(pa.array(w.ids)))
    joined = memoryview(pc.binary_join(all_words, pa.scalar(" ", w.values.type))[0].as_buffer())
    n = w.counts
    shingles = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.repeat(w.offsets[:-1], shingles) + np.arange(int(shingles.sum())) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = first + np.repeat(np.minimum(n, width), shingles) - 1
    start = (ends - sizes[w.ids] - 1)[first]
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start.tolist(), (ends[last] - 1).tolist())), dtype=np.uint64, count=len(first))
    out = np.zeros(len(n), dtype=np.uint64)
    offsets = np.concatenate([[0], np.cumsum(shingles)])
    some = np.flatnonzero(shingles)
    if len(some):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, offsets[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > shingles[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_table(documents: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(b.column("text"), width).view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _blocks(bits: int, parts: int, low: int = 0) -> list[tuple[int, int]]:
    """(offset, width) of ``parts`` nearly equal blocks of ``bits`` bits from bit ``low`` on."""
    cuts = [low + bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _part(fp: Column, block: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, block[0]).bitwiseAND(F.lit((1 << block[1]) - 1))


def _near_pairs(fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of fingerprints of the same group (rows sorted by it) at most ``radius`` bits apart, in portions."""
    n = len(fp)
    if n < 2:
        return
    end = np.concatenate([np.flatnonzero(group[1:] != group[:-1]) + 1, [n]])
    last = end[np.searchsorted(end, np.arange(n), side="right")]  # first row after the group
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.stack([bits_of(bits[:, p]) for p in range(64)])
    planes = np.concatenate([planes, np.zeros((64, 1), dtype=np.uint64)], axis=1)
    room = last - np.arange(n) - 1  # partners after this row
    found_i, found_j, found = [], [], 0
    for d in range(1, int(room.max(initial=0)) + 1):
        live = bits_of(room >= d)[: (n + 63) // 64]
        at = np.flatnonzero(live)
        live = live[at]
        skip, r = d // 64, np.uint64(d % 64)
        ahead = np.minimum(at + skip, planes.shape[1] - 2)
        level = [np.zeros(len(at), dtype=np.uint64) for _ in range(radius + 1)]  # level[k]: more than k differing bits so far
        for p in range(64):
            there = planes[p, ahead] >> r
            if r:
                there = there | (planes[p, ahead + 1] << (np.uint64(64) - r))
            carry = planes[p, at] ^ there
            for k in range(radius + 1):
                level[k], carry = level[k] | carry, level[k] & carry
            if p % 8 == 7:
                live = live & ~level[radius]
                on = live != 0
                if not on.all():
                    at, ahead, live, level = at[on], ahead[on], live[on], [x[on] for x in level]
                if not len(at):
                    break
        if len(at):
            hit = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(at), 64)
            row, bit = np.nonzero(hit)
            i = at[row] * 64 + bit
            found_i.append(i)
            found_j.append(i + d)
            found += len(i)
            if found >= PORTION:
                yield np.concatenate(found_i), np.concatenate(found_j)
                found_i, found_j, found = [], [], 0
    if found_i:
        yield np.concatenate(found_i), np.concatenate(found_j)


def _linker(radius: int):
    """Forest of links inside the buckets of rows sorted by (bucket, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 3
        a = b = np.zeros(0, dtype=np.int64)

        def link(rows: list[np.ndarray]) -> None:
            nonlocal a, b
            bucket, part, fp = rows
            change = np.ones(len(fp), dtype=bool)
            change[1:] = (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])
            group = np.cumsum(change)
            size = np.bincount(group)[group]
            some = size > 1
            fp = fp[some]
            for i, j in _near_pairs(fp.view(np.uint64), group[some], radius):
                a, b = spanning(np.concatenate([a, fp[i]]), np.concatenate([b, fp[j]]))

        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, ("bucket", "part", "fp"))]
            if len(held[0]) < WINDOW:
                continue
            change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            if not len(change):
                continue
            cut = change[-1]  # the last bucket may go on in the next batch
            link([h[:cut] for h in held])
            held = [h[cut:] for h in held]
        link(held)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect all fingerprints of column ``fp`` within ``radius`` bits of each other."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(64, radius + 3)
    fp = F.col("fp")
    tables, free = [], []
    for number, chosen in enumerate(combinations(range(len(blocks)), 3)):
        tables.append(F.struct(F.xxhash64(F.lit(number), *[_part(fp, blocks[c]) for c in chosen]).alias("bucket"), F.lit(number).alias("choice")))
        rest = [blocks[c] for c in range(len(blocks)) if c not in chosen]
        # radius + 1 pieces of the free bits: one of them agrees
        half = [piece for at, block in enumerate(rest) for piece in _blocks(block[1], (radius + 1) // len(rest) + (at < (radius + 1) % len(rest)), block[0])]
        free.append(F.array(*[F.xxhash64(F.lit(k + 1), _part(fp, piece)) for k, piece in enumerate(half)]))
    keys = distinct.select("fp", F.explode(F.array(*tables)).alias("t")).select("fp", "t.bucket", "t.choice")
    crowded = keys.groupBy("bucket").count().where(F.col("count") > hot).select("bucket", F.lit(True).alias("crowded"))
    again = F.lit(None).cast("array<bigint>")
    for number, parts_of in enumerate(free):
        again = F.when(F.col("choice") == number, parts_of).otherwise(again)
    dealt = keys.join(crowded, "bucket", "left").select(
        "bucket", "fp", F.explode(F.when(F.col("crowded"), again).otherwise(F.array(F.lit(0).cast("long")))).alias("part")
    )
    ordered = dealt.repartition(parts, "bucket", "part").sortWithinPartitions("bucket", "part", "fp")
    return ordered.select("bucket", "part", "fp").mapInArrow(_linker(radius), EDGE)


def _grouped(documents: DataFrame, width: int, radius: int) -> DataFrame:
    """(doc_id, fp, component, component_id) for every row: ``component`` names the group by a fingerprint."""
    marks = stored(fingerprint_table(documents, width), "fingerprints")
    distinct = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    linked = components(fingerprint_links(distinct, radius), "simhash", reduced=True)
    grouped = distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stored(grouped.select("fp", "component").join(least, "component").select(F.col("fp").alias("mark"), "component", "component_id"), "named-fingerprints")
    return marks.join(named, F.col("fp") == F.col("mark")).select("doc_id", "fp", "component", "component_id")


def simhash_groups(documents: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``documents``."""
    return _grouped(documents, width, radius).select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The documents, one of each group: the row with the smallest (``doc_id``, fingerprint), null ids last; of equal ones one.

    With an id for each row the ids to drop are joined, not those to keep: they are the fewer, and where they are few Spark
    broadcasts them and texts stay where they are. Where rows share an id, or have none, the rows' own fingerprints are
    computed beside them and each group keeps its row by (id, fingerprint).
    """
    groups = stored(_grouped(documents, width, radius), "simhash-groups")
    ids = groups.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if ids["rows"] == ids["ids"]:
        dropped = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("dropped_id"))
        return documents.join(stored(dropped, "dropped"), documents["doc_id"] == F.col("dropped_id"), "left_anti")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp")).alias("k")
    kept = stored(groups.groupBy("component").agg(first).select(F.col("k.doc_id").alias("kept_id"), F.col("k.fp").alias("kept_fp")), "kept")
    rows = fingerprint_rows(documents, width)
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col("fp") == F.col("kept_fp"))
    one = rows.join(kept, same, "left_semi").select("*", F.col("row.doc_id").alias("id")).dropDuplicates(["id", "fp"])
    return one.select("row.*")


def fingerprint_rows(documents: DataFrame, width: int = 3) -> DataFrame:
    """(row, fp): all columns in a struct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(fingerprints(b.column("text"), width).view(np.int64))], ["row", "fp"])

    kind = T.StructType([T.StructField("row", documents.schema), T.StructField("fp", T.LongType())])
    return documents.select(F.struct("*").alias("row"), "text").mapInArrow(run, kind)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
