"""Near-duplicate vectors by NN-descent.

Equal vectors collapse to a class (smallest id, size). The neighbour graph starts from windows over the vectors sorted by
random-hyperplane codes (``TREES`` orders), then is refined: every node joins its neighbours and a sample of its reverse
neighbours with each other, and closer ones enter their lists of ``K``. The search only decides the order in which vectors
are stored: near ones together, in blocks of ``BLOCK``. Links and components come from comparing every block with every
block, so no pair depends on what the search found. What the triangle inequality rules out is skipped: two blocks, or a row
against a block, whose angle to the centres leaves no room for a link. Only link counts and spanning forests leave a task.

All cosines are computed in double precision. Null, empty or zero vectors and vectors with null or non-finite components
link with nothing (0 links, own component, kept). Vectors of different lengths never link. Repeated rows: a result row each,
counted as other vectors of their class. Null ``vec_id``: links and counts, component as for the class, not kept. Empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_file, pack_arrays, put_file, shared_path, stored, unpack_arrays
from ledgerlens.llm.components import components, spanning

THRESHOLD = 0.95
K = 10
TREES = 8
ROUNDS = 2
SPAN = 32
BLOCK = 1024
#: blocks that a row of work compares with one block
STRIPE = 16
#: angle (radians) by which a bound must be missed before a comparison is skipped
SLACK = 1e-6
CODE_BITS = 30

LISTS = "node long, nbrs array<long>, sims array<double>, fresh array<boolean>"


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of rows sorted by ``key`` that never split a key."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            count += b.num_rows
        if count >= rows:
            t = pa.Table.from_batches(held)
            k = t[key].to_numpy()
            cut = int(np.searchsorted(k, k[-1], side="left")) if k[0] != k[-1] else 0
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).combine_chunks().to_batches()
                count = t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def unit(blobs: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors (double) of packed components; shorter ones are filled with zeros, see ``lengths``."""
    rows = blobs.to_pylist()
    if not rows:
        return np.zeros((0, 1))
    size = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) // 8
    if (size == size[0]).all():
        x = np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)
    else:
        x = np.zeros((len(rows), int(size.max())))
        for i, r in enumerate(rows):
            x[i, : len(r) // 8] = np.frombuffer(r, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def lengths(blobs: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return pc.binary_length(blobs).to_numpy().astype(np.int64)


def top(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best distinct neighbours of every node, sorted by node and falling similarity."""
    order = np.lexsort((nbr, node))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (node[order][1:] != node[order][:-1]) | (nbr[order][1:] != nbr[order][:-1])
    order = order[first]
    order = order[np.lexsort((nbr[order], -sim[order], node[order]))]
    n = node[order]
    start = np.searchsorted(n, n, side="left")
    return order[np.arange(len(order)) - start < k]


def as_lists(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    """One row per node; rows are sorted by node."""
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.append(starts, len(node)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(node[starts]), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (nbr, sim, fresh))], ["node", "nbrs", "sims", "fresh"]
    )


def valid(c: Column) -> Column:
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0)


def pack(nodes: DataFrame) -> DataFrame:
    """(node, copies, vec): components as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("embedding")
            flat, at = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(pc.list_value_length(col).to_numpy())])
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), pa.array([flat[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())], ["node", "copies", "vec"])

    return nodes.mapInArrow(run, "node long, copies long, vec binary")


def codes(nodes: DataFrame, trees: int, seed: int) -> DataFrame:
    """(tree, code, node, vec): codes of random-hyperplane signs, high bits first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(b.column("vec"))
            for tree in range(trees):
                planes = np.random.default_rng([seed, tree, x.shape[1]]).standard_normal((x.shape[1], CODE_BITS))
                code = (x @ planes > 0) @ (1 << np.arange(CODE_BITS - 1, -1, -1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, dtype=np.int32)), pa.array(code), b.column("node"), b.column("vec")], ["tree", "code", "node", "vec"])

    return nodes.select("node", "vec").mapInArrow(run, "tree int, code long, node long, vec binary")


def start(nodes: DataFrame, k: int, trees: int, seed: int) -> DataFrame:
    """First lists: the nearest within overlapping windows of every order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([tail, t]) if tail is not None else t
            node, tree, vec = t["node"].to_numpy(), t["tree"].to_numpy(), t["vec"]
            x, size = unit(vec), lengths(vec)
            found = []
            for a in range(0, len(node), SPAN):
                z = min(a + 2 * SPAN, len(node))
                s = x[a:z] @ x[a:z].T
                s[(tree[a:z, None] != tree[None, a:z]) | (size[a:z, None] != size[None, a:z]) | (node[a:z, None] == node[None, a:z])] = -2
                best = np.argsort(-s, axis=1)[:, :k]
                keep = np.take_along_axis(s, best, axis=1) > -2
                i, j = np.nonzero(keep)
                found.append((node[a + i], node[a + best[i, j]], s[i, best[i, j]]))
            if found:
                n, m, s = (np.concatenate(y) for y in zip(*found))
                at = top(n, m, s, k)
                yield as_lists(n[at], m[at], s[at], np.ones(len(at), dtype=bool))
            tail = t.slice(max(0, len(node) - SPAN))

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(codes(nodes, trees, seed), "codes")
    ordered = dealt.repartitionByRange(parts, "tree", "code", "node").sortWithinPartitions("tree", "code", "node")
    return merged(ordered.mapInArrow(run, LISTS), k)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of all lists of a node; an entry is fresh if no unfresh copy of it exists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "node"):
            n = pc.list_value_length(t["nbrs"]).to_numpy()
            node = np.repeat(t["node"].to_numpy(), n)
            nbr, sim, fresh = (pc.list_flatten(t[c]).to_numpy() for c in ("nbrs", "sims", "fresh"))
            old = np.lexsort((fresh, nbr, node))  # an unfresh copy comes first
            node, nbr, sim, fresh = node[old], nbr[old], sim[old], fresh[old]
            at = top(node, nbr, sim, k)
            yield as_lists(node[at], nbr[at], sim[at], fresh[at])

    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(run, LISTS)


def refine(nodes: DataFrame, lists: DataFrame, k: int, turn: int) -> DataFrame:
    """One round: neighbours of a node meet each other; returns the improved lists."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ahead = lists.select(F.col("node").alias("center"), F.explode(F.arrays_zip("nbrs", "fresh")).alias("e")).select("center", F.col("e.nbrs").alias("member"), F.col("e.fresh").alias("fresh"))
    pick = Window.partitionBy("center").orderBy(F.xxhash64(F.lit(turn), "center", "member"))
    back = ahead.select(F.col("member").alias("center"), F.col("center").alias("member"), "fresh").withColumn("r", F.row_number().over(pick)).where(F.col("r") <= k).drop("r")
    floor = lists.select("node", F.when(F.size("sims") < k, F.lit(-1.0)).otherwise(F.array_min("sims")).alias("floor"))
    known = nodes.select("node", "vec").join(floor, "node")
    met = ahead.unionByName(back).join(known, F.col("member") == F.col("node")).select("center", "member", "fresh", "floor", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "center", 8_000):
            center, member, fresh, floor_ = (t[c].to_numpy() for c in ("center", "member", "fresh", "floor"))
            x, size = unit(t["vec"]), lengths(t["vec"])
            first = np.flatnonzero(np.concatenate([[True], center[1:] != center[:-1]]))
            count = np.diff(np.append(first, len(center)))
            found = []
            for width in np.unique(count):  # groups of the same size at once
                rows = first[count == width][:, None] + np.arange(width)
                s = np.matmul(x[rows], x[rows].transpose(0, 2, 1))
                a, b = rows[:, :, None], rows[:, None, :]
                good = (member[a] != member[b]) & (size[a] == size[b]) & (fresh[a] | fresh[b]) & (s > floor_[a])
                g, i, j = np.nonzero(good)
                found.append((member[rows[g, i]], member[rows[g, j]], s[g, i, j]))
            n, m, s = (np.concatenate(y) for y in zip(*found))
            at = top(n, m, s, k)
            yield as_lists(n[at], m[at], s[at], np.ones(len(at), dtype=bool))

    closer = met.repartition(parts, "center").sortWithinPartitions("center").mapInArrow(run, LISTS)
    old = lists.withColumn("fresh", F.transform("fresh", lambda _: F.lit(False)))
    return merged(old.unionByName(closer), k)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y, -1, 1))


def blocks(nodes: DataFrame, near: DataFrame, folder: str, rows: int) -> np.ndarray:
    """Write vectors as files of at most ``rows`` vectors of one length, components of ``near`` together; files per partition."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.join(near, "node", "left").select(F.length("vec").alias("size"), F.coalesce("component", "node").alias("key"), "node", "copies", "vec")
    order = ["size", "key", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0

        def cut(t: pa.Table, last: bool) -> pa.Table:
            nonlocal n
            while t.num_rows and (last or t.num_rows > rows):
                size = t["size"].slice(0, rows).to_numpy()
                m = int(np.searchsorted(size, size[0], side="right"))
                x = unit(t["vec"].slice(0, m))
                centre = x.mean(axis=0)
                norm = np.sqrt(centre @ centre)
                centre = centre / norm if norm > 1e-9 else x[0]
                put_file(f"{folder}/{part:06d}-{n:06d}.bin", pack_arrays({
                    "node": t["node"].slice(0, m).to_numpy(), "copies": t["copies"].slice(0, m).to_numpy(), "centre": centre,
                    "radius": angles(x, centre).max(keepdims=True), "x": x.reshape(-1),
                }))
                n += 1
                t = t.slice(m)
            return t

        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = cut(pa.concat_tables([held, t]) if held is not None else t, False)
        if held is not None:
            cut(held, True)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64())], ["part", "n"])

    written = stored(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "part int, n long"), "vector-blocks")
    out = np.zeros(parts, dtype=np.int64)
    for r in written.collect():  # one row per partition
        out[r["part"]] = r["n"]
    return out


def compared(spark: SparkSession, folder: str, files: np.ndarray, threshold: float) -> DataFrame:
    """(a, b, n): ``n`` links of node ``a`` where ``b`` is null, else a link of a spanning forest; over all pairs of blocks."""
    total, before = int(files.sum()), np.cumsum(files) - files
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(k: int) -> tuple[np.ndarray, ...]:
            part = int(np.searchsorted(before, k, side="right")) - 1
            f = unpack_arrays(map_file(f"{folder}/{part:06d}-{k - before[part]:06d}.bin"))
            return f["node"], f["copies"], f["centre"], f["radius"][0], f["x"].reshape(len(f["node"]), -1)

        def rows(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), *(pa.nulls(len(a), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (b, n))], schema=kind)

        forest, waiting = [], 0
        for w in batches:
            for i, stripe in zip(w.column("i").to_pylist(), w.column("stripe").to_pylist()):
                node, copies, centre, radius, x = block(i)
                own = np.zeros(len(node), dtype=np.int64)
                for j in range(max(i, stripe * STRIPE), min((stripe + 1) * STRIPE, total)):
                    node2, copies2, centre2, radius2, y = block(j)
                    if len(centre) != len(centre2) or i != j and angles(centre, centre2) > radius + radius2 + reach:
                        continue
                    left, right = np.flatnonzero(angles(x, centre2) <= radius2 + reach), np.flatnonzero(angles(y, centre) <= radius + reach)
                    link = x[left] @ y[right].T >= threshold
                    if i == j:
                        link &= left[:, None] != right[None]
                    u, v = np.nonzero(link)
                    if not len(u):
                        continue
                    own[left] += link @ copies2[right]
                    if i != j:
                        other = link.T @ copies[left]
                        yield rows(node2[right][other > 0], None, other[other > 0])
                    forest.append(spanning(node[left][u], node2[right][v]))
                    waiting += len(forest[-1][0])
                    if waiting > 1 << 20:
                        forest = [spanning(*(np.concatenate(c) for c in zip(*forest)))]
                        waiting = 0
                yield rows(node[own > 0], None, own[own > 0])
        if forest:
            yield rows(*spanning(*(np.concatenate(c) for c in zip(*forest))), None)

    work = spark.range(total).select(F.col("id").alias("i"), F.explode(F.sequence(F.floor(F.col("id") / STRIPE), F.lit((total - 1) // STRIPE).cast("long"))).alias("stripe"))
    return work.repartition(parts, "i", "stripe").mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.withColumn("embedding", F.when(valid(F.col("embedding")), F.transform("embedding", lambda x: x + F.lit(0).cast(vectors.schema["embedding"].dataType.elementType))))
    sound = rows.where("embedding is not null")
    classes = stored(sound.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vector-classes")
    nodes = stored(pack(classes.where("node is not null").select("node", "copies", "embedding")), "vector-nodes")
    lists = stored(start(nodes, k, TREES, 100), "lists")
    for turn in range(ROUNDS):
        lists = stored(refine(nodes, lists, k, turn), "lists")
    near = lists.select(F.col("node").alias("a"), F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).where(F.col("e.sims") >= threshold).select("a", F.col("e.nbrs").alias("b"))
    spark = nodes.sparkSession
    folder = shared_path(spark, "vector-files")
    files = blocks(nodes, stored(components(near, "near"), "near"), folder, BLOCK)
    pairs = stored(compared(spark, folder, files, threshold), "vector-pairs")
    links = pairs.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    parts = stored(components(pairs.where("b is not null").select("a", "b"), "vectors"), "vector-components")
    every = classes.join(links, "node", "left").join(parts.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    every = stored(every.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "vector-result")
    linked = rows.join(every.withColumnRenamed("embedding", "e"), F.col("embedding") == F.col("e"), "left")
    component = F.coalesce("component_id", "vec_id")
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
