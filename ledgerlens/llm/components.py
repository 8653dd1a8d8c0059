"""Connected components over link rows, without collecting links or components anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored

EDGE = "a long, b long"


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the links that is not its root; the root is the component's smallest node."""
    if len(a) == 0:
        return a, b
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if np.array_equal(low, high):
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, dtype=np.int64)
    for batch in batches:
        a, b = spanning(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame, name: str = "components", reduced: bool = False) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is its smallest reachable node.

    Each task first replaces its links by a spanning forest; then rounds of large-star and small-star link every node to
    ever smaller ones until nothing changes (a number of rounds that grows with the logarithm of the size). Every round is
    a table in the shared folder. Links with a null end are ignored; an empty input gives an empty result. ``reduced``: the
    links are the spanning forests of Python tasks already, and a second Python worker beside each is spared.
    """
    kept = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    edges = stored(kept if reduced else kept.mapInArrow(_forest, EDGE), f"{name}-links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stored(large.mapInArrow(_forest, EDGE), f"{name}-large")
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(down, F.col("a") == F.col("n")).select("a", "b", "m")
        pairs = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = stored(pairs.where("a <> b").distinct(), f"{name}-small")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
