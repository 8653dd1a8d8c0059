"""Several aggregates of different keys from one pass over a table.

A page or an export pack is a handful of small tables, each grouped by its own columns over its own rows of the same fact.
Apart, each reads the fact. Here every row is tagged with the parts whose rows it belongs to, one ``groupBy`` over (tag, the
parts' keys) aggregates them all with map-side combine, and the cells are written once, split by tag; each part then is
finished from its own folder, which holds one row per group. Rows of no part are dropped at the scan, and only the columns
some part uses are read.

Keys of different parts with one name share a column, and equal aggregates are computed once for all parts, so that the
shuffle is not much wider than the widest part. A part may count distinct values of one column; all parts' distinct counts
are one distinct aggregate of the plan (no second expansion of the rows), and they are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import shared_root

TAG = "_part"
KINDS: dict[str, Callable[[Column], Column]] = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Part:
    """One aggregate: rows ``where``, grouped by ``keys``.

    ``aggs``: name -> (kind, column), kind one of ``KINDS``; ``distinct``: name -> column, one at most. ``finish`` turns the
    groups (keys, aggs and distinct by name) into the part's table.
    """

    keys: dict[str, Column]
    aggs: dict[str, tuple[str, Column | None]]
    where: Column | None = None
    distinct: dict[str, Column] = field(default_factory=dict)
    finish: Callable[[DataFrame], DataFrame] = lambda df: df


def count_if(condition: Column) -> tuple[str, Column]:
    return "count", F.when(condition, 1)


#: a count of rows
ROWS: tuple[str, Column | None] = ("count", None)


def cells(df: DataFrame, parts: dict[str, Part]) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """(rows per tag and group; for each part its names -> columns). One scan, one shuffle."""
    names = list(parts)
    tags = [F.lit(i) if p.where is None else F.when(p.where, F.lit(i)) for i, p in enumerate(parts.values())]
    if all(p.where is not None for p in parts.values()):
        df = df.filter(reduce(lambda a, b: a | b, (p.where for p in parts.values())))
    slots: dict[tuple[str, str], str] = {}  # (key name, type) -> column
    values: dict[str, list[tuple[int, Column]]] = {}
    columns: dict[str, dict[str, str]] = {n: {} for n in names}
    for i, (name, p) in enumerate(parts.items()):
        kinds = df.select(*[c.alias(k) for k, c in p.keys.items()]).schema if p.keys else []
        for f in kinds:
            slot = slots.setdefault((f.name, f.dataType.simpleString()), f"_k{len(slots)}")
            values.setdefault(slot, []).append((i, p.keys[f.name]))
            columns[name][f.name] = slot
    inputs: dict[str, str] = {}  # an aggregate's column, by its text -> column
    made: dict[str, Column] = {}
    aggs: dict[tuple[str, str], str] = {}
    for name, p in parts.items():
        for out, (kind, c) in p.aggs.items():
            source = inputs.setdefault(str(c), f"_v{len(inputs)}")
            made[source] = F.lit(1) if c is None else c
            columns[name][out] = aggs.setdefault((kind, source), f"_a{len(aggs)}")
    counted: list[tuple[int, Column]] = []
    for i, (name, p) in enumerate(parts.items()):
        if len(p.distinct) > 1:
            raise ValueError(f"{name}: one distinct count at most")
        for out, c in p.distinct.items():
            counted.append((i, c.cast("string")))
            columns[name][out] = "_distinct"

    def of(pairs: list[tuple[int, Column]]) -> Column:
        return reduce(lambda w, x: w.when(F.col(TAG) == x[0], x[1]), pairs[1:], F.when(F.col(TAG) == pairs[0][0], pairs[0][1]))

    # a row of some parts is dealt to all and dropped where it has no tag: generated code, no function per row
    tagged = df.withColumn(TAG, F.explode(F.array(*tags))).where(F.col(TAG).isNotNull())
    wide = tagged.select(
        TAG, *[of(v).alias(k) for k, v in values.items()], *[c.alias(k) for k, c in made.items()], *([of(counted).alias("_member")] if counted else []),
    )
    found = [KINDS[kind](F.col(source)).alias(out) for (kind, source), out in aggs.items()]
    found += [F.countDistinct("_member").alias("_distinct")] if counted else []
    return wide.groupBy(TAG, *values).agg(*found), columns


def gather(df: DataFrame, parts: dict[str, Part], folder: str | None = None) -> dict[str, DataFrame]:
    """Every part's table; the fact is read once, now, and its cells are written under ``folder`` (default: the shared root).

    The tables read the written cells, however often they are used.
    """
    spark = df.sparkSession
    place = f"{folder or shared_root(spark) + '/ledgerlens-shared'}/{uuid.uuid4().hex}"
    rows, columns = cells(df, parts)
    rows.write.partitionBy(TAG).parquet(place)
    schema = T.StructType([*rows.drop(TAG).schema.fields, T.StructField(TAG, T.IntegerType())])
    out = {}
    for i, (name, p) in enumerate(parts.items()):
        own = spark.read.schema(schema).parquet(place).filter(F.col(TAG) == i)
        own = own.select(*[F.col(c).alias(n) for n, c in columns[name].items()])
        if not p.keys:  # a table without keys has a row for no rows too
            own = own.agg(*[(F.coalesce(F.sum(n), F.lit(0)) if p.aggs.get(n, ("count",))[0] == "count" else F.max(n)).alias(n) for n in columns[name]])
        out[name] = p.finish(own)
    return out
