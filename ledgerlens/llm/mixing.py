"""Mixing sources to target weights: capped water-filling and seeded repetitions, DataFrame operations only.

Targets: a source's share of the budget by weight, clamped at ``max_epochs`` times its size; what clamping frees goes to the
others by weight, in rounds, until none is above its cap (each round clamps a source or ends; only two sums reach the
driver). Sources are few rows by comparison, but they stay a table: ranks come from a distributed running count, and the
table is broadcast only while it has at most ``BROADCAST_SOURCES`` rows.

Repetitions: a document is taken floor(target / size of source) times, and once more if it lies in the seeded prefix of its
source: documents in order of a hash of ``doc_id``, as far as the fractional target reaches. The prefix comes from words per
hash bucket (pre-aggregated, then refined inside the one bucket where the target falls), so no source is sorted in one task.
Of the documents at the border (one, or all rows with the same ``doc_id`` and size) as many are taken as bring the total
nearest, so a source misses its target by at most half the size of one document, however many rows are equal. Which of the
equal rows are taken goes by their place in the table, found from counts per partition; where it comes to that, ``mixed``
writes its rows first, so that the places it counts are those it reads.

Null source: a source of its own, last. Null or blank text: size 0, taken 0. Null ``doc_id``: hashed like an id. Repeated
rows count each. Empty table: no rows. Code points order the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored
from ledgerlens.llm.numbering import positions

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17
BROADCAST_SOURCES = 20_000
#: buckets of a hash level: 2**12 per level, two levels, then documents
LEVEL_BITS = 12


def _marked(documents: DataFrame) -> DataFrame:
    """Adds the working columns ``_size`` (words), ``_source``, ``_id``, ``_h``, ``_bucket``, ``_sub`` and ``_place`` to the documents."""
    buckets = 1 << LEVEL_BITS
    rows = documents.withColumns({
        "_size": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"),
        "_source": F.col("source").cast("string"),
        "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)),
        "_h": F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long")),
        PLACE: F.monotonically_increasing_id(),
    })
    return rows.withColumns({"_bucket": F.pmod("_h", F.lit(buckets)), "_sub": F.pmod(F.shiftright("_h", LEVEL_BITS), F.lit(buckets))})


WORKING = ["_size", "_source", "_id", "_h", "_bucket", "_sub"]
#: place of a row: monotonically_increasing_id, whose upper bits are the partition
PLACE, _PARTITION = "_place", 33


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``i``: the position of the source by code point, null last."""
    keyed = sources.select(F.lit("").alias("tree"), F.col("source").isNull().alias("last"), "source", "source_size")
    return positions(keyed, ["last", "source"]).select("source", "source_size", F.col("idx").alias("i"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, epochs: float = EPOCHS, budget: float | None = None) -> DataFrame:
    """(source, source_size, target) by capped water-filling; ``budget`` in words, all words unless given."""
    sources = _ranked(stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    state = stored(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs)), "source-weights")
    total = state.agg(F.sum("source_size").cast("double").alias("t"), F.sum("cap").alias("c")).first()
    left = min(float(budget if budget is not None else total["t"] or 0.0), total["c"] or 0.0)
    level = None  # words per unit of weight; a source with a cap below level * weight is clamped
    clamped = -1
    while True:
        open_ = state if level is None else state.where(F.col("cap") > F.col("weight") * F.lit(level))
        shut = state.where(F.lit(False)) if level is None else state.where(F.col("cap") <= F.col("weight") * F.lit(level))
        w = open_.agg(F.sum("weight").alias("w")).first()["w"]
        used = shut.agg(F.sum("cap").alias("c"), F.count("*").alias("n")).first()
        if used["n"] == clamped or not w:
            break
        clamped = used["n"]
        level = (left - (used["c"] or 0.0)) / w
    filled = F.lit(0.0) if level is None else F.least("cap", F.col("weight") * F.lit(level))
    return stored(state.select("source", "source_size", filled.alias("target")), "source-targets")


def _prefix(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, cut, equal, take): documents of the source with (bucket, sub, h, doc_id, size) before the cut are taken once
    more, and ``take`` of the ``equal`` ones at it.

    ``rows`` has (source, size, bucket, sub, h, doc_id), ``wanted`` (source, extra): words wanted on top of whole copies.
    """
    per_source = Window.partitionBy("source")

    def border(table: DataFrame, keys: list[str], more: tuple | list = ()) -> DataFrame:
        """The last entry of each source that starts below its target, and the words before it."""
        run = table.withColumn("upto", F.sum("size").over(per_source.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)))
        below = run.withColumn("before", F.col("upto") - F.col("size")).where("before + done < extra")
        last = F.max_by(F.struct(*keys, "before", "upto", *more), F.struct(*keys))
        return below.groupBy("source", "extra", "done").agg(last.alias("b")).select(
            "source", "extra", (F.col("done") + F.col("b.before")).alias("done"), (F.col("done") + F.col("b.upto")).alias("upto"), *[F.col(f"b.{k}").alias(k) for k in [*keys, *more]]
        )

    def at(table: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
        names = found.select(F.col("source").alias("s"), "extra", "done", *[F.col(k).alias(f"_{k}") for k in keys])
        same = F.col("source").eqNullSafe(F.col("s"))
        for k in keys:
            same = same & (F.col(k) == F.col(f"_{k}"))
        return table.join(names, same).drop("s")

    level1 = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    first = border(at(level1, wanted.withColumn("done", F.lit(0).cast("long")), []), ["bucket"])
    level2 = at(rows, first, ["bucket"]).groupBy("source", "extra", "done", "bucket", "sub").agg(F.sum("size").alias("size"))
    second = stored(border(level2, ["bucket", "sub"]), "border")
    # rows equal in all keys are one entry of their sizes' sum; the size is a key, so it is called ``each`` there
    keys = ["bucket", "sub", "h", "doc_id", "each"]
    level3 = at(rows, second, ["bucket", "sub"]).withColumnRenamed("size", "each").groupBy("source", "extra", "done", *keys).agg(F.sum("each").alias("size"), F.count("*").alias("equal"))
    last = border(level3, keys, ["equal"])
    # as many of the equal documents at the border as come nearest to the target
    take = F.least(F.col("equal"), F.floor((F.col("extra") - F.col("done")) / F.col("each") + 0.5))
    return last.select("source", F.struct("bucket", "sub", "h", "doc_id", F.col("each").alias("size")).alias("cut"), "equal", take.cast("long").alias("take"))


def _own() -> Column:
    return F.struct(F.col("_bucket").alias("bucket"), F.col("_sub").alias("sub"), F.col("_h").alias("h"), F.col("_id").alias("doc_id"), F.col("_size").alias("size"))


def _last_places(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """(source, place): the place of the last row taken among the equal rows at a source's border.

    Counts per partition say in which one the last taken row lies; only that partition's equal rows are put in order.
    """
    at_cut = rows.join(tied, F.col("_source").eqNullSafe(F.col("s")) & (_own() == F.col("cut"))).select("s", "take", F.col(PLACE).alias("place"))
    at_cut = at_cut.withColumn("part", F.shiftright("place", _PARTITION))
    counts = at_cut.groupBy("s", "take", "part").agg(F.count("*").alias("n"))
    run = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    inside = run.where("upto - n < take and take <= upto").select(F.col("s").alias("s2"), F.col("part").alias("part2"), (F.col("take") - F.col("upto") + F.col("n")).alias("nth"))
    here = at_cut.join(inside, F.col("s").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("part2")))
    numbered = here.withColumn("number", F.row_number().over(Window.partitionBy("s").orderBy("place")))
    return numbered.where("number = nth").select(F.col("s").alias("tied_source"), "place")


def mix_plan(rows: DataFrame, weights: tuple = WEIGHTS, epochs: float = EPOCHS, budget: float | None = None) -> tuple[DataFrame, bool]:
    """(s, source_size, target, whole, cut, place) of each source, and whether places of equal rows decide anything.

    ``rows`` has the working columns and the rows' places; equal rows at ``cut`` are taken up to ``place``.
    """
    named = rows.select(*[F.col(c).alias({"_id": "doc_id"}.get(c, c[1:])) for c in WORKING])
    goal = targets(named, weights, epochs, budget)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = stored(_prefix(named.where("size > 0"), goal.where("extra > 0").select("source", "extra")), "cuts")
    plan = goal.join(cuts.withColumnRenamed("source", "cut_source"), F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    plan = plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "cut", "take", F.when(F.col("take") > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-1)).alias("place"))
    ties = cuts.where("take between 1 and equal - 1").select(F.col("source").alias("s"), "cut", "take")
    tied = not ties.isEmpty()
    if tied:
        last = _last_places(rows, ties).withColumnRenamed("place", "tied_place")
        plan = plan.join(last, F.col("s").eqNullSafe(F.col("tied_source")), "left").withColumn("place", F.coalesce("tied_place", "place"))
    plan = stored(plan.select("s", "source_size", "target", "whole", "cut", "place"), "mix-plan")
    return (F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan), tied


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan's columns and ``_copies``: how often the row is taken."""
    more = F.col("cut").isNotNull() & ((_own() < F.col("cut")) | ((_own() == F.col("cut")) & (F.col(PLACE) <= F.col("place"))))
    copies = F.when(F.col("_size") > 0, F.col("whole") + more.cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.join(plan, F.col("_source").eqNullSafe(F.col("s"))).withColumn("_copies", copies)


def mix_table(documents: DataFrame, weights: tuple = WEIGHTS, epochs: float = EPOCHS, budget: float | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``documents``; texts are read once."""
    rows = stored(_marked(documents).select(F.col("doc_id").cast("long").alias("doc_id"), *WORKING, PLACE), "sizes")
    taken = with_copies(rows, mix_plan(rows, weights, epochs, budget)[0])
    return taken.select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"))


def mixed(documents: DataFrame, weights: tuple = WEIGHTS, epochs: float = EPOCHS, budget: float | None = None) -> DataFrame:
    """The mix itself: the documents (all columns), each as many times as it is taken; texts are not shuffled."""
    marked = _marked(documents.select(F.struct("*").alias("_row"), "doc_id", "text", "source")).select("_row", *WORKING, PLACE)
    plan, tied = mix_plan(stored(marked.select(*WORKING, PLACE), "sizes"), weights, epochs, budget)
    if tied:  # places decide: take them from rows that stay where they are
        marked = stored(marked, "marked")
        plan, _ = mix_plan(marked.select(*WORKING, PLACE), weights, epochs, budget)
    taken = with_copies(marked, plan).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
