from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing
from tests.llm.conftest import ODD, rows_of


def sizes_of(texts):
    return [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]


def water(sizes: dict, weights=(5, 2, 1), cap=3) -> dict:
    """Targets by repeated clamping and resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, shut = {}, set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in shut)
        total = sum(weight[s] for s in names if s not in shut)
        out = {s: cap * sizes[s] if s in shut else left * weight[s] / total for s in names}
        more = {s for s in names if s not in shut and out[s] > cap * sizes[s]}
        if not more:
            return out
        shut |= more


def check(rows, texts, sources):
    size = Counter()
    for s, n in zip(sources, sizes_of(texts)):
        size[s] += n
    goal = water(size)
    taken, most = Counter(), Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(goal[r.source], abs=1e-6)
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        most[r.source] = max(most[r.source], r.size)
    for s in size:
        assert abs(taken[s] - goal[s]) <= most[s] / 2 + 1e-6, s


def test_query_on_the_documents(spark, sf):
    d = rows_of("documents")
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    check(mixing.mix_table(frame).collect(), d["text"], d["source"])
    once, again = (sorted(tuple(r) for r in mixing.op2_mixing(spark, sf).collect()) for _ in range(2))
    assert once == again and len(once) == len(d["text"])
    assert {i: n for i, n, *_ in once} == dict(zip(d["doc_id"], sizes_of(d["text"])))


def test_caps_nulls_order_and_ties(spark):
    rows = []
    for source, count in ((None, 40), ("b", 2), ("a", 3), ("Z", 30), ("é", 5), ("𐀀", 4), ("￿", 6), ("empty", 0)):
        rows += [(len(rows) + k, "w " * (1 + k % 7), source) for k in range(count)]
    rows += [(len(rows), None, "empty"), (0, "w", "a"), (0, "w", "a"), (None, "w w", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix_table(frame).collect()
    check(out, [t for _, t, _ in rows], [s for *_, s in rows])
    assert len(out) == len(rows)


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7, lambda k: k // 100])
def test_many_equal_rows(spark, documents, ids):
    """Rows equal in id and size are taken in part: a source misses its target by half a document at most."""
    rows = [(ids(k), "one two three", s) for k in range(300) for s in ("a", "b", "c")] + [(k, "w " * (k % 5), "c") for k in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = mixing.mix_table(frame).collect()
    check(out, [t for _, t, _ in rows], [s for *_, s in rows])
    table, mixed = Counter(), Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.mixed(frame).collect())
    for r in out:
        table[r.doc_id, r.source, r.size] += r.copies
    assert mixed == Counter({k: n for k, n in table.items() if n})
    assert any(len({r.copies for r in out if (r.doc_id, r.source, r.size) == k}) > 1 for k in table)


def test_level_refinement_with_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEVEL_BITS", 1)
    rows = [(i, "w " * (i % 11), "abc"[i % 3]) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.mix_table(frame).collect(), [t for _, t, _ in rows], [s for *_, s in rows])


def test_large_source_tables_are_joined_without_broadcast(spark, monkeypatch, documents):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert mixing.mix_table(documents(ODD)).count() == len(ODD)


def test_mixed_documents(spark, documents):
    frame = documents([*ODD, "one two three"] * 3, ids=range(33), extra=True).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.lit("b")))
    table = {r.doc_id: r.copies for r in mixing.mix_table(frame).collect()}
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in table.items() if n})
    assert mixing.mixed(frame.limit(0)).count() == 0 == mixing.mix_table(frame.limit(0)).count()


def test_plan_has_no_python(spark, sf):
    plan = mixing.op2_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
