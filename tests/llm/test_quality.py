from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.llm import quality
from tests.llm.conftest import ODD


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    scored = quality.op6_quality(spark, base)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(good) > 100 and len(bad) > 15
    assert np.mean([r.predicted for r in good]) > 0.97 and np.mean([1 - r.predicted for r in bad]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_odd_documents(spark, documents):
    texts = [*ODD, *[f"plain text number {i} is fine and reads well" for i in range(30)], *["spam! " * (5 + i) for i in range(30)]]
    frame = documents(texts, extra=True)
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(10, 70)] + [(12, None, 0), (13, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame, labels, F.lit(True))
    rows = {r.doc_id: r.score for r in quality.score_documents(frame, model).collect()}
    assert len(rows) == len(texts) and min(rows[i] for i in range(20, 40)) > max(rows[i] for i in range(50, 70))
    kept = quality.keep_good(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(s >= 0.3 for s in rows.values())
    assert quality.score_documents(frame.limit(0), model).count() == 0
    again = quality.fit(frame.repartition(5), labels.repartition(3), F.lit(True))
    assert {r.doc_id: r.score for r in quality.score_documents(frame, again).collect()} == rows


def test_without_labels_of_both_kinds(spark, documents):
    frame = documents(["a b c"] * 5)
    none = quality.fit(frame, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert quality.scores(none, pa.array(["x", None])).tolist() == [0.5, 0.5]
    one = quality.fit(frame, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), F.lit(True))
    assert quality.scores(one, pa.array(["x"]))[0] > 0.5


def test_whole_text_is_scored():
    w = {"good": quality.dictionary([b"calm words of a long text " * 50]), "bad": quality.dictionary([b"zzz! " * 300]), "w": [1.0, 0.0, 0.0, 0.0]}
    clean = "calm words of a long text " * 400
    assert quality.scores(w, pa.array([clean]))[0] > quality.scores(w, pa.array([clean + "zzz! " * 4000]))[0]
