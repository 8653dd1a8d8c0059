from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.llm import langid
from tests.llm.conftest import ODD


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    rows = langid.op3_language(spark, base).join(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 250 < len(held) < 420
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    sure = [r for r in held if r.score > 0.9]
    assert abs(np.mean([r.score for r in sure]) - np.mean([r.lang_pred == r.lang for r in sure])) < 0.05


def test_grams_of_a_word():
    grams, offsets = langid.word_grams(pa.array(["ab", "a", "é"]))
    # letters, then pairs and triples with both borders: a b / _a ab b_ / _ab ab_
    assert np.diff(offsets).tolist() == [7, 4, 4]
    assert langid.word_grams(pa.array(["x", "ab"]))[0][4:].tolist() == grams[:7].tolist()
    assert len(langid.word_grams(pa.array([], pa.string()))[0]) == 0


def test_document_frequencies_cover_all_rows(spark, documents):
    idf = langid.inverse_frequencies(documents(["aa", "a", None, "b"] * 50).repartition(7))
    bucket = langid.word_grams(pa.array(["a"]))[0][0]
    assert np.isclose(idf[bucket], np.log(201 / 101) + 1)


def test_odd_documents(spark, documents):
    texts = [*ODD, "1234 !!", "١٢٣", "ü", *["the cat and the dog"] * 20, *["der hund und die katze"] * 20]
    frame = documents(texts, extra=True).withColumn("lang", F.when(F.col("doc_id") >= 33, "de").when(F.col("doc_id") >= 13, "en"))
    model = langid.fit(frame, F.lit(True))
    assert model["names"] == ["de", "en"]
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame, model).collect()}
    assert len(rows) == len(texts)
    for i in (0, 1, 2, 10, 11):
        assert rows[i] == ("und", 0.0)
    assert rows[13][0] == "en" and rows[33][0] == "de" and rows[12][0] != "und"
    nothing = langid.fit(frame, F.lit(False))
    assert {r.lang_pred for r in langid.identify(frame, nothing).collect()} == {"und"}
    assert langid.identify(frame.limit(0), model).count() == 0


def test_sparse_weights_and_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(2000, 3))
    p = langid.softmax(logits)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(langid.temperature(logits * 4, y) - 4) < 0.8
    m = langid.train(["aaa bbb", "ccc ddd"] * 40, ["x", "y"] * 40, np.ones(langid.BUCKETS))
    assert (m["weights"] == 0).mean() > 0.99
