"""The pipeline against a plain run of its stages."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import mixing, quality
from tests.llm.conftest import DOCUMENT, rows_of
from tests.llm.test_decontam import brute
from tests.llm.test_huffman import PATH, expected
from tests.llm.test_simhash import groups, mark


def test_run_equals_the_stages_by_hand(spark, sf):
    from tokenizers import Tokenizer

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontamination", "mixing", "token ids"]
    d, b = rows_of("documents"), rows_of("benchmark")
    text = dict(zip(d["doc_id"], d["text"]))
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(frame, spark.read.parquet(f"{sf}/labels.parquet"), quality.fold(F.col("doc_id"), 5) != 0)
    ids = list(text)
    scores = quality.scores(model, pa.array([text[i] for i in ids], pa.large_string()))
    ids = [i for i, s in zip(ids, scores) if s >= quality.THRESHOLD]
    least = groups({i: mark(text[i]) for i in ids})
    ids = [i for i in ids if least[i] == i]
    found = brute([text[i] for i in ids], [(str(i), t) for i, t in zip(b["item_id"], b["text"])])
    ids = [i for i, (_, hit, _) in zip(ids, found) if not hit]
    kept = frame.where(F.col("doc_id").isin(ids))
    copies = {r.doc_id: r.copies for r in mixing.mix_table(kept).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    rows = expected(tokenizer, [(i, text[i]) for i in sorted(ids) for _ in range(copies[i])])
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(rows)
    assert 0 < len(ids) < len(text) and max(copies.values()) > 1


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_every_stage_on_odd_documents(spark, tmp_path, rows):
    texts = [None, "", " ", "a", "a", "fine words in a line of text", "word " * 3000, "the benchmark text to be found", "é!"]
    data = [(i if i != 4 else 3, t, None if i % 2 else "en", None if i % 3 else "s", None) for i, t in enumerate(texts)] + [(None, "no id", "en", "t", 5)]
    data = data if rows == "odd" else []
    docs = spark.createDataFrame(data, DOCUMENT).withColumn("score", F.lit(0.5)).withColumn("_row", F.lit("x"))
    spark.createDataFrame([(1, "benchmark text to be found"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = Counter(r.doc_id for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        if name != "token ids":
            assert out.columns == docs.columns, name
        docs = spark.read.schema(out.schema).parquet(path)
        now = Counter(r.doc_id for r in docs.collect())
        assert set(now) <= set(ids), name
        if rows == "none":
            assert not now, name
        elif name == "simhash":
            assert all(n == 1 for n in now.values()) and None in now
        elif name == "decontamination":
            assert 7 not in now and 5 in now
        ids = now
    assert rows == "none" or ids


def test_token_ids_are_those_of_the_tokenizer(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(3)
    rows = {r.doc_id: r.ids_crc32 for r in corpus_pipeline.token_stage(spark, docs, sf).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    for r in docs.collect():
        ids = t.encode(r.text, add_special_tokens=False).ids + [2]
        assert rows[r.doc_id] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_registered_queries(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
