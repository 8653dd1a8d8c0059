"""Quality score from compression with dictionaries of good and of bad labelled text.

Two zstandard dictionaries are trained on whole labelled texts (lines that both classes share are left out, they tell
nothing). A text is compressed in pieces of ``PIECE`` bytes with each, so that the dictionary matters all along it; its
sizes under both (good minus bad, relative to the text and to the larger, and good to text) go through a logistic
calibration fitted on other labelled documents.

Bounds, all parameters: ``per_class`` documents of each label for the dictionaries, ``calibration`` documents for the
calibration, taken in the order of a hash of ``doc_id``. The fit is one task over that sample; scoring is a map.

Null or empty text: scored like any text (its sizes are those of an empty frame). Documents whose labels contradict each
other teach nothing; null labels neither. Without labels of both kinds every score is the smoothed share of good labels
(0.5 without any). Repeated documents: a row each. Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import text_slices

PIECE = 1024
DICTIONARY = 64 << 10
LEVEL = 3
THRESHOLD = 0.3


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def pieces(text: bytes) -> list[bytes]:
    return [text[k : k + PIECE] for k in range(0, len(text), PIECE)] or [b""]


def dictionary(texts: list[bytes]) -> bytes:
    parts = [p for t in texts for p in pieces(t) if p]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself serves
        return b"".join(parts)[-DICTIONARY:] or b"\0" * 8


class Compressor:
    """Sizes of a text under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.sides = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            for d in (good, bad)
        ]

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 3))
        for i, t in enumerate(texts):
            parts = pieces(t)
            good, bad = (sum(len(side.compress(p)) for p in parts) for side in self.sides)
            out[i] = (bad - good) / (len(t) + 1), (bad - good) / max(bad, good), good / (len(t) + 1)
        return out


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps on standardised columns; (weights, bias) for raw columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) + 1e-3 * w)
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def _fit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts: dict[tuple[int, int], list[str]] = {(r, q): [] for r in (0, 1) for q in (0, 1)}
    for b in rows:
        for role, quality, text in zip(*(b.column(c).to_pylist() for c in ("role", "quality", "text"))):
            texts[role, quality].append(text or "")
    labels = np.array([0] * len(texts[1, 0]) + [1] * len(texts[1, 1]))
    good, bad, w = b"", b"", np.zeros(4)
    if texts[0, 0] and texts[0, 1] and 0 < labels.sum() < len(labels):
        lines = [{line for t in texts[0, q] for line in t.split("\n")} for q in (0, 1)]
        shared = lines[0] & lines[1]
        bad, good = (dictionary(["\n".join(s for s in t.split("\n") if s not in shared).encode() for t in sorted(texts[0, q])]) for q in (0, 1))
        w = logistic(Compressor(good, bad).features([t.encode() for q in (0, 1) for t in sorted(texts[1, q])]), labels)
    else:
        n = [len(texts[0, q]) + len(texts[1, q]) for q in (0, 1)]
        w[3] = np.log((n[1] + 0.5) / (n[0] + 0.5)) if sum(n) else 0.0
    yield pa.RecordBatch.from_arrays([pa.array([good], pa.binary()), pa.array([bad], pa.binary()), pa.array([w.tolist()])], ["good", "bad", "w"])


def fit(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int = 3000, calibration: int = 6000) -> dict:
    """Dictionaries and calibration from labelled documents of which ``learn`` (on ``doc_id``) holds."""
    known = (
        labels.where(learn).select(F.col("doc_id").alias("id"), "quality").where("id is not null and quality in (0, 1)")
        .groupBy("id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")).where("quality = most")
        .select("id", "quality", F.xxhash64("id").alias("h")).withColumn("role", F.pmod(F.col("h"), F.lit(2)).cast("int"))
    )
    samples = [known.where(f"role = 0 and quality = {q}").orderBy("h").limit(per_class) for q in (0, 1)]
    samples.append(known.where("role = 1").orderBy("h").limit(calibration))
    sample = samples[0].unionByName(samples[1]).unionByName(samples[2])  # at most 2 * per_class + calibration rows
    rows = documents.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(sample), "id").select("role", "quality", "text")
    row = rows.repartition(1).mapInArrow(_fit, "good binary, bad binary, w array<double>").first()
    if row is None:
        return {"good": b"", "bad": b"", "w": [0.0] * 4}
    return {"good": bytes(row["good"]), "bad": bytes(row["bad"]), "w": list(row["w"])}


def scores(model: dict, texts: pa.Array) -> np.ndarray:
    w = np.array(model["w"])
    x = np.zeros((len(texts), 3))
    if w[:3].any():
        x = Compressor(model["good"], model["bad"]).features([(t or "").encode() for t in texts.to_pylist()])
    return 1 / (1 + np.exp(-np.clip(x @ w[:3] + w[3], -30, 30)))


def score_documents(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(shared.value, b.column("text")))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(documents: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents (all columns) that score at least ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            yield b.filter(pa.array(scores(shared.value, b.column("text")) >= threshold))

    return documents.mapInArrow(run, documents.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(documents, fit(documents, labels, fold(F.col("doc_id"), 5) != 0))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
