"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of 1 to 3 characters of each lower-cased word with its borders, hashed to ``BUCKETS``; a document's value is
its share of n-grams times the inverse document frequency, which is counted over all learnable documents. Weights come from
follow-the-regularised-leader with an elastic net (per-coordinate rates, L1 leaves most weights zero), fitted on at most
``sample`` whole documents (a parameter) in the order of a hash of ``doc_id``; a fifth of them is kept back to calibrate one
temperature. As the model is linear in n-gram counts, a task scores each distinct word of a slice once.

Null text or a text without a letter: ``und``, score 0. A letter is any Unicode letter. Null ``lang``: not learned from.
Without anything to learn from every text is ``und``. Repeated documents: a row each. Empty table: no rows. ``lang``,
``source`` and ``doc_id`` are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import Words, _split, _strings, ragged, segment_sums, text_slices

BITS = 16
BUCKETS = 1 << BITS
SCALE = 40.0
CHUNK = 4096
SAMPLE = 4000
UND = "und"


def words_of(texts: pa.Array) -> Words:
    return _split(pc.utf8_lower(_strings(texts)))


def word_grams(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): hashed n-grams (n = 1, 2, 3) of each word between borders."""
    sizes = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    text = " ".join(["", *(" " + v for v in values.to_pylist())])[1:] + " " if len(values) else ""
    # every word as space, characters, space
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(2, dtype=np.uint64)])
    last = np.repeat(offsets[1:], sizes)
    at = np.arange(n)
    grams, owner = [], []
    word = np.repeat(np.arange(len(sizes)), sizes)
    key = padded[:n] + np.uint64(1)
    for k in range(3):
        if k:
            key = key * np.uint64(0x110003) + padded[k : n + k] + np.uint64(1)
        ok = at + k < last
        if k == 0:
            ok &= codes != 32
        h = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        grams.append((h >> np.uint64(64 - BITS)).astype(np.int64)[ok])
        owner.append(word[ok])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return grams[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])


def _document_buckets(w: Words, grams: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts of words) per document, one entry per n-gram of its distinct words."""
    for a, b in zip(w.offsets, w.offsets[1:]):
        ids, times = np.unique(w.ids[a:b], return_counts=True)
        n = offsets[ids + 1] - offsets[ids]
        yield grams[ragged(offsets[ids], n)], np.repeat(times, n)


def inverse_frequencies(documents: DataFrame) -> np.ndarray:
    """log((1 + N) / (1 + df)) + 1 of every bucket, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + CHUNK, dtype=np.int64)
        for b in text_slices(batches, "text"):
            w = words_of(b.column("text"))
            for buckets, _ in _document_buckets(w, *word_grams(w.values)):
                df[pd.unique(buckets)] += 1
            df[BUCKETS] += b.num_rows
        rows = df.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["chunk", "df"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in table["df"].to_pylist())
        return pa.table({"chunk": table["chunk"].slice(0, 1), "df": pa.array([total.tobytes()], pa.binary())})

    kind = "chunk int, df binary"
    rows = documents.select("text").mapInArrow(run, kind).groupBy("chunk").applyInArrow(add, kind).orderBy("chunk").collect()
    if not rows:
        return np.ones(BUCKETS)
    df = np.concatenate([np.frombuffer(r["df"], dtype=np.int64) for r in rows])
    return np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1


class Ftrl:
    """Multinomial FTRL-proximal with L1 and L2 penalties."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
        self.bias = np.zeros((2, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def intercept(self) -> np.ndarray:
        return -self.bias[0] / ((self.beta + np.sqrt(self.bias[1])) / self.alpha + self.l2)

    def learn(self, rows: np.ndarray, x: np.ndarray, y: int) -> None:
        w, b = self.weights(rows), self.intercept()
        p = softmax((x @ w + b)[None])[0]
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g
        self.bias[0] += p - (np.sqrt(self.bias[1] + p * p) - np.sqrt(self.bias[1])) / self.alpha * b
        self.bias[1] += p * p


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(y)), y]
        return -np.log(np.maximum(p, 1e-12)).mean()

    a, b, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(texts: list[str], langs: list[str], idf: np.ndarray, epochs: int = 4) -> dict:
    names = sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    y = np.array([place[x] for x in langs])
    x = []
    for k in range(0, len(texts), 500):
        w = words_of(pa.array(texts[k : k + 500], pa.large_string()))
        for buckets, times in _document_buckets(w, *word_grams(w.values)):
            count = np.bincount(buckets, weights=times, minlength=BUCKETS)
            rows = np.flatnonzero(count)
            x.append((rows, (count[rows] / max(count.sum(), 1) * idf[rows] * SCALE)))
    kept = np.arange(len(x)) % 5 == 4
    model = Ftrl(len(names))
    order = np.random.default_rng(11).permutation(np.flatnonzero(~kept))
    for _ in range(epochs):
        for i in order:
            model.learn(*x[i], y[i])
    w, b = model.weights(slice(None)), model.intercept()
    back = np.flatnonzero(kept)
    heat = temperature(np.stack([x[i][1] @ w[x[i][0]] + b for i in back]), y[back]) if len(back) else 1.0
    return {"names": names, "weights": (w * idf[:, None] * SCALE).astype(np.float32), "bias": b, "temperature": heat}


def fit(documents: DataFrame, learn: Column, sample: int = SAMPLE) -> dict:
    """The model of the documents of which ``learn`` holds and whose ``lang`` is known."""
    known = documents.where(learn & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    idf = inverse_frequencies(known)
    order = known.select("doc_id", F.xxhash64("doc_id", "lang").alias("h")).distinct().orderBy("h", "doc_id").limit(sample)
    rows = known.join(F.broadcast(order.select("doc_id")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sorted({(t or "", x) for b in batches for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist())}, key=lambda p: (hash_of(p[0]), p))
        if not pairs:
            return
        m = train([t for t, _ in pairs], [x for _, x in pairs], idf)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m["names"]]), pa.array([m["weights"].tobytes()], pa.binary()), pa.array([m["bias"].tolist()]), pa.array([m["temperature"]])],
            ["names", "weights", "bias", "temperature"],
        )

    row = rows.select("text", "lang").repartition(1).mapInArrow(run, "names array<string>, weights binary, bias array<double>, temperature double").first()
    if row is None:
        return {"names": [], "weights": np.zeros((BUCKETS, 0), dtype=np.float32), "bias": np.zeros(0), "temperature": 1.0}
    names = list(row["names"])
    return {
        "names": names, "weights": np.frombuffer(row["weights"], dtype=np.float32).reshape(BUCKETS, len(names)), "bias": np.array(row["bias"]),
        "temperature": row["temperature"],
    }


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def predict(texts: pa.Array, model: dict) -> tuple[list[str], np.ndarray]:
    n = len(texts)
    if not model["names"]:
        return [UND] * n, np.zeros(n)
    w = words_of(texts)
    grams, offsets = word_grams(w.values)
    per_word = segment_sums(model["weights"][grams].astype(np.float64), offsets)
    total = segment_sums(np.diff(offsets)[w.ids], w.offsets)
    logits = segment_sums(per_word[w.ids], w.offsets) / np.maximum(total, 1)[:, None] + model["bias"]
    p = softmax(logits / model["temperature"])
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    best = p.argmax(axis=1)
    names = [model["names"][i] if ok else UND for i, ok in zip(best.tolist(), letters.tolist())]
    return names, np.where(letters, p[np.arange(n), best], 0.0)


def identify(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            names, score = predict(b.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    return identify(documents, fit(documents, fold != 1)).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")
