"""Helpers shared by the operators: Arrow word columns, shared-folder tables, packed bits."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import ensure_checkpoint_dir

#: bytes of text handled at once inside a task
SLICE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A-Z to a-z, every other ASCII byte but 0-9 and a-z to a space, bytes of other characters unchanged
_ALNUM = _LOWER.copy()
for _b in range(128):
    if not (48 <= _b <= 57 or 65 <= _b <= 90 or 97 <= _b <= 122):
        _ALNUM[_b] = 32


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder of ``spark.checkpoint.dir`` (shared by all executors)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of a slice stays near ``limit`` bytes (a longer row is a slice of its own)."""
    pa.set_cpu_count(1)  # a task is one core; more threads only hold memory of their own
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


class Words:
    """Words of some texts: ``ids`` index ``values`` (distinct words); text i has ids[offsets[i]:offsets[i + 1]]."""

    __slots__ = ("values", "ids", "offsets")

    def __init__(self, values: pa.Array, ids: np.ndarray, offsets: np.ndarray):
        self.values, self.ids, self.offsets = values, ids, offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def _strings(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts.cast(pa.large_string()), "")


def _mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts with each byte replaced through ``table`` (which keeps bytes above 127)."""
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    new = table[np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(new))


def _split(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    values = coded.dictionary
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    empty = pc.index(values, pa.scalar("", type=values.type)).as_py()
    if empty >= 0:
        keep = ids != empty
        kept = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(keep, out=kept[1:])
        ids, offsets = ids[keep], kept[offsets]
    return Words(values, ids, offsets)


def space_words(texts: pa.Array, lower: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered unless told otherwise; a null text has none."""
    texts = _strings(texts)
    return _split(_mapped(texts, _LOWER) if lower else texts)


def alnum_words(texts: pa.Array) -> Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z; a null text has none."""
    return _split(_mapped(_strings(texts), _ALNUM))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each (start, length), one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i (0 for an empty segment)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


# ---- files in the shared folder, written and read by tasks ----

def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def put_file(uri: str, data: bytes) -> None:
    """Write a file whole: a second run of the same task replaces it by the same content."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, at)


def map_file(uri: str) -> np.ndarray:
    """The file's bytes, memory-mapped; from a remote store by way of an unlinked local copy."""
    path = _local(uri)
    if path is not None:
        return np.asarray(np.memmap(path, dtype=np.uint8, mode="r"))
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as f, store.open_input_stream(at) as src:
        while chunk := src.read(1 << 22):
            f.write(chunk)
        f.flush()
        return np.asarray(np.memmap(f, dtype=np.uint8, mode="r"))


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays in one file: a header of (name, type, length) lines, then the arrays at multiples of 8 bytes."""
    head, body, at = [], [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        pad = -len(raw) % 8
        head.append(f"{name} {a.dtype.str} {len(a)} {at}")
        body += [raw, b"\0" * pad]
        at += len(raw) + pad
    text = "\n".join(head).encode()
    return len(text).to_bytes(8, "little") + text + b" " * (-len(text) % 8) + b"".join(body)


def unpack_arrays(data: np.ndarray) -> dict[str, np.ndarray]:
    n = int.from_bytes(data[:8].tobytes(), "little")
    base = 8 + n + (-n % 8)
    out = {}
    for line in data[8 : 8 + n].tobytes().decode().splitlines():
        name, kind, count, at = line.split(" ")
        t = np.dtype(kind)
        out[name] = data[base + int(at) : base + int(at) + int(count) * t.itemsize].view(t)
    return out


def bits_of(mask: np.ndarray) -> np.ndarray:
    """Booleans as little-endian 64-bit words with one spare word."""
    packed = np.packbits(mask, bitorder="little")
    out = np.zeros((len(mask) // 64 + 2) * 8, dtype=np.uint8)
    out[: len(packed)] = packed
    return out.view(np.uint64)
