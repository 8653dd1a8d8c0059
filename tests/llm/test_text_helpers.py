from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import common
from ledgerlens.llm.components import components, spanning

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09 \t\n\x0b\x1c!-é  ßÀ", max_size=30)), max_size=12)


def split(w: common.Words) -> list[list[str]]:
    values = w.values.to_pylist()
    return [[values[i] for i in w.ids[a:b]] for a, b in zip(w.offsets, w.offsets[1:])]


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words_equal_the_patterns(texts):
    column = pa.array(texts, pa.string())
    assert split(common.space_words(column)) == [re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)) for t in texts]
    assert split(common.alnum_words(column)) == [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER)) for t in texts]
    assert split(common.space_words(column.slice(1))) == [re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)) for t in texts[1:]]


def test_slices_keep_rows_and_order():
    batch = pa.record_batch({"text": ["x" * n for n in (5, 0, 100, 3, 3, 40)] + [None], "id": list(range(7))})
    parts = list(common.text_slices(iter([batch, batch.slice(0, 0)]), "text", 20))
    assert len(parts) > 2 and [i for p in parts for i in p["id"].to_pylist()] == list(range(7))


def test_files_round_trip(tmp_path):
    arrays = {"a": np.arange(5), "b": np.zeros(0, dtype=np.uint8), "c": np.array([1.5])}
    common.put_file(f"file:{tmp_path}/x/y.bin", common.pack_arrays(arrays))
    back = common.unpack_arrays(common.map_file(f"file://{tmp_path}/x/y.bin"))
    assert all((back[k] == v).all() and back[k].dtype == v.dtype for k, v in arrays.items())


def test_spanning_forest_and_components(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 400, 260), rng.integers(0, 400, 260)
    chain = np.arange(1000, 1300)
    a, b = np.concatenate([a, chain[1:]]), np.concatenate([b, chain[:-1]])
    root = {int(x): int(x) for x in np.concatenate([a, b])}
    changed = True
    while changed:
        changed = False
        for x, y in zip(a.tolist(), b.tolist()):
            m = min(root[x], root[y])
            changed |= root[x] != m or root[y] != m
            root[x] = root[y] = m
    node, top = spanning(a, b)
    assert {int(n): int(t) for n, t in zip(node, top)} == {n: t for n, t in root.items() if n != t}
    links = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)] + [(None, 3), (9999, 9999)], "a long, b long").repartition(7)
    found = {r.node: r.component for r in components(links).collect()}
    linked = {n: t for n, t in root.items() if n in found}
    assert found == linked and all(n == t for n, t in root.items() if n not in found)
    assert components(links.limit(0)).count() == 0
