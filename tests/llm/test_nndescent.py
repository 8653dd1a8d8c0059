from __future__ import annotations

import numpy as np
import pytest

from ledgerlens.llm import nndescent


def brute(rows, threshold=0.95):
    """(links, smallest reachable id) per row, comparing all pairs."""
    x = [np.array(v, dtype=float) if v and None not in v else None for _, v in rows]
    ok = [v is not None and np.isfinite(v).all() and bool(np.any(v)) for v in x]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k in range(n):
        least[top(k)] = min(least.get(top(k), rows[k][0]), rows[k][0])
    return [(rows[k][0], links[k], least[top(k)], rows[k][0] == least[top(k)]) for k in range(n)]


def clustered(rng, dim=24):
    """Random vectors, pairs, chains, exact copies and one dense group."""
    base = rng.normal(size=(150, dim))
    rows = [*base, *(base[:40] + 0.12 * rng.normal(size=(40, dim))), *base[:5], *(base[7] + 0.1 * rng.normal(size=(70, dim)))]
    chain = base[9]
    for _ in range(8):
        chain = chain + 0.2 * rng.normal(size=dim)
        rows.append(chain)
    ids = rng.permutation(len(rows)) + 3
    return [(int(i), [float(c) for c in v]) for i, v in zip(ids, rows)]


@pytest.mark.parametrize("block", [1024, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nndescent, "BLOCK", block)
    monkeypatch.setattr(nndescent, "SPAN", 8)
    rows = clustered(np.random.default_rng(3))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(tuple(r) for r in nndescent.near_vectors(frame, k=4).collect())
    expected = sorted(brute(rows))
    found, all_links = sum(min(g[1], e[1]) for g, e in zip(got, expected)), sum(e[1] for e in expected)
    assert all(g[1] <= e[1] for g, e in zip(got, expected)) and found >= 0.95 * all_links
    assert got == expected or found < all_links


def around(rng, centre, noise, n):
    return centre + noise * rng.normal(size=(n, len(centre))) / np.sqrt(len(centre))


def result(spark, vectors):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    return sorted(tuple(r) for r in nndescent.near_vectors(frame).collect()), sorted(brute(rows))


def test_pairs_beside_a_hot_group(spark, monkeypatch):
    """Few vectors look at how the search did, and a large group has nearly all links: the pairs must come all the same."""
    monkeypatch.setattr(nndescent, "TREES", 1)
    monkeypatch.setattr(nndescent, "ROUNDS", 0)
    monkeypatch.setattr(nndescent, "SPAN", 4)
    monkeypatch.setattr(nndescent, "AUDIT", 30, raising=False)
    monkeypatch.setattr(nndescent, "BLOCK", 64)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    got, expected = result(spark, np.concatenate([base, [around(rng, v, 0.25, 1)[0] for v in base], around(rng, base[0], 0.1, 200)]))
    assert got == expected


def test_dense_groups_that_touch(spark, monkeypatch):
    """Two groups with more near copies than a list holds, linked only by their farther members."""
    monkeypatch.setattr(nndescent, "AUDIT", 1, raising=False)
    rng = np.random.default_rng(5)
    a, b = np.eye(32)[0], np.eye(32)[0] * np.cos(0.36) + np.eye(32)[1] * np.sin(0.36)
    got, expected = result(spark, np.concatenate([around(rng, a, 0.08, 60), around(rng, b, 0.08, 60)]))
    assert len({r[2] for r in expected}) == 1 and min(r[1] for r in expected) >= 59
    assert got == expected


def test_query_on_the_embeddings(spark, sf):
    import pyarrow.dataset as ds

    d = ds.dataset(f"{sf}/embeddings.parquet").to_table().to_pydict()
    expected = sorted(brute(list(zip(d["vec_id"], d["embedding"]))))
    assert sorted(tuple(r) for r in nndescent.op4_embeddings(spark, sf).collect()) == expected


def test_odd_vectors(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
        (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e-200, 1e-202]), (12, [1e200, 1e200]), (13, [-0.0, 5.0]), (14, [0.0, 5.0]),
    ]
    frame = spark.createDataFrame([(i, v, 7, 7) for i, v in rows], "vec_id long, embedding array<double>, node long, component long")
    got = sorted(tuple(r) for r in nndescent.near_vectors(frame).collect())
    links = {7: 3, 8: 3, 11: 3, 13: 1, 14: 1}
    least = {7: 7, 8: 7, 11: 7, 13: 13, 14: 13}
    assert got == sorted((i, links.get(i, 0), least.get(i, i), least.get(i, i) == i) for i, _ in rows)
    assert nndescent.near_vectors(frame.limit(0)).count() == 0
    floats = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in nndescent.near_vectors(floats).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
