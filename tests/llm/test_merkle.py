from __future__ import annotations

import hashlib
import zlib

import pytest

from ledgerlens.llm import merkle
from tests.llm.conftest import DOCUMENT, ODD, rows_of


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: dict, text) -> str:
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lowered(text):
    return text if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def root_of(digests: list[str]) -> tuple[str, list[list[list[str]]]]:
    """(root, levels of runs)"""
    levels = []
    while len(digests) > 1:
        runs = [digests[i : i + 16] for i in range(0, len(digests), 16)]
        levels.append(runs)
        digests = [h("".join(r)) for r in runs]
    return digests[0], levels


def expected(rows: list[dict]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"], leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = root_of([d for _, d, _ in groups[s]])
    root, top = root_of([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for at, s in enumerate(names):
        for i, (doc, own, r) in enumerate(groups[s]):
            change = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
            fold, siblings = leaf(r, lowered(r["text"]) if change else r["text"]), ""
            for k, levels in ((i, trees[s][1]), (at, top)):
                for runs in levels:
                    run, slot = runs[k // 16], k % 16
                    siblings += "".join(run[:slot] + run[slot + 1 :])
                    fold = h("".join(run[:slot] + [fold] + run[slot + 1 :]))
                    k //= 16
            out.append((doc, own, trees[s][0], root, h(siblings), fold, fold == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def table(spark, rows: list[dict]):
    return spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCUMENT)


def made(n: int, source) -> list[dict]:
    return [{"doc_id": i * 7 % 1009, "text": f"Text Number {i}", "lang": "en", "source": source(i), "n_chars": i} for i in range(n)]


def test_query_equals_plain_trees(spark, sf):
    t = rows_of("documents")
    rows = [dict(zip(t, r)) for r in zip(*t.values())]
    assert got(merkle.op13_merkle(spark, sf)) == expected(rows)


@pytest.mark.parametrize("n, source", [(1, lambda i: "a"), (16, lambda i: "a"), (17, lambda i: "b"), (290, lambda i: "hot" if i % 3 else f"s{i % 40}")])
def test_sizes_of_runs(spark, n, source):
    rows = made(n, source)
    assert got(merkle.verified(table(spark, rows))) == expected(rows)


def test_odd_rows(spark):
    rows = [{"doc_id": i, "text": t, "lang": None if i % 2 else "en", "source": None if i % 3 else "é", "n_chars": None if i % 4 else i} for i, t in enumerate(ODD)]
    rows += [dict(rows[4]), dict(rows[4]), {**rows[4], "text": "another"}, {**rows[0], "doc_id": None}, {**rows[4], "doc_id": None}, {**rows[4], "source": ""}]
    assert got(merkle.verified(table(spark, rows))) == expected(rows)


def test_clashing_columns_change_nothing(documents):
    plain, extra = (merkle.verified(documents(ODD, extra=x).withColumnRenamed("row", "idx" if x else "row")) for x in (False, True))
    assert got(plain) == got(extra)


def test_empty_table(documents):
    assert merkle.verified(documents([])).collect() == []


def test_any_change_of_a_leaf_is_seen(spark):
    rows = made(40, lambda i: f"s{i % 3}")
    placed, root = merkle.document_manifest(table(spark, rows))
    from pyspark.sql import functions as F

    out = placed.select(merkle.folded(F.col("path"), F.col("digest")).alias("same"), merkle.folded(F.col("path"), F.sha2(F.col("digest"), 256)).alias("other")).collect()
    assert all(r["same"] == root for r in out) and all(r["other"] != root for r in out) and len({r["other"] for r in out}) == 40


def test_no_python_in_the_plan(spark, sf):
    from ledgerlens.plans.inspect import physical_plan

    plan = physical_plan(merkle.op13_merkle(spark, sf))
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
