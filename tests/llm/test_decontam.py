from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from ledgerlens.llm import decontam
from tests.llm.conftest import ODD, rows_of
from tests.llm.test_text_helpers import LOWER


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(texts, items):
    windows: dict = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for text in texts:
        w, found = words(text), set()
        hit = [0] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [1] * n
        out.append((len(w), sum(hit), sorted(x for x in found if x is not None)))
    return out


def ours(texts, blocks):
    n, hit, items, spans = decontam.contamination_of(pa.array(texts, pa.string()), [decontam.Queries(b) for b in blocks])
    assert [sum(s["last"] - s["first"] + 1 for s in x) for x in spans] == hit.tolist()
    return list(zip(n.tolist(), hit.tolist(), items))


def test_query_equals_brute_force(spark, sf):
    d, b = rows_of("documents"), rows_of("benchmark")
    expected = {}
    for i, (n, hit, items) in zip(d["doc_id"], brute(d["text"], [(str(x), t) for x, t in zip(b["item_id"], b["text"])])):
        expected[i] = (n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0)
    got = {r.doc_id: tuple(r)[1:] for r in decontam.op8_decontamination(spark, sf).collect()}
    assert got == expected and any(x[-1] for x in got.values())


def test_small_alphabets_shards_and_blocks(monkeypatch):
    r = random.Random(5)
    for turn in range(80):
        monkeypatch.setattr(decontam, "SHARD", r.choice([20, 50, 1 << 20]))
        texts = [" ".join(r.choice("abc" if turn % 2 else "ab") for _ in range(r.randrange(0, 150))) for _ in range(r.randrange(1, 6))]
        items = [(str(k), " ".join(r.choice("abcd") for _ in range(r.randrange(0, 14)))) for k in range(8)]
        assert ours(texts, [items]) == brute(texts, items) == ours(texts, [items[:3], items[3:]])


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    for alphabet in (2, 3, 40):
        text = rng.integers(0, alphabet, 400)
        text[-1] = 0
        order = decontam.suffix_array(text, alphabet)

        def key(i):
            end = i + int(np.flatnonzero(text[i:] == 0)[0])
            return (*text[i:end].tolist(), 0, end)

        assert order.tolist() == sorted(range(400), key=key)


def test_odd_rows(spark, documents):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "the same text here"), (4, "word"), (None, "A")], "item_id long, text string")
    frame = documents(ODD, extra=True)
    got = {r.doc_id: r for r in decontam.contamination(frame, items).collect()}
    expected = brute(ODD, [("4", "the same text here"), ("4", "word"), (None, "a")])
    assert [(got[i].n_words, got[i].n_hit, got[i].items) for i in range(len(ODD))] == expected
    clean = decontam.drop_contaminated(frame, items)
    assert clean.columns == frame.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, x in enumerate(expected) if not x[1]]
    assert decontam.contamination(frame, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(frame.limit(0), items).count() == 0


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    result = decontam.op8_decontamination(spark, sf)
    sql = con.execute(decontam.OP8_SQL)
    columns = [c[0] for c in sql.description]
    assert sorted(map(tuple, sql.fetchall())) == sorted(map(tuple, result.select(*columns).collect()))


def test_blocks_are_written_by_tasks_and_read_one_at_a_time(spark, documents, monkeypatch):
    """The same result whatever the number of blocks; repeated items go once."""
    texts = ["one two three four five six seven eight nine ten eleven", "a b c", "nothing here", None, "six seven eight nine ten eleven twelve a b c"]
    items = [(i, t) for i, t in enumerate(["two three four five six seven eight nine ten eleven", "a b c", "seven eight nine", "", None, "twelve a"])] + [(7, "a b c")] * 50
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def run():
        found = decontam.contamination(documents(texts), benchmark).collect()
        return sorted((r.doc_id, r.n_words, r.n_hit, sorted(r.items), sorted((s.first, s.last) for s in r.spans)) for r in found)

    whole = run()
    assert len(decontam._blocks(benchmark, decontam.WINDOW).numbers) == 1 and any(r[2] for r in whole)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 12)
    assert len(decontam._blocks(benchmark, decontam.WINDOW).numbers) > 2
    assert run() == whole
    kept = {r.doc_id for r in decontam.drop_contaminated(documents(texts), benchmark).collect()}
    assert kept == {r[0] for r in whole if not r[2]}
    assert not any(r.n_hit for r in decontam.contamination(documents(texts), benchmark.limit(0)).collect())
