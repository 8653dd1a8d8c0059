from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from ledgerlens.llm import chat
from tests.llm.conftest import rows_of

KIND = "conv_id long, turn long, role string, text string"
CONTROL = ["", "\\", "### ", "</turn>", "\\### Assistant: </turn> ok", "#\\## <\\/turn>", "<|endoftext|>", "a\n</turn>\n### assistant\nb", "  lead", "trail \n ", "\n", "\\n", "é \U0001f600 ́", "\x00\x1c\x85 ", "##### ", "<</turn>>"]


@pytest.fixture(scope="module")
def path() -> str:
    return chat.default_tokenizer()


def render(role: str, text: str) -> str:
    def esc(s: str) -> str:
        s = s.replace("\\", "\\\\")
        for c in ("### ", "</turn>", "<|endoftext|>"):
            s = s.replace(c, c[0] + "\\" + c[1:])
        return s

    return "### " + esc(role).replace("\n", "\\n") + "\n" + esc(text) + "\n</turn>\n"


def conversations(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r[:2]) + ((r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def expected(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turns in conversations(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), sum(len(render(r, t)) for r, t in turns)))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def run(spark, path, rows, **more):
    return chat.read_back(chat.format_conversations(spark.createDataFrame(rows, KIND), path, **more), path)


def test_query_equals_plain_texts(spark, sf):
    t = rows_of("conversations")
    rows = list(zip(*(t[c] for c in ("conv_id", "turn", "role", "text")))) + [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    assert got(chat.op12_chat(spark, sf)) == expected(rows)


def odd_rows() -> list[tuple]:
    rows = [(i, k, role, text) for i, text in enumerate(CONTROL) for k, role in enumerate(("user", "assistant", "assistant"))]
    rows += [(100, 0, None, "x"), (100, 1, "assistant", None), (100, None, "user", "first"), (101, 0, "a\nb\\n### ", "text"), (102, 0, "assistant", "only")]
    rows += [(103, 5, "assistant", "same"), (103, 5, "assistant", "same"), (103, 5, "assistant", "Other"), (103, 5, "user", "same")]
    return rows + [(None, 0, "user", "no id"), (None, 1, "assistant", "answer"), (104, 0, "assistant", "word " * 60_000), (104, 1, "user", "w" * 5000)]


def test_odd_rows(spark, path):
    assert got(run(spark, path, odd_rows())) == expected(odd_rows())


@pytest.mark.parametrize("piece", [1, 200, chat.PIECE])
def test_ids_and_masks_of_pieces_are_those_of_the_whole(spark, path, piece):
    """A conversation with most rows over several partitions, in pieces of any size."""
    rng = random.Random(piece)
    rows = [(5, i, rng.choice(["user", "assistant"]), " ".join(rng.choices(CONTROL + ["plain words"], k=3))) for i in range(120)]
    rows += [(i, k, "assistant" if k else "user", rng.choice(CONTROL)) for i in (1, 2, 9) for k in range(3)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, KIND), path, piece=piece)
    pieces = sorted(formatted.collect(), key=lambda r: (r["part"], r["seq"]))
    coder = chat.Coder(path)
    assert len({r["part"] for r in pieces if r["conv_id"] == 5}) > 1
    for conv, turns in conversations(rows).items():
        own = [r for r in pieces if r["conv_id"] == conv]
        text = "".join(render(*t) for t in turns)
        whole = coder.tokenizer.encode(text, add_special_tokens=False)
        assert [i for r in own for i in r["ids"]] == whole.ids
        assert coder.tokenizer.decode(whole.ids, skip_special_tokens=False) == text
        # a token is learned exactly if it shares a byte with an assistant's text
        ends = np.cumsum([0, *(len(coder.bytes_of(np.array([i]))) for i in whole.ids)])
        spans, at = [], 0
        for role, t in turns:
            body = len(render(role, t).encode())
            head = len(render(role, "").encode()) - len("\n</turn>\n")
            if role == "assistant":
                spans.append((at + head, at + body - len("\n</turn>\n")))
            at += body
        want = [any(a < e and s < b for a, b in spans) for s, e in zip(ends, ends[1:])]
        assert [x for r in own for x in r["loss"]] == want
    assert got(chat.read_back(formatted, path)) == expected(rows)


def test_long_texts_in_segments(path):
    coder, rng = chat.Coder(path), random.Random(3)
    words = ["don't", "we'll", "été", "日本", "x1", "--", "...", "  ", "\n", "\t", "A", "’s", "_"]
    text = " ".join(rng.choices(words, k=60_000))
    assert len(chat._segments(text)) > 2 and "".join(chat._segments(text)) == text
    for t in (text, "", "z" * 100_000, " " * 70_000):
        assert coder.encode([t])[0].tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_escapes_come_back(path):
    import pyarrow as pa

    controls = chat.Coder(path).controls
    rng = random.Random(1)
    texts = CONTROL + ["".join(rng.choices("#\\ </turn>n\n|endoftext", k=rng.randrange(60))) for _ in range(5000)]
    for text, out in zip(texts, chat.escape(pa.array(texts, pa.large_string()), controls).to_pylist()):
        assert not any(c in out for c in controls)
        assert chat.unescape(out) == text


def test_other_learned_roles_clashing_columns_and_no_rows(spark, path):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 7, "w", [1], "k", 3) for r in rows], KIND + ", part int, whole string, ids array<int>, hash string, at int")
    assert got(chat.read_back(chat.format_conversations(df, path), path)) == expected(rows)
    user = got(run(spark, path, rows, learned=("user",)))
    assert [r[:3] for r in user] == [r[:3] for r in expected(rows)] and user != expected(rows)
    assert run(spark, path, []).collect() == []
