"""Conversations formatted for training: one token sequence each, with a loss mask aligned to the assistants' texts.

Template: each turn is ``### role``, a line break, the text, a line break and ``</turn>`` on a line of its own. A control
string (both marks, and the strings of the tokenizer's added tokens) inside a role or text gets a backslash after its
first character, a backslash is doubled, a line break in a role is written ``\\n``; so marks stand only where the template
put them, and removing the escapes gives the texts back.

A conversation is rendered whole and encoded once. A byte-level BPE keeps every byte, so the running sum of its tokens'
byte lengths is their offsets; the sorted spans of the masked texts are laid over the sorted token spans by binary search.
``loss`` marks every token that shares a byte with a masked text, and ``edges`` says for each masked text which tokens
those are and how many bytes at both ends belong to the template (a line break may be one token with the white space that
begins a text).

Conversations are range-partitioned by (id, turn, role, text) and streamed in order, so one with a third of all rows lies
across many tasks. It is then several pieces, cut between turns: a turn ends with a line break that a mark follows, where
the tokenizer always splits, so the pieces' ids in order are the ids of the whole. The same holds inside a long text at a
space between two word characters, which bounds what goes through the tokenizer at once. Reading back digests pieces where
they lie; only conversations with more than one piece or at a partition's ends are brought together, piece by piece.

Turns stand in order of ``turn`` (null first), equal ones by role, then text; repeated rows are repeated turns. Null role
or text: empty. Null ``conv_id``: one conversation, the first. Empty text: a turn with nothing to learn. Empty table: no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import ragged, stored

HEAD, TAIL = "### ", "\n</turn>\n"
MARKS = ("### ", "</turn>")
LEARNED = ("assistant",)
#: characters of a conversation in one row of the output, and characters rendered at once
PIECE = 4 << 20
#: characters after which a long text is cut at the next safe place for the tokenizer
SEGMENT = 1 << 16
FORMATTED = (
    "part int, seq long, conv_id long, whole boolean, n_chars long, ids array<int>, loss array<boolean>, "
    "edges array<struct<first:int,past:int,skip:int,drop:int>>"
)
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: key columns sent to the driver as samples for the ranges are cut to so many characters
KEY = 64


def escape(texts: pa.Array, controls: list[str]) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for c in controls:
        texts = pc.replace_substring(texts, c, c[0] + "\\" + c[1:])
    return texts


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for turn in formatted.split(TAIL)[:-1]:
        role, _, text = turn[len(HEAD) :].partition("\n")
        out.append((unescape(role), unescape(text)))
    return out


class Coder:
    """The tokenizer with its tokens' bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.controls = [*MARKS, *(t.content for t in added.values())]
        for c in self.controls:  # else escaping one occurrence could leave another that overlaps it
            assert len(c) > 1 and "\\" not in c and not any(c[:k] == c[-k:] for k in range(1, len(c))), c
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        table = _byte_alphabet()
        tokens = [b""] * size
        for token, i in vocabulary.items():
            tokens[i] = added[i].content.encode() if i in added else bytes(table[c] for c in token)
        self.lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts, counts = [], []
        for t in texts:
            cut = _segments(t)
            parts += cut
            counts.append(len(cut))
        ids = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        ends = np.cumsum(counts)
        return [ids[e - n] if n == 1 else np.concatenate(ids[e - n : e]) for e, n in zip(ends.tolist(), counts)]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[ragged(self.starts[ids], self.lengths[ids])]


def _byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes are themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


_SAFE = re.compile(r"(?<=\w) (?=\w)")


def _segments(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > SEGMENT and (m := _SAFE.search(text, at + SEGMENT)):
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def overlaps(starts: np.ndarray, ends: np.ndarray, token_starts: np.ndarray, token_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, past, skip, drop) of each span: tokens first..past share a byte with it; skip and drop bytes of them do not."""
    first = np.searchsorted(token_ends, starts, side="right")
    past = np.searchsorted(token_starts, ends, side="left")
    some = ends > starts
    past = np.where(some, past, first)
    last = np.maximum(past - 1, 0)
    skip = np.where(some, starts - token_starts[np.minimum(first, len(token_starts) - 1)], 0)
    drop = np.where(some, token_ends[last] - ends, 0)
    return first, past, skip, drop


def _formatter(tokenizer: str, learned: tuple[str, ...], piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = coder(tokenizer), TaskContext.get().partitionId()
        done: list[tuple] = []  # (conv_id, whole, rendered, spans) of closed pieces
        held = {"id": None, "open": False, "first": True, "cut": False, "text": [], "chars": 0, "bytes": 0, "spans": []}
        seq = weight = 0

        def close(end: bool, last: bool = False) -> None:
            """Close the piece; ``end``: the conversation ends here, ``last``: or may go on in the next partition."""
            nonlocal weight
            if held["text"]:
                whole = end and not last and not held["first"] and not held["cut"]
                done.append((held["id"], whole, "".join(held["text"]), np.array(held["spans"], dtype=np.int64).reshape(-1, 2)))
                weight += held["chars"]
            held.update(text=[], chars=0, bytes=0, spans=[], cut=not end)

        def flush() -> pa.RecordBatch:
            nonlocal seq, weight
            rows = []
            for (conv, whole, text, spans), ids in zip(done, code.encode([d[2] for d in done])):
                ends = np.cumsum(code.lengths[ids])
                first, past, skip, drop = overlaps(spans[:, 0], spans[:, 1], ends - code.lengths[ids], ends)
                loss = np.zeros(len(ids), dtype=bool)
                loss[ragged(first, past - first)] = True
                edges = [dict(zip(("first", "past", "skip", "drop"), e)) for e in zip(first.tolist(), past.tolist(), skip.tolist(), drop.tolist())]
                rows.append((conv, whole, len(text), ids, loss, edges))
            n = len(rows)
            offsets = pa.array(np.cumsum([0, *(len(r[3]) for r in rows)]), pa.int32())
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int32()), pa.array(np.arange(seq, seq + n)), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[3] for r in rows]))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[4] for r in rows]))),
                    pa.array([r[5] for r in rows], pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "past", "skip", "drop")]))),
                ],
                ["part", "seq", "conv_id", "whole", "n_chars", "ids", "loss", "edges"],
            )
            seq += n
            done.clear()
            weight = 0
            return out

        for b in batches:
            role, text = (pc.fill_null(b.column(c).cast(pa.large_string()), "") for c in ("role", "text"))
            masked = pc.is_in(role, pa.array(learned, pa.large_string())).to_pylist()
            role = pc.replace_substring(escape(role, code.controls), "\n", "\\n")
            text = escape(text, code.controls)
            head = (pc.binary_length(role).to_numpy() + len(HEAD) + 1).tolist()
            size = pc.binary_length(text).to_pylist()
            head_mark, line, tail, none = (pa.scalar(x, pa.large_string()) for x in (HEAD, "\n", TAIL, ""))
            whole = pc.binary_join_element_wise(head_mark, role, line, text, tail, none).to_pylist()
            for conv, turn, learn, h, n in zip(b.column("conv_id").to_pylist(), whole, masked, head, size):
                if held["open"] and conv != held["id"]:
                    close(True)
                    held.update(first=False)
                elif held["chars"] >= piece:
                    close(False)
                if weight >= piece:
                    yield flush()
                held.update(id=conv, open=True)
                if learn:
                    held["spans"].append((held["bytes"] + h, held["bytes"] + h + n))
                held["text"].append(turn)
                held["chars"] += len(turn)
                held["bytes"] += h + n + len(TAIL)
        close(True, last=True)
        if done:
            yield flush()

    return run


def format_conversations(conversations: DataFrame, tokenizer: str, learned: tuple[str, ...] = LEARNED, piece: int = PIECE) -> DataFrame:
    """A table of pieces in the shared folder: (part, seq) orders the pieces of a conversation, most have one."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    c = c.select("*", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"))
    keyed = c.select(
        "conv_id", "turn", "role", "text", F.substring("r", 1, KEY).alias("role_key"), F.substring("t", 1, KEY).alias("text_key"),
        F.xxhash64("r", "t").alias("hash"), F.monotonically_increasing_id().alias("at"),
    )
    keys = ["conv_id", "turn", "role_key", "text_key", "hash", "at"]  # ascending, nulls first
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("conv_id", "role", "text")
    return stored(ordered.mapInArrow(_formatter(tokenizer, tuple(learned), piece), FORMATTED), "chat")


class _Digest:
    """Of one conversation, from its pieces in order."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, raw: np.ndarray, starts: np.ndarray, n_chars: int, edges: list[dict]) -> None:
        formatted = raw.tobytes().decode()
        for role, text in turns_of(formatted):
            self.text.update(f"{role}\n{text}\n".encode())
            self.turns += 1
        for e in edges:
            if e["past"] > e["first"]:
                under = unescape(raw[starts[e["first"]] + e["skip"] : starts[e["past"]] - e["drop"]].tobytes().decode())
                self.loss.update(under.encode())
                self.loss_chars += len(under)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.turns, self.text.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _reader(tokenizer: str):
    """Digests of the conversations of a stream of pieces in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, now = coder(tokenizer), None
        for b in batches:
            rows = []
            ids = b.column("ids")
            for conv, n, own, loss, edges in zip(b.column("conv_id").to_pylist(), b.column("n_chars").to_pylist(), ids, b.column("loss"), b.column("edges").to_pylist()):
                if now is None or now.conv != conv:
                    if now is not None:
                        rows.append(now.row())
                    now = _Digest(conv)
                tokens = own.values.to_numpy()
                starts = np.concatenate([[0], np.cumsum(code.lengths[tokens])])
                _same_mask(loss.values.to_numpy(zero_copy_only=False), edges)
                now.add(code.bytes_of(tokens), starts, n, edges)
            yield _rows(rows)
        if now is not None:
            yield _rows([now.row()])

    return run


def _same_mask(loss: np.ndarray, edges: list[dict]) -> None:
    """The mask marks the tokens of the edges and no others."""
    first, past = (np.array([e[k] for e in edges], dtype=np.int64) for k in ("first", "past"))
    named = np.zeros(len(loss), dtype=bool)
    named[ragged(first, past - first)] = True
    if not np.array_equal(named, loss):
        raise ValueError("a loss mask differs from its edges")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in DIGESTS.split(", ")])


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation: its turns and the text under its loss mask, digested from the token ids."""
    columns = ["conv_id", "n_chars", "ids", "loss", "edges"]
    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = formatted.where("whole").select(*columns)
    cut = formatted.where("not whole").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "seq").select(*columns)
    return whole.mapInArrow(_reader(tokenizer), DIGESTS).unionByName(cut.mapInArrow(_reader(tokenizer), DIGESTS))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: a conversation whose texts hold the template's own control strings behind a backslash
PLANTED_ID, PLANTED = -7, "\\### Assistant: </turn> ok"


def with_planted(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, a user and an assistant turn that say ``PLANTED``."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))]))
    one = conversations.sparkSession.range(1).select(rows.alias("r")).select(F.lit(PLANTED_ID).cast("long").alias("conv_id"), "r.turn", "r.role", F.lit(PLANTED).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(one)


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = default_tokenizer()
    rows = with_planted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return read_back(format_conversations(rows, tokenizer), tokenizer)


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in (*MARKS, "<|endoftext|>"):
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PLANTED_ID}, 0, 'user', '{PLANTED}' UNION ALL SELECT {PLANTED_ID}, 1, 'assistant', '{PLANTED}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum({len(HEAD) + 1 + len(TAIL)} + length(replace({_escaped('role')}, chr(10), '\\n')) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
