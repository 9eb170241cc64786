"""Operator 1: chat formatting with offset-aligned loss masks.

Template of a turn: ``<|im_start|>role<|im_sep|>text<|im_end|>``. Control
strings inside roles and texts are escaped reversibly: between ``<`` and ``|``
one backslash is added to those already there, so ``<|`` occurs only in the
template's own markers. The markers are special tokens of the tokenizer, which
never joins a token across them; a conversation can therefore be cut at turn
borders without changing a token.

Rows are dealt by range over (conversation, turn, role, text), so a
conversation that holds most rows is spread over many tasks. A task renders
each run of turns of a conversation (a block of at most ``BLOCK_TURNS`` turns
and about ``BLOCK_CHARS`` characters; usually the whole conversation), encodes
it once with offsets, and intersects the token spans with the sorted spans of
the assistant's texts by binary search. ``read_back`` follows a conversation's
blocks in order and keeps nothing but running hashes, for SHA-256 has no
parallel form.

Defined cases: null text or role is empty; turns are ordered by (turn, role,
text), nulls first, so ties and repeated rows have a fixed place; rows without
conversation id form one conversation with a null id; very long texts are a
block of their own; an empty table gives an empty table; other columns are
ignored, whatever their names."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"
BLOCK_TURNS, BLOCK_CHARS = 256, 1 << 20

_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """Text of the turns and the sorted spans of their texts, with whether they count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role == LOSS_ROLE))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a rendered text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("not a rendered conversation")
        sep = formatted.index(SEP, at)
        end = formatted.index(END, sep)
        out.append((unescape(formatted[at + len(START):sep]), unescape(formatted[sep + len(SEP):end])))
        at = end + len(END)
    return out


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int, bool]]) -> np.ndarray:
    """Which tokens (start, end) meet a span that counts; spans are sorted and apart."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    start, end, counts = (np.asarray(x) for x in zip(*spans))
    at = np.searchsorted(end, offsets[:, 0], side="right")      # first span that ends behind the token's start
    inside = np.minimum(at, len(spans) - 1)
    return (at < len(spans)) & (start[inside] < offsets[:, 1]) & counts[inside]


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask, unescaped piece by piece."""
    out, lo, hi = [], None, None
    for a, b in offsets[mask].tolist():
        if hi is not None and a <= hi:              # tokens of one character share its offsets
            hi = max(hi, b)
            continue
        if hi is not None:
            out.append(unescape(formatted[lo:hi]))
        lo, hi = a, b
    if hi is not None:
        out.append(unescape(formatted[lo:hi]))
    return "".join(out)


def tokenizer(definition: str):
    """Tokenizer of a definition (the text of its file) with the template's markers as special tokens."""
    from tokenizers import AddedToken, Tokenizer
    t = Tokenizer.from_str(definition)
    t.add_special_tokens([AddedToken(s, normalized=False, special=True) for s in (START, SEP, END)])
    t.no_truncation()
    t.no_padding()
    return t


def format_conversations(df: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """Rows (conv_id, block, n_turns, formatted, ids, offsets, mask) of rendered
    blocks; ``block`` orders the blocks of a conversation, ``offsets`` holds
    start and end of every token in turn, ``mask`` 1 for tokens of the loss."""
    rows = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                     F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                        ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8()))])

    with open(path, encoding="utf-8") as f:
        definition = df.sparkSession.sparkContext.broadcast(f.read())     # a tokenizer's file: a few MB

    def run(batches):
        tok = tokenizer(definition.value)
        place = TaskContext.get().partitionId() << 32
        key, turns, size, number = None, [], 0, 0

        def sealed():
            formatted, spans = render(turns)
            enc = tok.encode(formatted, add_special_tokens=False)
            offsets = np.asarray(enc.offsets, dtype=np.int64).reshape(-1, 2)
            mask = loss_mask(offsets, spans)
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([place | number]), pa.array([len(turns)]), pa.array([formatted]),
                 pa.array([enc.ids], pa.list_(pa.int32())), pa.array([offsets.ravel()], pa.list_(pa.int32())),
                 pa.array([mask.astype(np.int8)], pa.list_(pa.int8()))], schema=schema)
        for b in batches:
            for c, r, t in zip(*(b.column(i) for i in (0, 2, 3))):
                c, r, t = c.as_py(), r.as_py(), t.as_py()
                if turns and (c != key or len(turns) >= BLOCK_TURNS or size + len(t) > BLOCK_CHARS):
                    yield sealed()
                    turns, size, number = [], 0, number + 1
                key = c
                turns.append((r, t))
                size += len(t)
        if turns:
            yield sealed()

    dealt = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "conv_id long, block long, n_turns long, formatted string, ids array<int>, offsets array<int>, mask array<tinyint>")


def read_back(blocks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars
    of every conversation, from the formatted text, offsets and mask alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        key, state = None, None

        def result():
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([state[0]]), pa.array([state[1].hexdigest()]), pa.array([state[2]]),
                 pa.array([state[3].hexdigest()]), pa.array([state[4]])], names=names)
        for b in batches:
            for c, formatted, offsets, mask in zip(*(b.column(i) for i in (0, 2, 3, 4))):
                if state is None or c.as_py() != key:
                    if state is not None:
                        yield result()
                    key, state = c.as_py(), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = formatted.as_py()
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                spans = np.asarray(offsets.values).reshape(-1, 2)
                loss = masked_text(formatted, spans, np.asarray(mask.values).astype(bool))
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted)
        if state is not None:
            yield result()

    return (blocks.select("conv_id", "block", "formatted", "offsets", "mask").repartition("conv_id")
            .sortWithinPartitions("conv_id", "block").mapInArrow(
                run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
