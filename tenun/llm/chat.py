"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the
loss mask is found by intersecting the sorted spans of the assistant's texts with
the token spans by binary search. The template's marks are special tokens, which
no token crosses, so a span never shares a token with a mark.

Inside texts every ``<|`` gets one backslash more between its two characters, so
a text can never hold a mark; taking one away again restores it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MARKS = (TURN, TEXT, END)
ASSISTANT = "assistant"
_OPEN = re.compile(r"<(\\*)\|")
_CLOSE = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)

SCHEMA = "conv_id long, n_turns long, formatted string, input_ids array<int>, loss_mask array<tinyint>, token_starts array<int>, token_ends array<int>"


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _CLOSE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], learn: str = ASSISTANT) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the texts that ``learn`` says."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        at += len(head)
        if role == learn:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def mask_of(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for every token that overlaps a span; both are sorted, spans are disjoint."""
    mask = np.zeros(len(starts), np.int8)
    if spans:
        begins, stops = np.array(spans).T
        first = np.searchsorted(ends, begins, "right")
        last = np.searchsorted(starts, stops, "left")
        for a, b in zip(first, last):
            mask[a:b] = 1
    return mask


@lru_cache(2)
def tokenizer(path: str):
    """The tokenizer of a file with the template's marks as special tokens."""
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    found = Tokenizer.from_file(path)
    found.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    found.add_special_tokens([AddedToken(m, normalized=False) for m in MARKS])
    return found


def _encode(path: str, conv_id: int | None, turns: list[tuple[str, str]], learn: str) -> tuple:
    formatted, spans = render(turns, learn)
    coded = tokenizer(path).encode(formatted, add_special_tokens=False)
    offsets = np.array(coded.offsets, np.int64).reshape(-1, 2)
    mask = mask_of(offsets[:, 0], offsets[:, 1], spans)
    return conv_id, len(turns), formatted, coded.ids, mask, offsets[:, 0], offsets[:, 1]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    names = ["conv_id", "n_turns", "formatted", "input_ids", "loss_mask", "token_starts", "token_ends"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def format_conversations(turns: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = ASSISTANT) -> DataFrame:
    """One row per conversation: formatted text, token ids, loss mask and token offsets.

    Turns are ordered by number, then role, then text. Null roles and texts are
    empty; turns without a number come first; turns without a conversation id form
    one conversation whose id is null. Repeated turns are turns. Only ``learn``'s
    texts are under the mask, their marks aren't. Offsets count code points of
    ``formatted``. Other columns are not read, and an empty table gives an empty
    result. Sorted partitions are streamed: a task holds one conversation at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, held, rows, size = False, None, [], [], 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
                if begun and conv_id != conv:
                    rows.append(_encode(tokenizer_path, conv, held, learn))
                    size += len(rows[-1][2])
                    held = []
                    if size > 1 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                begun, conv = True, conv_id
                held.append((role or "", text or ""))
        if begun:
            rows.append(_encode(tokenizer_path, conv, held, learn))
            yield _batch(rows)

    given = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    ordered = given.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(run, SCHEMA).withColumnRenamed("conv_id", conv_col)


def learned_spans(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of text under the mask; the bytes of one character may be several tokens."""
    starts, ends = starts[mask == 1], np.maximum.accumulate(ends[mask == 1])
    if not len(starts):
        return []
    first = np.concatenate(([0], np.flatnonzero(starts[1:] > ends[:-1]) + 1))
    return list(zip(starts[first].tolist(), ends[np.append(first[1:] - 1, len(ends) - 1)].tolist()))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests read from the output alone: the turns from the text, what is learned from mask and offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            arrays = [batch.column(c) for c in ("loss_mask", "token_starts", "token_ends")]
            for k, (conv_id, text) in enumerate(zip(batch.column("conv").to_pylist(), batch.column("formatted").to_pylist())):
                turns = parse(text)
                whole = hashlib.sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                spans = learned_spans(*(a[k].values.to_numpy() for a in arrays))
                learned = "".join(unescape(text[a:b]) for a, b in spans)
                rows.append((conv_id, len(turns), whole.hexdigest(), len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    given = formatted.select(F.col(conv_col).alias("conv"), "formatted", "loss_mask", "token_starts", "token_ends")
    out = given.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv_id", conv_col)
