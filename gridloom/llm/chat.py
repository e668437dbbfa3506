r"""Operator 1: chat formatting with offset-aligned loss masks.

A conversation becomes one string, a turn being

    ### ROLE: TEXT</turn>\n

in which role and text are escaped: a backslash goes before every backslash, ``###``
and ``</turn>``, in roles also before ``:`` and the line feed.  An unescaped ``###``
or ``</turn>`` is therefore always a mark, and ``parse`` gives back the turns as
they were.

The string is encoded once, with offsets.  The spans of the trained turns and the
spans of the tokens are both sorted, so binary search finds the tokens that meet
each turn, and the mask holds their intersection with it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokenizers_io import Shared, library_tokenizer

OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_BACK = re.compile(r"\\(\\|###|</turn>|:|\n)")
#: A turn of the formatted string: escaped characters are skipped in pairs, so the marks found are real ones.
_TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:|\n)|[^\\:\n])*): ((?:\\(?:\\|###|</turn>|:|\n)|(?!</turn>)[^\\])*)</turn>\n")


def escape(text: str, role: bool = False) -> str:
    return (_ROLE if role else _TEXT).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string, and where in it each turn's escaped text is."""
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        head, body = OPEN + escape(role, role=True) + SEPARATOR, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def mask(spans: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens meet a span, and the character ranges of the tokens inside each span.

    Both are (n, 2) arrays of start and end, sorted and free of overlaps, but
    that tokens may share a character whose bytes they split.
    """
    hit = np.zeros(len(tokens), dtype=bool)
    ranges = []
    if len(tokens):
        low = np.searchsorted(tokens[:, 1], spans[:, 0], side="right")
        high = np.searchsorted(tokens[:, 0], spans[:, 1], side="left")
        for (start, end), a, b in zip(spans.tolist(), low.tolist(), high.tolist(), strict=True):
            if a < b and start < end:
                hit[a:b] = True
                ranges.append((max(start, int(tokens[a, 0])), min(end, int(tokens[b - 1, 1]))))
    return hit, np.array(ranges, dtype=np.int64).reshape(-1, 2)


def offsets(encoding: object, text: str) -> np.ndarray:
    """The (n, 2) spans of an encoding's tokens; gaps go to the token before, so that the tokens cover the text."""
    spans = np.array(encoding.offsets, dtype=np.int64).reshape(-1, 2)  # type: ignore[attr-defined]
    if len(spans):
        starts = np.maximum.accumulate(spans[:, 0])
        ends = np.maximum.accumulate(spans[:, 1])
        ends[:-1] = np.maximum(ends[:-1], starts[1:])
        ends[-1] = len(text)
        starts[0] = 0
        spans = np.stack([starts, ends], axis=1)
    return spans


SCHEMA = "conv_id bigint, formatted string, ids array<int>, loss_mask array<boolean>, loss_starts array<int>, loss_ends array<int>"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    """The turns of one conversation after another, from rows sorted by conversation and turn."""
    key: object = None
    turns: list[tuple[str, str]] = []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if turns and conv != key:
                yield key, turns
                turns = []
            key = conv
            turns.append((role or "", text or ""))
    if turns:
        yield key, turns


def format_chat(df: DataFrame, tokenizer_path: str, trained: tuple[str, ...] = ("assistant",), digests: bool = False) -> DataFrame:
    """One row per conversation of ``df`` (conv_id, turn, role, text; other columns are left out).

    Turns are ordered by ``turn``, ties by role and text; repeated rows are turns of
    their own.  Null role and text count as empty; rows of null ``conv_id`` form one
    conversation, null turns come first.  An empty table gives an empty one.

    A conversation is one string and one encoding by definition, so a long one is the
    work of one task, which holds that conversation alone in memory.  Rows are
    streamed from a sort that spills, not gathered by key.
    """
    shared = Shared(df.sparkSession, tokenizer_path)
    turns = df.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.build("library", library_tokenizer)
        tokenizer.encode_special_tokens = True
        rows: list[tuple] = []
        held = 0
        for conv, turns in _conversations(batches):
            formatted, spans = render(turns)
            encoding = tokenizer.encode(formatted, add_special_tokens=False)
            asked = np.array([s for s, (role, _) in zip(spans, turns, strict=True) if role in trained], dtype=np.int64).reshape(-1, 2)
            hit, ranges = mask(asked, offsets(encoding, formatted))
            if digests:
                rows.append((conv, *_digest(formatted, ranges), len(hit), int(hit.sum())))
            else:
                rows.append((conv, formatted, encoding.ids, hit.tolist(), ranges[:, 0].tolist(), ranges[:, 1].tolist()))
            held += len(formatted)
            if held > 4 << 20 or len(rows) >= 4096:
                yield _batch(rows, digests)
                rows, held = [], 0
        if rows:
            yield _batch(rows, digests)

    return ordered.mapInArrow(run, DIGEST if digests else SCHEMA)


def _digest(formatted: str, ranges: np.ndarray) -> tuple:
    """What is read back from the formatted string and the mask's ranges."""
    turns = parse(formatted)
    whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
    for role, text in turns:
        whole.update(f"{role}\n{text}\n".encode())
    for start, end in ranges.tolist():
        text = unescape(formatted[start:end])
        loss.update(text.encode())
        chars += len(text)
    return len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(formatted)


_TYPES = {
    False: [("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))],
    True: [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())],
}


def _batch(rows: list[tuple], digests: bool) -> pa.RecordBatch:
    fields = _TYPES[digests]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def self_check_rows(df: DataFrame) -> DataFrame:
    """``df`` and conversation -7, whose texts hold the template's own marks."""
    says = "\\### Assistant: </turn> ok"
    extra = df.sparkSession.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    return df.select("conv_id", "turn", "role", "text").unionByName(extra)


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body FROM turns
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(body) + 14)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
