"""Chat formatting by columnar byte assembly.

A turn is laid out as ``<s>`` role ``[INST]`` text ``[/INST]</s>``. In roles and
texts each backslash is doubled and a backslash goes behind the first character
of every control string, so no text can close or open a turn and reading back
gives it unchanged. The loss mask covers the assistants' texts.

For a batch of turns the lengths of all segments are taken from the Arrow
offsets, cumulative sums give their places, and headers and contents are copied
by scatter indices into one preallocated buffer that becomes the Arrow column.

Rows are shuffled by conversation and sorted by turn; a conversation that spans
several batches or slices is continued in further parts. A task holds a batch
and the arrays of one slice (1 MB of text, or one longer text), however long a
conversation is; a conversation is one task's, as its digest runs over its turns in order.

Defined cases: a null text or role counts as empty; turns are ordered by turn
(null first), then role, then text, so ties and repeated rows are kept in a
fixed order; an empty table gives an empty result; a null ``conv_id`` is one
conversation; columns beyond the four named are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deeptime.llm.text_arrays import SLICE_BYTES, byte_view, filled, slices

#: The template's control strings: open turn, open text, close text, close turn.
CONTROL = ("<s>", "[INST]", "[/INST]", "</s>")
LOSS_ROLE = "assistant"
PARTS_SCHEMA = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(column: pa.Array) -> pa.Array:
    """Escape backslashes and control strings in a whole column."""
    column = pc.replace_substring(column, "\\", "\\\\")
    for mark in CONTROL:
        column = pc.replace_substring(column, mark, mark[0] + "\\" + mark[1:])
    return column


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def assemble(role: pa.Array, text: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted conversations of turns in order; ``first`` is the turn number at which each begins.

    Also returns the byte offsets at which each turn's text starts and ends,
    counted from its conversation's start.
    """
    n = len(role)
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (CONTROL[0], CONTROL[1], CONTROL[2] + CONTROL[3])]
    sources = [marks[0], byte_view(role), marks[1], byte_view(text), marks[2]]
    lengths = np.empty((n, 5), np.int64)
    for k, s in enumerate(sources):
        lengths[:, k] = len(s) if isinstance(s, np.ndarray) else np.diff(s[1])
    places = np.concatenate(([0], np.cumsum(lengths.ravel())))
    out = np.empty(places[-1], np.uint8)
    at = places[:-1].reshape(n, 5)
    for k, s in enumerate(sources):
        if isinstance(s, np.ndarray):
            out[(at[:, k, None] + np.arange(len(s))).ravel()] = np.tile(s, n)
        else:
            _copy(out, at[:, k], *s)
    bounds = np.append(places[first * 5], places[-1])
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(out))
    base = np.repeat(bounds[:-1], np.diff(np.append(first, n)))
    return formatted, at[:, 3] - base, at[:, 4] - base


def _copy(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy the segments of ``data`` to their places: short ones by scatter indices, a very long one as it is."""
    n = np.diff(offsets)
    short = n <= SLICE_BYTES
    for i in np.flatnonzero(~short):
        out[at[i] : at[i] + n[i]] = data[offsets[i] : offsets[i + 1]]
    m = n[short]
    ramp = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    out[np.repeat(at[short], m) + ramp] = data[np.repeat(offsets[:-1][short], m) + ramp]


def _sliced(batches):
    """The batches in slices of bounded text, so that escapes and indices are bounded too."""
    for batch in batches:
        _, offsets = byte_view(filled(batch.column(2)))
        for a, b in slices(offsets):
            yield batch.slice(a, b - a)


def _format(batches):
    last, part = object(), 0
    for batch in _sliced(batches):
        conv = batch.column(0)
        role, text = escape(filled(batch.column(1))), escape(filled(batch.column(2)))
        ids = np.array(conv.to_pylist(), dtype=object)
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        formatted, start, end = assemble(role, text, first)
        stop = np.append(first[1:], len(ids))
        speaks = pc.equal(filled(batch.column(1)), LOSS_ROLE).to_numpy(zero_copy_only=False)
        parts = []
        for k in first:
            part = part + 1 if ids[k] == last and k == 0 else 0
            last = ids[k]
            parts.append(part)
        taken = [np.flatnonzero(speaks[a:b]) + a for a, b in zip(first, stop)]
        loss = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum([len(t) for t in taken]))), pa.int32()),
            pa.StructArray.from_arrays([pa.array(x[np.concatenate(taken)] if len(taken) else [], pa.int64()) for x in (start, end)], ["start", "end"]),
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[k] for k in first], pa.int64()), pa.array(parts, pa.int64()), pa.array(stop - first, pa.int64()), formatted.cast(pa.string()), loss],
            ["conv_id", "part", "n_turns", "formatted", "loss"],
        )


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted parts of conversations, in order within each task.

    ``loss`` holds the byte spans of the part's text that count for the loss.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text").mapInArrow(_format, PARTS_SCHEMA)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, as (role, text)."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _digest(batches):
    state, done = None, []

    def close():
        if state is not None:
            done.append((state["id"], state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def flush():
        rows = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kinds[k]) for k in range(6)], names)
        done.clear()
        return rows

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] == 0:
                close()
                state = {"id": row["conv_id"], "turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
            turns = read_turns(row["formatted"])
            state["turns"] += len(turns)
            state["chars"] += len(row["formatted"])
            for role, text in turns:
                state["all"].update(f"{role}\n{text}\n".encode())
            data = row["formatted"].encode()
            for span in row["loss"]:
                text = unescape(data[span["start"] : span["end"]].decode())
                state["loss_chars"] += len(text)
                state["loss"].update(text.encode())
        yield flush()
    close()
    yield flush()


def digest_chats(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted parts (in ``format_chats``' order)."""
    return parts.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_ESC = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '<\\s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '</s>', '<\\/s>')"
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(20 + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
