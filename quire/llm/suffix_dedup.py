"""Suffix-array dedup: bytes of a string that also starts in an earlier document are removed.

A text is its UTF-8 bytes (null: none). A byte goes when a string of `length`
bytes covers it that also starts in a document of smaller doc_id; strings are
judged on the input and never cross documents.

Each shard sorts the suffixes of its fragments with their common prefixes (an
enhanced suffix array) and scans it with a stack for the intervals of its
common-prefix tree that are at least `length` deep. Those with different bytes
to the left are the maximal repeats of these fragments; of each one's occurrences
all but those in its first document are removed. `repeat_groups` puts out the maximal
repeats of whole texts. Fragments come from
`_repeats`, which collapses equal ones before; a fragment's edge counts as a
left context of its own.

Empty text: no bytes. Null doc_id: after all other documents. Rows that share a
doc_id are one document, held by one chunk, and remove nothing from each other.
Very long texts are taken whole; a chunk needs some thirty times the bytes of its
longest text in memory. Extra columns are ignored by suffix_dedup and carried by
without_repeats, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._repeats import HOT, Fragments, Unit, indexed, owners, repeats, twice
from quire.llm._rounds import layout, plain_names, run
from quire.llm._text import fits_column, spread
from quire.llm.substring_dedup import removed_counts, span_lists

SCHEMA = "n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start:long,end:long>>"


@dataclass
class RepeatGroups:
    """Maximal repeats: group g has the suffixes order[left[g] : right[g] + 1], equal in their first size[g] bytes."""

    order: np.ndarray
    fragment: np.ndarray
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray


def deep_intervals(prefix: list[int], least: int) -> list[tuple[int, int, int]]:
    """(left, right, depth) of the common-prefix tree's intervals at least `least` deep. prefix[i]: of suffixes i - 1 and i."""
    found, stack = [], []
    for i, depth in enumerate([*prefix[1:], 0], 1):
        left = i - 1
        while stack and stack[-1][1] > depth:
            left, deep = stack.pop()
            found.append((left, i - 1, deep))
        if depth >= least and (not stack or stack[-1][1] < depth):
            stack.append((left, depth))
    return found


def maximal_repeats(units: np.ndarray, size: np.ndarray, least: int) -> RepeatGroups:
    """Enhanced suffix array over the suffixes of all fragments with at least `least` bytes, and its maximal repeats."""
    begin = np.cumsum(size) - size
    count = np.maximum(size - least + 1, 0)
    fragment = np.repeat(np.arange(len(size)), count)
    offset = spread(np.zeros(len(size), np.int64), count)
    at, rest = begin[fragment] + offset, size[fragment] - offset
    width = -(-int(size.max(initial=least)) // 8) * 8
    padded = np.append(units, np.zeros(width, np.uint8))
    eight = np.zeros(len(padded), np.uint64)
    for k in range(8):  # big-endian, so that numbers sort as bytes do
        eight[: len(padded) - k] |= padded[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    columns = []
    for k in range(0, width, 8):
        left = np.clip(rest - k, 0, 8)
        shift = ((8 - left) * 8).astype(np.uint64)
        columns.append(np.where(left > 0, eight[np.minimum(at + k, len(padded) - 1)] >> np.minimum(shift, np.uint64(63)) << np.minimum(shift, np.uint64(63)), np.uint64(0)))
    order = np.lexsort([rest, *columns[::-1]])
    same, open_ = np.zeros(max(len(order) - 1, 0), np.int64), np.ones(max(len(order) - 1, 0), bool)
    for column in columns:
        x = column[order]
        differ = x[1:] ^ x[:-1]
        lead = np.zeros(len(differ), np.int64)
        for bits in (32, 16, 8):  # number of equal leading bytes
            low = (differ >> np.uint64(64 - bits)) == 0
            lead += np.where(low & (differ != 0), bits // 8, 0)
            differ = np.where(low, differ << np.uint64(bits), differ)
        equal = differ == 0
        same += np.where(open_, np.where(equal, 8, lead), 0)
        open_ &= equal
    short = np.minimum(rest[order][1:], rest[order][:-1])
    prefix = np.append(0, np.minimum(same, short))
    groups = np.array(deep_intervals(prefix.tolist(), least), np.int64).reshape(-1, 3)
    before = np.where(offset > 0, units[np.maximum(at - 1, 0)].astype(np.int64), 256 + fragment)[order]
    changes = np.append(0, np.cumsum(before[1:] != before[:-1]))
    diverse = changes[groups[:, 1]] > changes[groups[:, 0]] if len(order) else np.zeros(0, bool)
    groups = groups[diverse]
    return RepeatGroups(order, fragment, offset, groups[:, 0], groups[:, 1], groups[:, 2])


def array_index(unit: Unit, f: Fragments) -> np.ndarray:
    """For each window of each fragment: does it also start in a document of smaller doc_id?"""
    windows = f.size - unit.length + 1
    begin = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()) + 1, np.int64)
    r = maximal_repeats(f.units, f.size, unit.length)
    if len(r.left):
        member = spread(r.left, r.right - r.left + 1)
        group = np.repeat(np.arange(len(r.left)), r.right - r.left + 1)
        suffix = r.order[member]
        doc = f.doc[r.fragment[suffix]]
        earliest = np.minimum.reduceat(doc, np.cumsum(np.append(0, (r.right - r.left + 1)[:-1])))
        late = doc > earliest[group]
        start = begin[r.fragment[suffix[late]]] + r.offset[suffix[late]]
        np.add.at(out, start, 1)
        np.add.at(out, start + r.size[group[late]] - unit.length + 1, -1)
    return np.cumsum(out)[:-1] > 0


def _kept_bytes(buf: np.ndarray, offs: np.ndarray, spans: object, removed: np.ndarray, first: np.ndarray) -> pa.Table:
    kept = np.append(0, np.cumsum(~removed))[first]
    fits_column(int(kept[-1]))
    data = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(buf[~removed] if len(buf) else buf)])
    lists = span_lists(removed, first)
    return pa.table({"n_bytes": np.diff(first), "n_removed": removed_counts(removed, first), "n_spans": np.diff(lists.offsets.to_numpy()).astype(np.int64), "kept": data, "removed": lists})


def _kept_characters(buf: np.ndarray, offs: np.ndarray, spans: object, removed: np.ndarray, first: np.ndarray) -> pa.Table:
    lead = (buf & 0xC0) != 0x80
    lead[offs[:-1][np.diff(offs) > 0]] = True
    heads = np.flatnonzero(lead)
    gone = np.minimum.reduceat(removed, heads) if len(heads) else removed
    keep = ~np.repeat(gone, np.diff(np.append(heads, len(buf))))
    bytes_at = np.append(0, np.cumsum(keep))[first]
    fits_column(int(bytes_at[-1]))
    chars_at = np.append(0, np.cumsum(keep & lead))[first]
    text = pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(bytes_at.astype(np.int32)), pa.py_buffer(buf[keep] if len(buf) else buf)])
    return pa.table({"kept": text, "kept_chars": np.diff(chars_at), "n_bytes": np.diff(first)})


def _found(docs: DataFrame, finish: Callable, schema: str, length: int, gram: int, hot: int, chunk_bytes: int | None, shard_bytes: int | None, carry: tuple[str, ...] = ()) -> DataFrame:
    unit = Unit(words=False, length=length, gram=gram, within=False)
    chunks, shards = layout(docs, chunk_bytes, shard_bytes)
    return run(docs, repeats(unit, finish), [twice, partial(owners, hot=hot), indexed(unit, array_index)], schema, chunks, shards, carry)


def suffix_dedup(docs: DataFrame, length: int = 50, gram: int = 24, hot: int = HOT, chunk_bytes: int | None = None, shard_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), removed (maximal spans of bytes)."""
    return _found(docs, _kept_bytes, SCHEMA, length, gram, hot, chunk_bytes, shard_bytes)


def without_repeats(docs: DataFrame, length: int = 50, gram: int = 24, hot: int = HOT, chunk_bytes: int | None = None, shard_bytes: int | None = None) -> DataFrame:
    """`docs` with the repeats cut out of their texts, by whole characters; n_chars follows. A row whose text loses everything goes."""
    plain = plain_names(docs, ("doc_id", "text", "n_chars"))
    others = tuple(c for c in plain.columns if c not in ("doc_id", "text"))
    found = _found(plain, _kept_characters, "kept string, kept_chars long, n_bytes long", length, gram, hot, chunk_bytes, shard_bytes, ("text", *others))
    left = found.where((F.col("kept_chars") > 0) | (F.col("n_bytes") == 0))
    cut = F.when(F.col("text").isNotNull(), F.col("kept"))
    return left.select(*(cut if c == "text" else F.when(F.col("n_chars").isNotNull(), F.col("kept_chars")) if c == "n_chars" else F.col(c) for c in plain.columns)).toDF(*docs.columns)
