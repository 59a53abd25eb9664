"""Substring dedup with suffix automata: words of a window that also starts earlier are removed.

Words are `[^\\x20\\x09-\\x0D]+`; a window is `length` consecutive words of one
document. A window goes when its word sequence also starts earlier, in a
document of smaller doc_id or further up in the same document. Windows are
judged on the input, so the first occurrence of every passage stays.

Each shard builds suffix automata over its reference fragments, annotated with
the first place where each state's strings end, and streams the documents'
fragments through them for matching statistics; spans whose match is at least
a window long and occurred before are removed. Reference shards are the size
of the corpus together, so they are dealt out by anchor (see `_repeats`)
instead of being broadcast; equal fragments are collapsed before.

Null, empty or wordless text: no words. Null doc_id: after all other documents;
rows that share a doc_id are taken as one document in the order of their texts,
and one chunk holds them all. Ties: of equal windows the first start stays. Very
long texts are taken whole; a chunk needs some thirty times the bytes of its
longest text in memory. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm._repeats import HOT, Fragments, Unit, indexed, owners, repeats, twice
from quire.llm._rounds import layout, run
from quire.llm._text import fits_column, spread

SCHEMA = "n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>"


class SuffixAutomaton:
    """All substrings of the added strings; `first` is the least order number of an end of each state's strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [1 << 200]
        self._last = 0

    def _state(self, size: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.size.append(size)
        self.link.append(link)
        self.first.append(1 << 200)
        return len(self.size) - 1

    def _split(self, p: int, symbol: int) -> int:
        """The state for p's longest string and symbol, parted from longer strings where need be."""
        q = self.next[p][symbol]
        if self.size[q] == self.size[p] + 1:
            return q
        part = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = part
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = part
            p = self.link[p]
        return part

    def add(self, string: list[int], order: int) -> None:
        """order: order number of the string's first symbol; the others follow."""
        last = 0
        for symbol in string:
            if symbol in self.next[last]:
                last = self._split(last, symbol)
            else:
                new, p = self._state(self.size[last] + 1, {}, 0), last
                while p != -1 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p != -1:
                    self.link[new] = self._split(p, symbol)
                last = new
            if order < self.first[last]:
                self.first[last] = order
            order += 1

    def settle(self) -> None:
        """Carry first ends from longer strings to their suffixes."""
        first, link = self.first, self.link
        for state in sorted(range(1, len(first)), key=self.size.__getitem__, reverse=True):
            if first[state] < first[link[state]]:
                first[link[state]] = first[state]

    def first_ends(self, string: list[int], length: int) -> list[int]:
        """Matching statistics cut at `length`: for each end from there on, the first end of the last `length` symbols."""
        state = matched = 0
        out = []
        for at, symbol in enumerate(string):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.size[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            while matched >= length and self.size[self.link[state]] >= length:
                state = self.link[state]
            matched = min(matched, max(length, 1)) if matched >= length else matched
            if at + 1 >= length:
                out.append(self.first[state] if matched >= length else 1 << 200)
        return out


def automaton_index(unit: Unit, f: Fragments) -> np.ndarray:
    """For each window of each fragment: did its units end before, in the order of documents and positions?"""
    words, at = f.units.tolist(), np.append(0, np.cumsum(f.size)).tolist()
    order = ((f.doc.astype(object) * (1 << 48)) + f.start).tolist()
    heads = [0, *(np.flatnonzero(f.key[1:] != f.key[:-1]) + 1).tolist(), len(f.key)]
    out = []
    for lo, hi in zip(heads[:-1], heads[1:], strict=True):
        shard = SuffixAutomaton()
        for k in range(lo, hi):
            shard.add(words[at[k] : at[k + 1]], order[k])
        shard.settle()
        for k in range(lo, hi):
            own = order[k] + unit.length - 1
            out += [first < own + n for n, first in enumerate(shard.first_ends(words[at[k] : at[k + 1]], unit.length))]
    return np.array(out, bool)


def span_lists(removed: np.ndarray, first: np.ndarray) -> pa.Array:
    """Maximal removed spans of each document, counted from its first unit."""
    edge = np.zeros(len(removed) + 1, bool)
    edge[1:-1] = removed[1:] != removed[:-1]
    edge[first] = True
    cut = np.flatnonzero(edge)
    start = cut[:-1][removed[cut[:-1]]] if len(removed) else np.zeros(0, np.int64)
    end = cut[1:][removed[cut[:-1]]] if len(removed) else np.zeros(0, np.int64)
    count = np.searchsorted(start, first)
    base = first[np.searchsorted(first, start, "right") - 1]
    spans = pa.StructArray.from_arrays([pa.array(start - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(count, pa.int32()), spans)


def removed_counts(removed: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(removed))[first])


def _kept_words(buf: np.ndarray, offs: np.ndarray, spans: tuple[np.ndarray, np.ndarray], removed: np.ndarray, first: np.ndarray) -> pa.Table:
    start, end = spans
    kept = ~removed
    padded = np.append(buf, np.uint8(32))
    size = (end - start)[kept] + 1
    out = padded[spread(start[kept], size)]
    stop = np.cumsum(size)
    out[stop - 1] = 32
    number = np.append(0, np.cumsum(kept))[first]  # kept words before each document
    at = np.append(0, stop)[number]
    has = number[1:] > number[:-1]
    drop = np.ones(len(out), bool)
    drop[at[1:][has] - 1] = False  # the space after a document's last word
    offsets = at - np.append(0, np.cumsum(has))
    fits_column(int(offsets[-1]))
    text = pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out[drop])])
    return pa.table({"n_words": np.diff(first), "n_removed": removed_counts(removed, first), "kept": text, "removed": span_lists(removed, first)})


def substring_dedup(docs: DataFrame, length: int = 20, gram: int = 8, hot: int = HOT, chunk_bytes: int | None = None, shard_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space), removed (maximal spans of words)."""
    unit = Unit(words=True, length=length, gram=gram, within=True)
    chunks, shards = layout(docs, chunk_bytes, shard_bytes)
    return run(docs, repeats(unit, _kept_words), [twice, partial(owners, hot=hot), indexed(unit, automaton_index)], SCHEMA, chunks, shards)
