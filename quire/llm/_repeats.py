"""Which windows of a corpus also start somewhere earlier: the part that the two repeat removers share.

A unit is a word or a byte, a window `length` units. Every window picks the
least hash among its grams of `gram` units as its anchor; equal windows pick
equal anchors. Windows in a row with one anchor form a fragment of at most
2 * length - gram units. So a window can only repeat within fragments of equal
anchor gram, which one shard gets to see.

Round 1: which anchor grams occur twice at all. Round 2: equal fragments
collapse to one entry, whose first occurrence owns it. Round 3: where one
anchor has several different fragments, their owners send the units, and the
shard's index (a suffix automaton or a suffix array, see the two operators)
finds each window's first occurrence. An anchor with more than `HOT` different
fragments is dealt again by window, so that it lands in many shards.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass

import numpy as np

from quire.llm._text import blocks, byte_grams, covered, grams, hash_words, inside, mix, pack, pair, sliding_min, split_words, spread, unpack

U64 = np.uint64
HOT = 512


@dataclass(frozen=True)
class Unit:
    """What a window is made of. within: an earlier start in the same document counts too."""

    words: bool
    length: int
    gram: int
    within: bool


@dataclass
class Runs:
    """Fragments: first unit (in the chunk), number of windows, document, start in the document, anchor key, content hash."""

    at: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    key: np.ndarray
    content: np.ndarray

    def take(self, which: np.ndarray) -> Runs:
        return Runs(*(x[which] for x in (self.at, self.count, self.doc, self.start, self.key, self.content)))


@dataclass
class Fragments:
    """What a shard's index gets: sizes in units, and the units of all fragments in a row."""

    key: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    units: np.ndarray


Index = Callable[[Unit, Fragments], np.ndarray]


def _spans_hash(g: np.ndarray, s: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """Hash of the units [s, e), length to twice length less gram, from four of their grams."""
    last = e - k
    return pair(pair(g[s], g[np.minimum(s + k, last)]), pair(g[np.minimum(s + 2 * k, last)], g[last]))


def _runs(unit: Unit, g: np.ndarray, first: np.ndarray, total: int, base: int, doc0: int) -> Runs | None:
    span = unit.length - unit.gram + 1
    if len(g) < span:
        return None
    bits = U64(max(24, int(total).bit_length()))
    keyed = (g >> bits << bits) | np.arange(len(g), dtype=U64)
    anchor = (sliding_min(keyed, span) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    valid = inside(first, unit.length, total)[: len(anchor)]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    s = np.flatnonzero(new)
    if not len(s):
        return None
    seen = np.cumsum(valid)
    count = np.diff(np.append(seen[s] - 1, seen[-1]))
    p, e = anchor[s], s + count + unit.length - 1
    content = pair(_spans_hash(g, s, e, unit.gram), (count * 4096 + (p - s)).astype(U64))
    doc = np.searchsorted(first, s, "right") - 1
    return Runs(s + base, count, doc + doc0, s - first[doc], mix(g[p]) >> U64(17), content)


def _split(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, shard numbers, bounds) that deal rows to shards."""
    order = np.argsort(shard, kind="stable")
    to, at = np.unique(shard[order], return_index=True)
    return order, to, np.append(at, len(order))


def repeats(unit: Unit, finish: Callable) -> Callable:
    """Chunk program. finish(buf, offs, spans of words or None, units removed, first unit of each document) makes the table."""

    def program(ids: np.ndarray, buf: np.ndarray, offs: np.ndarray, shards: int) -> Generator:
        found, firsts, units, starts, ends, base = [], [], [], [], [], 0
        for lo, hi in blocks(offs):
            part, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            if unit.words:
                w = split_words(part, at)
                h, first = hash_words(part, w.start, w.end), w.first
                units.append(h)
                starts.append(w.start + offs[lo])
                ends.append(w.end + offs[lo])
                g = grams(h, unit.gram)
                n = len(h)
            else:
                g, first, n = byte_grams(part, unit.gram), at, len(part)
            if (r := _runs(unit, g, first, n, base, lo)) is not None:
                found.append((r, g, base))
            firsts.append(first[:-1] + base)
            base += n
        first = np.append(np.concatenate(firsts) if firsts else np.zeros(0, np.int64), base)
        sym = (np.concatenate(units) if units else np.zeros(0, U64)) if unit.words else buf
        runs = Runs(*(np.concatenate([getattr(r, f) for r, _, _ in found]) if found else np.zeros(0, t) for f, t in (("at", np.int64), ("count", np.int64), ("doc", np.int64), ("start", np.int64), ("key", U64), ("content", U64))))
        doc_of = ids

        # round 1
        order = np.argsort(runs.key, kind="stable")
        keys, head = np.unique(runs.key[order], return_index=True)
        tail = np.append(head[1:], len(order)) - 1
        many = head != tail if unit.within else doc_of[runs.doc[order[head]]] != doc_of[runs.doc[order[tail]]] if len(keys) else np.zeros(0, bool)
        deal, to, bound = _split(mix(keys) % U64(shards), shards)
        value = (keys << U64(1) | many.astype(U64))[deal]
        got = yield {int(s): pack(value[a:b], 6) for s, a, b in zip(to, bound[:-1], bound[1:], strict=True)}
        again = np.zeros(len(keys), bool)
        for s, a, b in zip(to, bound[:-1], bound[1:], strict=True):
            again[deal[a:b]] = np.unpackbits(np.frombuffer(got[int(s)], np.uint8), count=b - a).astype(bool)
        group = np.zeros(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(keys)), tail - head + 1)
        runs = runs.take(again[group]) if len(order) else runs

        # round 2: one entry for each different fragment, at its first occurrence in the chunk
        order = np.lexsort((runs.content, runs.key))
        k, c = runs.key[order], runs.content[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        group = np.zeros(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        owner = order[new]
        deal, to, bound = _split(mix(runs.key[owner]) % U64(shards), shards)
        o = owner[deal]
        planes = [runs.key[o], runs.content[o], doc_of[runs.doc[o]].astype(U64), runs.start[o].astype(U64)]
        got = yield {int(s): b"".join(pack(x[a:b], n) for x, n in zip(planes, (6, 8, 8, 6), strict=True)) for s, a, b in zip(to, bound[:-1], bound[1:], strict=True)}
        code = np.zeros(len(owner), np.uint8)
        for s, a, b in zip(to, bound[:-1], bound[1:], strict=True):
            code[deal[a:b]] = np.frombuffer(got[int(s)], np.uint8)

        # round 3: units of the owned fragments that share their anchor with others
        plain = owner[code == 2]
        hot = owner[code == 3]
        at = spread(runs.at[hot], runs.count[hot])
        w_doc, w_start = np.repeat(runs.doc[hot], runs.count[hot]), spread(runs.start[hot], runs.count[hot])
        w_hash = np.zeros(len(at), U64)
        for _, g, b0 in found:
            mine = (at >= b0) & (at < b0 + len(g))
            if mine.any():
                s = at[mine] - b0
                w_hash[mine] = _spans_hash(g, s, s + unit.length, unit.gram)
        w_order = np.lexsort((w_start, w_doc, w_hash))
        w_new = np.ones(len(at), bool)
        w_new[1:] = w_hash[w_order][1:] != w_hash[w_order][:-1]
        w_group = np.zeros(len(at), np.int64)
        w_group[w_order] = np.cumsum(w_new) - 1
        w_first = w_order[w_new]
        key = np.concatenate([runs.key[plain], w_hash[w_first] >> U64(17)])
        where = np.concatenate([runs.at[plain], at[w_first]])
        size = np.concatenate([runs.count[plain] + unit.length - 1, np.full(len(w_first), unit.length)])
        docs = doc_of[np.concatenate([runs.doc[plain], w_doc[w_first]])]
        begin = np.concatenate([runs.start[plain], w_start[w_first]])
        deal, to, bound = _split(mix(key) % U64(shards), shards)
        sent = {}
        for s, a, b in zip(to, bound[:-1], bound[1:], strict=True):
            d = deal[a:b]
            sent[int(s)] = len(d).to_bytes(8, "little") + pack(key[d], 6) + pack(docs[d].astype(U64), 8) + pack(begin[d].astype(U64), 6) + pack(size[d].astype(U64), 2) + sym[spread(where[d], size[d])].tobytes()
        got = yield sent
        windows = size - unit.length + 1
        ends_at = np.cumsum(windows)
        begins_at = ends_at - windows
        bits = np.zeros(int(windows.sum()), bool)
        for s, a, b in zip(to, bound[:-1], bound[1:], strict=True):
            d = deal[a:b]
            n = int(windows[d].sum())
            bits[spread(begins_at[d], windows[d])] = np.unpackbits(np.frombuffer(got[int(s)], np.uint8), count=n).astype(bool)

        # windows removed: whole fragments, then single windows
        lead = owner[group] if len(group) else group
        mine = np.arange(len(group)) == lead if unit.within else doc_of[runs.doc] == doc_of[runs.doc[lead]] if len(group) else np.zeros(0, bool)
        whole = (code[group] == 1) | ~mine if len(group) else np.zeros(0, bool)
        gone_s, gone_e = [runs.at[whole]], [runs.at[whole] + runs.count[whole] + unit.length - 1]
        # owners, and for bytes the same fragment again in the owner's document
        slot = np.full(len(owner), -1)
        slot[code == 2] = np.arange(len(plain))
        again2 = np.flatnonzero(~whole & (code[group] == 2)) if len(group) else np.zeros(0, np.int64)
        f = slot[group[again2]] if len(again2) else np.zeros(0, np.int64)
        pos = spread(runs.at[again2], runs.count[again2])
        bit = bits[spread(begins_at[f], runs.count[again2])]
        gone_s.append(pos[bit])
        n_plain = int(windows[: len(plain)].sum())
        hot_bits = bits[n_plain:][w_group] if len(at) else np.zeros(0, bool)
        w_lead = w_first[w_group] if len(at) else np.zeros(0, np.int64)
        if len(at):
            hot_bits = hot_bits | (np.arange(len(at)) != w_lead if unit.within else doc_of[w_doc] != doc_of[w_doc[w_lead]])
        offset = np.cumsum(runs.count[hot]) - runs.count[hot]
        slot = np.full(len(owner), -1)
        slot[code == 3] = np.arange(len(hot))
        again3 = np.flatnonzero(~whole & (code[group] == 3)) if len(group) else np.zeros(0, np.int64)
        f = slot[group[again3]] if len(again3) else np.zeros(0, np.int64)
        pos = spread(runs.at[again3], runs.count[again3])
        gone_s.append(pos[hot_bits[spread(offset[f], runs.count[again3])]])
        gone_e += [x + unit.length for x in gone_s[1:]]
        removed = covered(np.concatenate(gone_s), np.concatenate(gone_e), base)
        spans = (np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros(0, np.int64),) * 2
        return finish(buf, offs, spans, removed, first)

    return program


def twice(blobs: list[bytes]) -> list[bytes]:
    """Shard's part of round 1."""
    values = [unpack(b, 6) for b in blobs]
    v = np.concatenate(values)
    order = np.argsort(v, kind="stable")
    k = (v >> U64(1))[order]
    same = k[1:] == k[:-1]
    hit = (v[order] & U64(1)).astype(bool)
    hit[1:] |= same
    hit[:-1] |= same
    out = np.zeros(len(v), bool)
    out[order] = hit
    at = np.cumsum([0, *map(len, values)])
    return [np.packbits(out[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def owners(blobs: list[bytes], hot: int = HOT) -> list[bytes]:
    """Shard's part of round 2: 1 for a fragment that has an earlier owner, else 0 (alone with its anchor), 2 or, with more than `hot` others, 3."""
    rows = [len(b) // 28 for b in blobs]
    cut = lambda at, n: np.concatenate([unpack(memoryview(b)[at * r : (at + n) * r], n) for b, r in zip(blobs, rows, strict=True)])
    key, content, doc, start = cut(0, 6), cut(6, 8), cut(14, 8).astype(np.int64), cut(22, 6)
    order = np.lexsort((start, doc, content, key))
    k, c = key[order], content[order]
    new_key, new = np.ones(len(k), bool), np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new[1:] = new_key[1:] | (c[1:] != c[:-1])
    of_key = np.cumsum(new_key) - 1
    kinds = np.bincount(of_key, weights=new).astype(np.int64)[of_key]
    code = np.where(~new, 1, np.where(kinds == 1, 0, np.where(kinds <= hot, 2, 3))).astype(np.uint8)
    out = np.zeros(len(k), np.uint8)
    out[order] = code
    at = np.cumsum([0, *rows])
    return [out[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def indexed(unit: Unit, index: Index) -> Callable[[list[bytes]], list[bytes]]:
    """Shard's part of round 3."""

    def work(blobs: list[bytes]) -> list[bytes]:
        parts = []
        for b in blobs:
            m, view = int.from_bytes(b[:8], "little"), memoryview(b)[8:]
            cut = lambda at, n: unpack(view[at * m : (at + n) * m], n)  # noqa: B023, E731
            parts.append((cut(0, 6), cut(6, 8).astype(np.int64), cut(14, 6).astype(np.int64), cut(20, 2).astype(np.int64), np.frombuffer(view[22 * m :], U64 if unit.words else np.uint8)))
        every = Fragments(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        windows = every.size - unit.length + 1
        begin, unit_at = np.cumsum(windows) - windows, np.cumsum(every.size) - every.size
        bits = np.zeros(int(windows.sum()), bool)
        order = np.argsort(every.key, kind="stable")
        k = every.key[order]
        heads = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        total = np.cumsum(windows[order])
        lo = 0
        while lo < len(order):  # whole keys, about a hundred thousand windows at a time
            full = np.searchsorted(total, (total[lo - 1] if lo else 0) + 100_000, "right")
            nxt = heads[np.searchsorted(heads, max(full, lo + 1), "left") :]
            hi = int(nxt[0]) if len(nxt) else len(order)
            d = order[lo:hi]
            some = Fragments(every.key[d], every.doc[d], every.start[d], every.size[d], every.units[spread(unit_at[d], every.size[d])])
            bits[spread(begin[d], windows[d])] = index(unit, some)
            lo = hi
        out, at = [], 0
        for p in parts:
            n = int((p[3] - unit.length + 1).sum())
            out.append(np.packbits(bits[at : at + n]).tobytes())
            at += n
        return out

    return work
